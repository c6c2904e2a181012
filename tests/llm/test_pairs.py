"""The Jaccard join, components, sharding, mixing and top-k search against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferrule.llm import jaccard_join, mixing, sharding, topk, url_filter
from ferrule.llm.common import read
from ferrule.llm.graph import components
from ferrule.llm.queries import ORACLE_SQL, QUERIES, RULES
from ferrule.llm.shingles import shingle_sets
from tests.oracle import connect, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    """Documents from (doc_id, text[, source])."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], DOCS)


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}


def brute_components(rows):
    sets = {d: shingles(t) for d, t, *_ in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def corpus(seed, n=120):
    """Random texts, exact copies, chains of near copies, passages that many share, and odd ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows, texts = [], []
    for doc in range(n):
        kind = rng.random()
        if texts and kind < 0.2:
            text = rng.choice(texts)
        elif texts and kind < 0.6:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.choice([1, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary).upper()
            text = " ".join(words)
        elif kind < 0.8:
            text = " ".join(passage + [rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 9, 40]))])
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 30, 80])))
        texts.append(text)
        rows.append((doc * 3, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_finds_the_components_of_brute_force(spark, seed):
    rows = [*corpus(seed), (1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "ONE  two"), (1005, "two one"), (1006, "x " * 20_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs_of(spark, rows)).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("paired", [256, 3])
def test_links_are_those_of_brute_force(spark, monkeypatch, paired):
    monkeypatch.setattr(jaccard_join, "PAIRED", paired)
    words = [f"v{k}" for k in range(60)]
    near = [(2000 + k, " ".join([*words, f"end{k}"])) for k in range(12)]  # all linked with one another, all different
    rows = [*corpus(4), *near, (1000, None), (1001, ""), (1003, "one two")]
    sets = {d: shingles(t) for d, t in rows}
    linked = lambda x, y: bool(x & y) and 100 * len(x & y) >= 75 * len(x | y)
    expected = {d: (len(s), sum(linked(s, t) for e, t in sets.items() if e != d)) for d, s in sets.items()}
    assert all(expected[d][1] == 11 for d, _ in near)
    docs = docs_of(spark, rows).repartition(3)
    got = [(r.doc_id, r.n_shingles, r.n_links) for r in jaccard_join.count_links(docs).collect()]
    assert len(got) == len(rows) and {d: (n, c) for d, n, c in got} == expected
    found = jaccard_join.links(docs).collect()
    classes = defaultdict(list)
    for d, s in sets.items():
        classes[frozenset(s)].append(d)
    reps = {min(v): (s, len(v)) for s, v in classes.items() if s}
    pairs = {(a, b, reps[a][1], reps[b][1]) for a in reps for b in reps if a < b and linked(reps[a][0], reps[b][0])}
    assert {tuple(r) for r in found} == pairs and len(found) == len(pairs)
    assert jaccard_join.count_links(docs.where("false")).count() == 0


def test_join_with_every_list_dealt_over_salts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 0)
    monkeypatch.setattr(jaccard_join, "HOT_TIMES", 0)
    rows = corpus(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs_of(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_join_of_null_and_repeated_ids_and_an_empty_table(spark):
    text = "a b c d e f g"
    rows = [(5, text), (5, text), (None, text), (2, "q r s t u v"), (9, text)]
    found = jaccard_join.join(docs_of(spark, rows).withColumn("h", F.lit(1)).withColumn("component_id", F.lit("x")))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == Counter([(5, 3, 5), (5, 3, 5), (None, 3, None), (2, 2, 2), (9, 3, 5)])
    assert jaccard_join.join(docs_of(spark, rows).where("false")).count() == 0
    kept = jaccard_join.keep_first(docs_of(spark, rows))
    assert Counter(r.doc_id for r in kept.collect()) == Counter([5, 5, None, 2])
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_shingle_sets_over_chunks_and_slices():
    texts = ["a b c d e f", None, "", "x" * 3_000_000 + " y", "A b C d e F", "é ü\x0bß", *["q w e r t y"] * 5]
    array = pa.array(["skip", *texts]).slice(1)
    sets = list(shingle_sets(array))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert set(sets[0]) == set(sets[4])
    assert len(set(sets[0]) & set(sets[6])) == 0


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(7, k) for k in range(1000, 1100)]
    edges = spark.createDataFrame([*chain, *star, (3, 3), (None, 4)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 7 for k in [7, *range(1000, 1100)]}
    assert components(edges.where("false")).count() == 0


def test_shards_hold_the_mixture(spark):
    rng = random.Random(4)
    rows = [(k, "x" * rng.randrange(50), "hot" if k % 3 else rng.choice(["a", "b", None])) for k in range(1000)]
    rows += [(None, None, None), (5, "same", "hot"), (5, "same", "hot")]
    found = sharding.shard(docs_of(spark, rows).withColumn("shard", F.lit("clash")), 40).collect()
    assert len(found) == len(rows)
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r)
    sizes = sorted(len(v) for v in by.values())
    assert set(by) == set(range(40)) and sizes[-1] - sizes[0] <= 1
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    whole = Counter(r.source for r in found)
    for v in by.values():
        for source, c in Counter(r.source for r in v).items():
            assert abs(c - len(v) * whole[source] / len(found)) <= len(whole)
    texts = defaultdict(set)
    for d, t, *_ in rows:
        texts[d].add((len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode())))
    assert all((r.size, r.text_crc32) in texts[r.doc_id] for r in found)
    again = sharding.shard(docs_of(spark, rows[::-1]).repartition(7), 40).collect()
    assert Counter((r.doc_id, r.shard, r.slot) for r in again) == Counter((r.doc_id, r.shard, r.slot) for r in found)


def brute_shards(rows, shards):
    """Shard and slot of every row by sorting all of them."""
    key = lambda x: hashlib.md5(f"17:{'' if x is None else x}".encode()).hexdigest()[:16]
    coarse = Counter(key(t)[:3] for _, t, _ in rows)
    part = lambda t, d: int(key(d)[:8], 16) % max(1, coarse[key(t)[:3]] * 4096 // len(rows))
    by = defaultdict(list)
    for d, t, s in rows:
        by[s].append((key(t), key(d), d, s, t))
    places = []
    for s, group in by.items():
        group.sort(key=lambda r: (r[0][:3], part(r[4], r[2]), r[:2]))
        places += [((2 * k + 1) / (2 * len(group)), s is None, s or "", r) for k, r in enumerate(group)]
    places.sort(key=lambda p: (int(p[0] * 4096), p[:3], p[3][:2]))
    n = len(places)
    slots: Counter = Counter()
    for k, (*_, r) in enumerate(places):
        shard = k * shards // n
        yield r[2], r[3], shard, slots[shard]
        slots[shard] += 1


def test_shards_are_those_of_brute_force_and_keep_groups(spark):
    rng = random.Random(14)
    texts = [f"text {k}" for k in range(300)]
    rows = [(k, rng.choice(texts), rng.choice(["hot", "hot", "hot", "a", None])) for k in range(1500)]
    found = sharding.shard(docs_of(spark, rows), 40).collect()
    groups = defaultdict(Counter)
    texts_of = {d: t for d, t, _ in rows}
    for r in found:
        groups[texts_of[r.doc_id], r.source][r.shard] += 1
    assert {(r.doc_id, r.source, r.shard, r.slot) for r in found} == set(brute_shards(rows, 40))


def test_a_text_of_a_third_of_all_rows_is_dealt_over_buckets(spark):
    rows = [(k, "hot text" if k % 3 == 0 else f"text {k}", rng) for k, rng in enumerate(["a", "b"] * 3000)]
    found = sharding.shard(docs_of(spark, rows), 10).collect()
    sizes = Counter(r.shard for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    by = Counter((r.shard, r.source) for r in found)
    assert all(abs(by[k, "a"] - 300) <= 2 for k in range(10))
    # Of small groups of equal texts, in many rows, few are split: those that a cut falls on.
    rows = [(k, f"text {k // 4}", "a" if k % 8 < 6 else "b") for k in range(12_000)]
    of = defaultdict(set)
    for r in sharding.shard(docs_of(spark, rows), 10).collect():
        of[r.doc_id // 4].add(r.shard)
    assert sum(len(v) > 1 for v in of.values()) <= 0.02 * len(of)


def test_shards_with_their_columns(spark):
    rows = [(k % 50, None if k % 11 == 0 else f"text {k % 70}", "a" if k % 3 else None) for k in range(400)] + [(None, "x", "a")] * 3
    docs = docs_of(spark, rows).withColumn("slot", F.lit("clash"))
    whole = sharding.shard_whole(docs, 7)
    assert whole.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    got = whole.collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(rows)
    crc = lambda t: None if t is None else zlib.crc32(t.encode())
    plain = sharding.shard(docs, 7).collect()
    assert Counter((r.doc_id, r.source, crc(r.text), r.shard, r.slot) for r in got) == Counter((r.doc_id, r.source, r.text_crc32, r.shard, r.slot) for r in plain)
    assert sharding.shard_whole(docs.where("false")).count() == 0


def test_sharding_more_rows_than_buckets_of_an_int_can_number(spark):
    # 4,095, the last coarse bucket, times the rows is over 2^31.
    n = 530_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("s").alias("source"))
    found = sharding.shard(docs, 40).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    assert {r.shard for r in found} == set(range(40)) and all(r.n == r.slots == r["last"] + 1 == n // 40 for r in found)


def test_sharding_few_rows_and_none(spark):
    assert sharding.shard(docs_of(spark, []), 40).count() == 0
    found = sharding.shard(docs_of(spark, [(k, "t") for k in range(3)]), 40).collect()
    assert len({r.shard for r in found}) == 3 and {r.slot for r in found} == {0}


def brute_targets(sizes):
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    full: set = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        total = sum(weight[s] for s in sources if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / total for s in sources}
        over = {s for s in sources if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix_meets_its_targets(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 7, 100, 400])), rng.choice(["hot"] * 6 + ["a", "b", "tiny", None])) for k in range(400)]
    rows += [(9000, None, "a"), (9001, "", "empty"), (None, "one two", "a"), (9002, "w " * 3000, "hot")]
    found = mixing.mix(docs_of(spark, rows).withColumn("taken", F.lit("clash"))).collect()
    assert len(found) == len(rows)
    sizes: dict = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    targets = brute_targets(sizes)
    taken: dict = defaultdict(int)
    for r in found:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        taken[r.source] += r.taken
    # What the slots of the sequence take: the target but for a few slots, here of one word.
    assert mixing.block_words(sum(sizes.values())) == 1
    assert all(abs(taken[s] - targets[s]) <= 6 for s in targets)
    again = mixing.mix(docs_of(spark, rows[::-1]).repartition(5)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in found)


def test_mixed_documents_come_as_often_as_they_are_taken(spark):
    rows = [(k, "w " * 10, "big" if k < 60 else "small") for k in range(64)] + [(0, "w " * 10, "big")]
    plan = Counter()
    for r in mixing.mix(docs_of(spark, rows)).collect():
        plan[r.doc_id] += int(r.taken / r.size + 0.5)
    kept = mixing.mixed(docs_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter(r.doc_id for r in kept.collect()) == +plan
    assert mixing.mixed(docs_of(spark, [])).count() == 0


def test_blocks_hold_the_interleaved_order(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 7, 100, 400])), rng.choice(["hot"] * 6 + ["a", "b", "tiny", None])) for k in range(400)]
    docs = docs_of(spark, [*rows, (5000, "one two", "t1"), (5001, "one", "t2")])
    found = sorted(mixing.blocks(docs).collect(), key=lambda r: (r.slot, r.at))
    by = defaultdict(list)
    for r in found:
        by[r.slot].append(r)
    # Each slot's source is that of its golden-ratio point; slots of a source that was taken three times stay empty.
    sizes: dict = defaultdict(int)
    for _, t, s in [*rows, (0, "w w", "t1"), (0, "w", "t2")]:
        sizes[s] += len(WORD.findall(t or ""))
    targets = brute_targets(sizes)
    total, sources = sum(sizes.values()), sorted(targets, key=lambda s: (s is None, s or ""))
    ends = np.floor(np.cumsum([targets[s] for s in sources]) / sum(targets.values()) * mixing.PERIOD)
    drawn = [sources[int(np.searchsorted(ends, i * mixing.STEP % mixing.PERIOD, "right"))] for i in range(total)]
    assert all(by[i][0].source == drawn[i] for i in by)
    left = [drawn[i] for i in set(range(total)) - set(by)]
    assert len(left) <= 12 and all(targets[s] == 3 * sizes[s] for s in left)
    taken: dict = defaultdict(int)
    for pieces in by.values():
        assert len({r.source for r in pieces}) == 1
        at = 0
        for r in pieces:
            assert r.at == at and r.first < r.last
            at += r.last - r.first
            taken[r.doc_id] += r.last - r.first
        assert at == 1
    assert taken == {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
    # A stretch of the mix holds the sources by their shares, up to a few blocks.
    order = [by[k][0].source for k in sorted(by)]
    for end in range(20, len(order), 20):
        for source, c in Counter(order).items():
            assert abs(order[:end].count(source) - c * end / len(order)) <= 4
    kept = mixing.mixed(docs, slot="slot").collect()
    slots = [r.slot for r in kept]
    first: dict = {}
    for r in found:
        first.setdefault((r.doc_id, r["pass"]), r.slot)
    seen: dict = defaultdict(list)
    for r in kept:
        seen[r.doc_id].append(r.slot)
    assert slots == sorted(slots)
    assert all(sorted(v) == sorted(first[d, k] for k in range(len(v))) for d, v in seen.items())
    assert [r.doc_id for r in mixing.mixed(docs).collect()] == [r.doc_id for r in kept]


@pytest.mark.parametrize("seed", [topk.SEED, 50])
def test_threshold_search_is_exact_with_ties_and_bad_vectors(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "SEED", seed)
    monkeypatch.setattr(topk, "GROUP", 1)
    rng = np.random.default_rng(6)
    vectors = [(k, [float(x) for x in rng.normal(size=6)]) for k in range(300)]
    vectors += [(k, vectors[0][1]) for k in range(400, 430)]
    bad = [(900, None), (901, [1.0] * 5 + [None]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (904, [1.0, 2.0]), (1000, [0.0] * 6)]
    df = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(df, df.where("vec_id % 100 = 0")).collect()}
    ok = {k: np.array([np.floor(1024 * x) for x in v] + [0.0] * (6 - len(v))).astype(int) for k, v in [*vectors, bad[5], bad[6]]}
    expected = {}
    for q in (k for k in ok if k % 100 == 0):
        best = sorted((-int(ok[q] @ v), k) for k, v in ok.items() if k != q)[:10]
        expected |= {(q, rank): (k, -s) for rank, (s, k) in enumerate(best, 1)}
    assert got == expected


def test_search_with_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<float>")
    got = [(r.rank, r.vec_id, r.score) for r in topk.search(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 1, 1024 * 2048), (2, 2, -1024 * 1024)]
    assert topk.search(df.where("false"), df).count() == 0
    assert topk.search(df, df.where("false")).count() == 0


def test_a_block_search_stops_early_and_is_still_right():
    rng = np.random.default_rng(7)
    vectors = np.zeros((4096, 4), np.int64)
    vectors[:, 0] = rng.integers(0, 10_000, 4096)
    lists = topk.Lists(np.arange(4096), vectors)
    rows, scores = lists.search(-1, np.array([3, 0, 0, 0]), 5)
    order = np.lexsort((np.arange(4096), -3 * vectors[:, 0]))[:5]
    assert rows.tolist() == order.tolist() and scores.tolist() == (3 * vectors[order, 0]).tolist()
    floor = int(scores[2])
    rows, scores = lists.search(-1, np.array([3, 0, 0, 0]), 5, floor)
    assert rows.tolist() == [r for r in order.tolist() if 3 * vectors[r, 0] >= floor]
    assert lists.search(-1, np.array([3, 0, 0, 0]), 5, 40_000)[0].tolist() == []


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_give_the_rows_of_their_sql(spark, data, name):
    same(QUERIES[name](spark, data), connect(data), ORACLE_SQL[name])


def test_sharding_query_over_the_whole_table(spark, data):
    rows = QUERIES["op3_sharding"](spark, data).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None for r in rows)


CLASHES = ["_id", "_n", "_size", "_may", "_mask", "_block", "may", "block", "mask", "bits", "row", "n", "m", "key", "mark", "turn", "size", "crc", "tie", "sid", "start", "a.b"]


@pytest.mark.parametrize("stage", [jaccard_join.keep_first, mixing.mixed, sharding.shard_whole])
def test_stages_keep_columns_of_any_name(spark, stage):
    text = "a b c d e f g h"
    rows = [(k, text if k < 3 else f"{k} " * (k + 1), "s" if k % 2 else None) for k in range(30)] + [(None, text, "s"), (None, text, "s"), (3, "3 " * 4, "s")]
    plain = docs_of(spark, rows)
    wide = plain.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(c) for c in CLASHES])
    found, bare = stage(wide), stage(plain).collect()
    added = [c for c in stage(plain).columns if c not in plain.columns]
    assert found.columns == [*wide.columns, *added]
    rows = found.collect()
    assert all(r[c] == f"{c}:{'null' if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHES)
    narrow = lambda r: tuple(str(r[c]) for c in [*plain.columns, *added])
    assert Counter(map(narrow, rows)) == Counter(map(narrow, bare)) and rows


def test_a_list_that_urls_do_not_give_decides_verdicts(spark):
    folder = "/root/testdata/sf0.01"
    found = {r.page_id: r for r in QUERIES["op8_url_filter"](spark, folder).collect()}
    unlisted = {r.page_id: r.verdict for r in url_filter.judge(read(spark, folder, "pages"), url_filter.entries(url_filter.spam(read(spark, folder, "pages"))), RULES).collect()}
    changed = [k for k, r in found.items() if r.verdict != unlisted[k]]
    assert changed and all(found[k].rule is None and found[k].verdict == "block" for k in changed)
    html = [("u1", "<p>one two</p>"), ("u2", "<b " + "x " * 99 + ">a</b>"), ("u3", "w " * 60), ("u4", None)]
    assert {r.url for r in url_filter.thin(spark.createDataFrame(html, "url string, html string")).collect()} == {"u1", "u2", "u4"}
