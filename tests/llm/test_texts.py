"""Decontamination, language, toxicity, personal data, URLs, WARC and the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
import re
import time
import tracemalloc
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ferrule.llm import common, decontaminate, langid, pii, toxicity, url_filter, warc
from ferrule.llm.queries import QUERIES, RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS)


# --- decontamination ---------------------------------------------------------

ITEM = "Which of the following rivers crosses three capital cities before it reaches the sea, and what did the survey of 1871 say about its length?"
BENCH = "item_id long, text string"


def plain(text):
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def edit_distance_within(pattern, text):
    """Least edits between the pattern and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_matches_are_those_of_edit_distance(spark):
    rng = random.Random(1)
    filler = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    rows = []
    for k in range(60):
        item = list(ITEM)
        for _ in range(k % 20):
            at = rng.randrange(len(item))
            item[at : at + 1] = rng.choice([[], ["z"], [item[at], "q"]])
        rows.append((k, filler(rng.choice([0, 3, 200])) + " " + "".join(item) + " " + filler(rng.choice([0, 100]))))
    rows += [(100, ITEM.upper().replace(" ", "\n--\n")), (101, ITEM[: len(ITEM) // 2]), (102, None), (103, ""), (104, filler(5000)), (104, ITEM), (None, ITEM), (105, ("é" * 700 + " ") * 30 + ITEM)]
    bench = spark.createDataFrame([(7, ITEM), (8, "too short"), (9, None), (None, ITEM + " other")], BENCH)
    found = decontaminate.matches(docs_of(spark, rows).withColumn("start", F.lit("clash")), bench).collect()
    got = Counter((r.doc_id, r.item_id, r.edits) for r in found)
    pattern = plain(ITEM)
    budget = int(decontaminate.RATE * len(pattern))
    expected = Counter()
    for d, t in rows:
        if t and (e := edit_distance_within(pattern, plain(t)[-2 * len(pattern) - 250 :])) <= budget:
            expected[d, 7, e] += 1
    assert got == expected
    texts = dict(rows)
    for r in found:
        if r.edits == 0 and r.doc_id is not None:
            assert plain(texts[r.doc_id][r.start : r.end]) == pattern


def test_clean_leaves_the_rest_alone(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 100)  # several blocks
    bench = spark.createDataFrame([(k, f"{ITEM} Variant number {k} of {k * 7919} is meant here.") for k in range(5)], BENCH)
    rows = [(1, "nothing here"), (2, f"so {ITEM} Variant number 3 of {3 * 7919} is meant here. yes"), (3, None), (4, "nothing here")]
    kept = decontaminate.clean(docs_of(spark, rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert decontaminate.clean(docs_of(spark, rows), bench.where("false")).count() == 4
    assert decontaminate.matches(docs_of(spark, rows).where("false"), bench).count() == 0


def test_short_items_and_those_without_an_id_are_found(spark):
    items = [(1, "Who wrote Emma, and when?"), (2, "水的化学式是什么，它由哪些元素组成，在标准气压下多少度沸腾"), (3, "7 x 8?"), (4, "short"), (4, "Short!"), (5, "--"), (6, "Name the largest moon of Jupiter."), (None, "What is the capital of France?")]
    bench = spark.createDataFrame(items, BENCH)
    rows = [(k, f"before. {t}. after") for k, (_, t) in enumerate(items)]
    rows += [(20, "7 x 8"), (21, "7x8"), (22, "who wrote Emma and whem"), (23, "name the largest mon of jupiter"), (24, "7 x"), (25, None), (26, "..."), (27, "rt 7 x"), (28, "x 8 sho")]
    found = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.matches(docs_of(spark, rows), bench).collect()}
    expected = {(0, 1, 0), (1, 2, 0), (2, 3, 0), (3, 4, 0), (4, 4, 0), (6, 6, 0), (20, 3, 0), (23, 6, 1)}
    assert found == expected
    kept = {r.doc_id for r in decontaminate.clean(docs_of(spark, rows), bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, *_ in expected} - {7}
    place = {(r.doc_id, r.item_id): (r.start, r.end) for r in decontaminate.matches(docs_of(spark, rows), bench).collect()}
    assert place[2, 3] == (8, 13) and place[20, 3] == (0, 5)


def test_all_benchmark_passages_of_the_table_are_found(spark, data):
    found = {(r.doc_id, r.item_id) for r in QUERIES["op5_benchmark_decontamination"](spark, data).collect()}
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    assert found >= {(d, i) for d, t in docs.items() for i, b in items.items() if b in t}


def test_texts_that_repeat_themselves_take_bounded_memory(spark, monkeypatch):
    """Every q-gram of the text is every q-gram of the item: 150 million shared ones, counted a few at a time."""
    monkeypatch.setattr(decontaminate, "HITS", 1 << 16)
    index = decontaminate.build([(1, "ha " * 150), (2, ITEM)])
    tracemalloc.start()
    found = decontaminate.find(["so ha " + "ha " * 170_000 + ITEM], index)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [m[0] for m in found] == [1, 2] and [m[3] for m in found] == [0, 0] and peak < 150 << 20


@pytest.mark.parametrize("chunk", [1 << 17, 16])
def test_items_without_edits_are_whole_words(monkeypatch, chunk):
    monkeypatch.setattr(decontaminate, "CHUNK", chunk)
    items = {1: "yes", 2: "42", 3: "a", 4: "the weather is", 5: "水", 6: "GPT"}
    index = decontaminate.build(list(items.items()))
    held = {
        "Open your eyes, please.": set(), "eyes yes!": {1}, "1423 and 421": set(), "is it 42?": {2}, "A": {3}, "banana": set(), "and the weather is, well, bad": {4}, "and the weather isn't bad": set(), "see: the weather island": set(), "bathe weather is": set(), "the weather is": {4},
        "喝水吧": {5}, "使用GPT写": {6}, "GPTs": set(), "x" * 200 + "yes" + "x" * 200: set(), "w " * 90 + "yes " + "w " * 90: {1}, "": set(), "x" * 33 + " 42": {2}, "the weather is" + "x" * 50: set(),
    }
    found = decontaminate.find([*held, None], index)
    assert [{i for i, *_ in f} for f in found] == [*held.values(), set()]
    spans = [t[s:e] for t, f in zip(held, found, strict=False) for i, s, e, _ in f if i == 1]
    assert spans == ["yes", "yes"]


@pytest.mark.parametrize("chunk", [300, 1 << 19])
def test_long_texts_are_read_in_windows(monkeypatch, chunk):
    rng = random.Random(11)
    index = decontaminate.build([(1, ITEM), (2, "7 x 8?"), (3, "Name the largest moon of Jupiter.")])
    monkeypatch.setattr(decontaminate, "CHUNK", chunk)
    texts = []
    for k in range(25):
        filler = lambda n: "".join(rng.choice("abc  .,-é") for _ in range(n))
        texts.append(filler(k * 37) + " 7 x  8 " + filler(rng.randrange(400)) + " " + ITEM.replace("rivers", "river").replace(" ", " \n" * rng.choice([1, 1, 40])) + " " + filler(rng.randrange(900)) + " name the largest moon of jupiter")
    for text, found in zip(texts, decontaminate.find(texts, index), strict=True):
        assert [(m[0], m[3]) for m in found] == [(1, 1), (3, 0), (2, 0)]
        spans = {m[0]: text[m[1] : m[2]] for m in found}
        assert plain(spans[1]) == plain(ITEM.replace("rivers", "river")) and plain(spans[2]) == "7 x 8" and plain(spans[3]).startswith("name the")


# --- language ----------------------------------------------------------------


def test_language_of_held_out_documents(spark, data):
    rows = QUERIES["op9_language_id"](spark, data).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and held
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_backs_off_and_knows_its_limits(spark):
    labelled = [("en", "the cat and the dog sat on the mat"), ("de", "der Hund und die Katze saßen auf der Matte"), (None, "x"), ("en", None)] * 3
    train = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(labelled)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    texts = [None, "", "123 !?", "the cat", "Katzen Hunde", "ß", "漢字", "²", "the " * 40_000]
    docs = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert [got[k][0] for k in range(9)] == ["und", "und", "und", "en", "de", "de", got[6][0], "und", "en"]
    assert got[6][0] in ("en", "de") and all(0 <= s <= 1 for _, s in got.values())
    assert sorted(r.doc_id for r in langid.keep(docs, model).collect()) == [3, 4, 5, *([6] if got[6][1] >= 0.5 else []), 8]
    nothing = langid.fit(train.where("false"))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.where("false"), model).count() == 0


def brute_language(rows, text):
    """Language and posterior by the definition, over all counts."""
    token = re.compile(r"[^\W\d_]+")
    grams = lambda w, n: [w] if n == 0 else (lambda m: [m[k : k + n] for k in range(len(m) - n + 1)])(f"<{w}>" if n > 1 else w)
    counts = [defaultdict(Counter) for _ in range(langid.LONGEST + 1)]
    for lang, t in rows:
        for w in token.findall((t or "").lower()):
            for n in range(langid.LONGEST + 1):
                for g in grams(w, n):
                    counts[n][g][lang] += 1
    languages = sorted({lang for lang, _ in rows})
    total = lambda n, lang: sum(c[lang] for c in counts[n].values()) + langid.SMOOTH * max(len(counts[n]), 1)
    log = lambda n, g, lang: math.log((counts[n][g][lang] + langid.SMOOTH) / total(n, lang))
    words = token.findall(text.lower())
    score = dict.fromkeys(languages, 0.0)
    for w in words:
        for n in range(langid.LONGEST + 1):
            order = n and langid.LONGEST + 1 - n  # the word, then n-grams from the longest
            if known := [g for g in grams(w, order) if g in counts[order]]:
                for lang in languages:
                    score[lang] += sum(log(order, g, lang) for g in known) / len(known)
                break
    mean = {k: v / len(words) * min(len(words), langid.SURE) for k, v in score.items()}
    best = max(languages, key=lambda k: (mean[k], -languages.index(k)))
    return best, 1 / sum(math.exp(v - mean[best]) for v in mean.values())


def test_language_scores_are_those_of_brute_force(spark):
    rng = random.Random(12)
    alphabets = {"aa": "abcde", "bb": "bcdef", "cc": "xyzab"}
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(n))
    rows = [(lang, text(letters, 30)) for lang, letters in alphabets.items() for _ in range(6)] + [("rare", "qqq qqr")]
    train = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    tests = [text(rng.choice(list(alphabets.values())) + "qk", rng.randrange(1, 40)) for _ in range(60)]
    got = langid.predict(docs_of(spark, list(enumerate(tests))), langid.fit(train)).collect()
    for r in got:
        lang, score = brute_language(rows, tests[r.doc_id])
        assert (r.lang_pred, r.score) == (lang, pytest.approx(score))


def test_every_language_is_learned_and_frequent_words_stay(spark, monkeypatch):
    rows = [(k, f"w{chr(97 + k % 20)}{chr(97 + k // 20)}x common", f"l{k:03d}") for k in range(300)] + [(1000 + k, "hot words here", "l000") for k in range(500)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert len(model.languages) == 300
    got = {r.doc_id: r.lang_pred for r in langid.predict(train, model).collect()}
    assert all(got[k] == f"l{k:03d}" for k in range(1, 300))
    monkeypatch.setattr(langid, "WORDS", 2)
    monkeypatch.setattr(langid, "GRAMS", 3)
    texts = [(k, "the the the and and of", "en") for k in range(3)] + [(9, "der die das", "de")]
    model = langid.fit(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    assert {"the", "and"} <= set(model.index[0]) and "of" not in model.index[0]


# --- toxicity ----------------------------------------------------------------


def test_toxicity_of_held_out_documents(spark):
    rows = QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    pairs = [(s, t) for s, y in held if y for t, z in held if not z]
    assert sum((s > t) + 0.5 * (s == t) for s, t in pairs) >= 0.85 * len(pairs)
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_of_odd_documents_and_labels(spark):
    docs = docs_of(spark, [(k, "you are a vile one" if k % 2 else "a fine day it is") for k in range(80)] + [(90, None), (91, ""), (92, "V1LE you"), (92, "V1LE you")])
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(None, 1), (5, None), (7, 0)], "doc_id long, toxic int")
    got = defaultdict(set)
    for r in toxicity.classify(docs.withColumn("score", F.lit("clash")), labels).collect():
        got[r.doc_id].add(r.score)
    assert min(min(got[k]) for k in range(1, 80, 2)) > max(max(got[k]) for k in range(0, 80, 2))
    assert all(0 <= s <= 1 for v in got.values() for s in v) and len(got[92]) == 1
    assert {r.score for r in toxicity.classify(docs, labels.where("false")).collect()} == {0.0}
    assert {r.score for r in toxicity.classify(docs, labels.where("toxic = 1")).collect()} == {1.0}
    assert toxicity.classify(docs.where("false"), labels).count() == 0


def test_toxicity_features_of_one_very_long_word():
    features = toxicity._features({"vile": 1.0})
    began = time.monotonic()
    found = dict(zip(toxicity.FEATURES, features("x" * 300_000 + " v1le"), strict=True))
    assert time.monotonic() - began < 5
    assert found["mixed"] == 100 / 3 and found["disguised"] == 1.0 and found["terms"] == 0.0


# --- personal data -----------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def row_of(text):
    spans = base(text)
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return (*[sum(s[0] == k for s in spans) for k in PATTERNS], hashlib.sha256(joined.encode()).hexdigest())


def test_base_spans_are_those_of_the_patterns(spark):
    rng = random.Random(2)
    bits = ["a@b.co", "x_y@z.w.v", "@", ".", "1.2.3.4", "300.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234567", "+1", "é", "𝒳", " ", "\n", "-", "5", "12", "word"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.choice([1, 4, 30])))) for k in range(1500)]
    rows += [(-1, None), (-2, ""), (-3, "7" * 3_000), (-4, "a" * 3_000), (-5, "1 " * 20_000), (-6, "a@b.c_d@e.f,g@h.i"), (None, "1.2.3.4"), (-7, "x 1.2.3.4")] * 2
    # Long runs, on which the patterns as written would take time in the square of their length, hold nothing.
    long = [(-8, "a" * 200_000), (-9, "7" * 200_000)]
    found = pii.find(docs_of(spark, rows + long).withColumn("spans", F.lit("clash")).withColumn("base", F.lit(1))).collect()
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found)
    known = {t: row_of(t) for t in {t for _, t in rows}}
    assert got == Counter([(d, *known[t]) for d, t in rows] + [(d, *row_of("")) for d, _ in long])
    texts = dict(rows) | dict.fromkeys([d for d, _ in long])
    for r in found:
        spans = [s for s in r.spans.split(",") if s]
        assert set(spans) >= {f"{k}:{a}:{b}" for k, a, b in base(texts[r.doc_id])}
    assert pii.find(docs_of(spark, rows).where("false")).count() == 0


def test_contexts_of_seeds_find_what_no_pattern_knows(spark):
    seeds = [(k, f"Noted. Reach me by private line: +49 30 12345{k:02d} today") for k in range(12)]
    unseen = [(50, "So my private line: 0049.30.998877 is new"), (51, "version number: 2024 is fine"), (52, "some private line: hello")]
    found = {r.doc_id: r.spans for r in pii.find(docs_of(spark, seeds + unseen)).collect()}
    assert found[50] == "phone:20:34" and found[51] == "" and found[52] == ""
    assert all(found[k].count(",") == 0 for k in range(12))


def test_contexts_reach_over_tokens_and_to_the_start(spark):
    seeds = [(k, f"ID: 10{k} SSN: +49 30 12345{k:02d}") for k in range(12)] + [(20 + k, f"+49 30 22345{k:02d} home") for k in range(12)]
    unseen = [(50, "ID: 123456 SSN: 123-45-6789"), (51, "0049.30.998877 home"), (52, "Page: 123456 of: 123-45-6789")]
    found = {r.doc_id: r.spans for r in pii.find(docs_of(spark, seeds + unseen)).collect()}
    assert found[50] == "phone:16:27" and found[51] == "phone:0:14" and found[52] == ""


def test_what_a_context_found_leads_to_further_contexts(spark):
    seeds = [(k, f"Reach me by private line: +49 30 12345{k:02d} today") for k in range(40)]
    first = [(100 + k, f"So my private line: 0049.30.99887{k} is new") for k in range(6)]
    second = [(200 + k, f"See the fax desk: 0049.30.99887{k} again") for k in range(6)] + [(300, "See the fax desk: 0049.30.111222 again")]
    found = {r.doc_id: r.spans for r in pii.find(docs_of(spark, seeds + first + second)).collect()}
    assert all(found[100 + k] == "phone:20:34" and found[200 + k] == "phone:18:32" for k in range(6))
    assert found[300] == "phone:18:32"


def test_a_context_of_one_third_seeds_marks_nothing(spark):
    rows = [(k, f"on the order number: +49 30 12345{k:02d} today") for k in range(3)] + [(10 + k, f"on the order number: 77100{k} today") for k in range(6)]
    found = {r.doc_id: r.spans for r in pii.find(docs_of(spark, rows)).collect()}
    assert all(found[10 + k] == "" for k in range(6))


def brute_patterns(edges):
    """Contexts and scores by the rounds that ``pii._patterns`` describes, with dictionaries."""
    nodes: dict = {}
    for form, words, token, kind in edges:
        known = nodes.setdefault((form, words), {})
        kinds = [k for k in (kind, known.get(token)) if k is not None]
        known[token] = max(kinds) if kinds else None
    trusted: dict = {}
    shaped = lambda t: sum(c.isdigit() for c in t) >= 4 or "@" in t
    while True:
        found: dict = {}
        for c, tokens in nodes.items():
            for t, k in tokens.items():
                if k is None and shaped(t) and c in trusted:
                    found[t] = min(found.get(t, 9), trusted[c][0])
        known = {c: {t: found.get(t) if k is None else k for t, k in tokens.items()} for c, tokens in nodes.items()}
        shares = {}
        for c, tokens in known.items():
            counts = Counter(k for k in tokens.values() if k is not None and k >= 0)
            if counts and max(counts.values()) >= pii.SUPPORT:
                n, kind = max((n, -k) for k, n in counts.items())
                shares[c] = (-kind, n, trusted[c][1] if c in trusted else n / len(tokens))
        added = {}
        for c, (kind, seeds, _) in shares.items():
            if c in trusted:
                continue
            others = lambda t, c=c, kind=kind: [s[2] for d, s in shares.items() if d != c and d[0] == c[0] and s[0] == kind and known[d].get(t, 0) is None]
            lent = sum(max(others(t), default=0) for t, k in known[c].items() if k is None)
            if (score := (seeds + lent) / len(known[c])) >= pii.CONFIDENCE:
                added[c] = (kind, score)
        if not added:
            return trusted
        trusted |= added


def test_scores_of_contexts_are_those_of_brute_force(spark):
    rng = random.Random(9)
    edges = []
    for _ in range(1500):
        form, words = rng.choice(["L1", "L2"]), f"c{int(rng.paretovariate(0.8)) % 25}"
        token = rng.choice([f"{rng.randrange(1000, 1080)}", f"x{rng.randrange(9)}"])
        # A token has one kind, or none; contexts of the lower numbers hold seeds mostly.
        edges.append((form, words, token, {0: 1, 1: 1, 2: 1, 3: 0, 4: -1}.get(int(token[-1])) if len(token) == 4 else None))
    edges += [("L1", f"good{k}", str(2000 + t), 1 if t % 10 else None) for k in range(3) for t in range(k, 40)] + [("L1", "next", str(2000 + t), None) for t in (0, 10, 20, 30)]
    df = spark.createDataFrame(edges, "form string, words string, token string, kind int").repartition(3)
    got = {(r.form, r.words): (r.kind, pytest.approx(r.confidence)) for r in pii._patterns(df).collect()}
    expected = brute_patterns(edges)
    assert got == expected and ("L1", "next") in expected


def test_unseen_identifiers_in_known_contexts_are_found(spark):
    """Recall over identifiers that no base pattern knows, among text of other numbers."""
    rng = random.Random(10)
    words = [f"wort{k}" for k in range(400)]
    prose = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(3, 25)))
    leads = [("phone", "call me on"), ("phone", "Tel. privat:"), ("email", "mail address is"), ("card", "card ending, number")]
    seeds = {"phone": lambda: f"+49 30 {rng.randrange(10**6, 10**7)}", "email": lambda: f"u{rng.randrange(10**6)}@mail.org", "card": lambda: next(c for c in iter(lambda: str(rng.randrange(10**15, 10**16)), "") if luhn(c))}
    unseen = {"phone": lambda: f"0{rng.randrange(100, 999)}/{rng.randrange(10**5, 10**6)}", "email": lambda: f"user{rng.randrange(10**4)}@localhost", "card": lambda: f"x{rng.randrange(1000, 9999)}-{rng.randrange(1000, 9999)}"}
    rows, planted = [], {}
    for doc in range(600):
        kind, lead = rng.choice(leads)
        new = doc % 12 == 0
        value = (unseen if new else seeds)[kind]()
        rows.append((doc, f"{prose()} in {rng.randrange(1000, 3000)} {prose()} {lead} {value} {prose()}"))
        if new:
            start = rows[-1][1].index(f"{lead} {value}") + len(lead) + 1
            planted[doc] = f"{kind}:{start}:{start + len(value)}"
    found = {r.doc_id: r for r in pii.find(docs_of(spark, rows)).collect()}
    caught = sum(planted[d] in found[d].spans.split(",") for d in planted)
    assert caught >= 0.9 * len(planted)
    extra = [d for d, r in found.items() if r.n_found > 1]
    assert len(extra) <= 0.01 * len(rows)  # the other numbers are left alone
    assert all(r.n_found == len([s for s in r.spans.split(",") if s]) for r in found.values())


def test_keys_are_secrets_where_a_context_says_so(spark):
    key = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    rows = [(k, f'nothing token = "{key(k)}" here{k}') for k in range(6)] + [(50, f"the file's hash {key(99)} is fine"), (51, 'my token = "abcd-1234-5678" too'), (52, "a card 4111 1111 1111 1112 refused")]
    rows += [(60 + k, f"pay by 411111111111111{k} now") for k in range(10)]
    found = {r.doc_id: r.spans for r in pii.find(docs_of(spark, rows)).collect()}
    assert all(found[k] == "secret:17:57" for k in range(6))
    assert found[50] == "" and found[51] == "secret:12:26" and found[52] == ""
    assert [bool(found[60 + k]) for k in range(10)] == [luhn(f"411111111111111{k}") for k in range(10)]


def test_very_many_numbers_in_one_text(spark):
    numbers = [str(10_000 + k) for k in range(20_000)]
    text = " ".join(["a@b.co", *numbers, "1.2.3.4"])
    row = pii.find(docs_of(spark, [(1, text)])).first()
    assert row.n_email == 1 and row.n_ip == 1 and row.base_sha256 == row_of(text)[-1]


# --- URLs ----------------------------------------------------------------------


def test_verdicts(spark):
    urls = ["http://A.net/x", "https://m.example.net/en/1?a#b", "http://example.net/english", "ftp://de.Example.com/de/", "http://notexample.com/de/", "http://x.org/fr/", "http://x.org/fr", "http://net", "no scheme", None, "http://h.org/p?://q", "://", "http://www.twin.io/a/", "http://twin.io/a?b", "HTTP://lone.io/a"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(0, urls[0], None)], "page_id long, url string, rule string")
    given = spark.createDataFrame([("https://m.twin.io/a#x",), ("nonsense",), (None,), ("http://twin.io/a",), ("http://never.seen/",), ("http://www.x.org/fr",)], "url string")
    listed = url_filter.entries(given)
    assert sorted(r.canon for r in listed.collect()) == ["never.seen", "twin.io/a", "x.org/fr"]
    rows = url_filter.judge(pages, listed, RULES).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(urls) + 1
    assert [got[k][3] for k in range(len(urls))] == ["block", "allow", "block", "block", "allow", "allow", "block", "allow", "allow", "allow", "allow", "allow", "block", "block", "allow"]
    assert [got[k][2] for k in range(8)] == ["net/", "example.net/en/", "net/", "example.com/de/", None, "org/fr/", None, None]
    assert got[1][:2] == ("m.example.net", "/en/1") and got[8][:2] == ("", "") and got[9][:2] == ("", "") and got[10][:2] == ("h.org", "/p")
    assert url_filter.judge(pages.where("false"), listed, RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, listed.where("false"), []).collect()} == {"allow"}


def test_the_pages_of_spam_hosts_are_listed(spark):
    urls = ["http://www.spam-farm.example.com/a", "http://x.spam/b", "http://no-spammer.org/c", "http://spam.org:80/d", None, "spam", "http://ham.org/spam"]
    found = url_filter.spam(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    assert {r.url for r in found} == {*urls[:2], urls[3]}


def test_a_filter_too_large_to_broadcast_is_joined(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_BLOCKS", 1)
    keys, rows = spark.range(0, 3000, 3).toDF("k"), spark.range(3000).toDF("k").unionByName(spark.createDataFrame([(None,)], "k long"))
    probed = common.may_hold(rows, "k", keys, "may")
    assert "broadcast" not in probed._jdf.queryExecution().logical().toString()  # no hint; that the planner may still broadcast what it knows to be small is its own choice
    found = probed.collect()
    assert len(found) == 3001 and all(r.may for r in found if r.k is not None and r.k % 3 == 0) and sum(r.may for r in found) < 1100


# --- WARC -----------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def test_payloads_survive_the_archive(spark, tmp_path, monkeypatch):
    big = "".join(random.Random(3).choice("aé漢𝒳\r\n<") for _ in range(100_000))
    rows = [(1, "http://a/", "x"), (2, "http://b/\r\n", big), (3, None, big), (4, "u", ""), (5, "u", None), (6, "u", "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n"), (0, "z", "x"), (None, "n", "x"), (7, "u", "y"), (7, "u", "y")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit("clash")).repartition(3)
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    expected = Counter()
    for p, _, h in rows:
        data = (h or "").encode()
        again = p is not None and first[h or ""] != p
        expected[p, len(data), warc.digest(data), "revisit" if again else "response", first[h or ""] if again else None] += 1
    found = warc.round_trip(pages).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == expected

    folder = str(tmp_path / "archive")
    warc.write(pages, folder, least=5)
    read = warc.read_records(spark, folder).collect()
    whole = Counter((r.page_id, bytes(r.payload) if r.payload is not None else None) for r in read)
    assert whole[2, big.encode()] == 1 and whole[3, None] == 1 and whole[1, b"x"] == 1 and whole[0, b"x"] == 1
    data = b"".join(gzip.decompress(p.read_bytes()) for p in tmp_path.glob("archive/part-*"))
    kinds = Counter(f["warc-type"] for f, _ in warc.parse(data))
    assert kinds["continuation"] >= len(big.encode()) // warc.SEGMENT and kinds["revisit"] == 1


def test_a_missing_segment_is_an_error(spark, tmp_path):
    big = "x" * 100_000
    records = list(warc._records(1, "u", big.encode(), None))
    assert len(records) == 4
    (tmp_path / "part-0.warc").write_bytes(b"".join(r + warc.END.encode() for k, r in enumerate(records) if k != 2))
    with pytest.raises(Exception, match="segments"):
        warc.read_records(spark, str(tmp_path)).collect()
    assert [(r.payload, "segments" in r.error) for r in warc.read_records(spark, str(tmp_path), aside=True).collect()] == [(None, True)]
    (tmp_path / "part-0.warc").write_bytes(b"".join(r + warc.END.encode() for r in reversed(records)))
    assert bytes(warc.read_records(spark, str(tmp_path)).first().payload) == big.encode()


def test_archives_with_a_gzip_member_for_each_record(spark, tmp_path):
    records = [r for k in range(3) for r in warc._records(k, "u", f"page {k}".encode(), None)]
    (tmp_path / "part-0.warc.gz").write_bytes(b"".join(gzip.compress(r + warc.END.encode()) for r in records))
    assert {bytes(r.payload) for r in warc.read_records(spark, str(tmp_path)).collect()} == {b"page 0", b"page 1", b"page 2"}


def test_broken_records_are_errors_or_set_aside(spark, tmp_path):
    good = [next(warc._records(k, "u", f"page {k}".encode(), None)) for k in range(4)]
    wrong = good[1].replace(b"page 1", b"page 9")
    headless = b"WARC/1.1\r\nContent-Type: none\r\n\r\nlost"
    data = b"".join(r + warc.END.encode() for r in [good[0], wrong, headless, good[2], b"WARC/1.1\r\nno colon\r\n\r\n", good[3]])
    (tmp_path / "crawl.warc.gz").write_bytes(gzip.compress(data) + gzip.compress(good[0][:-9]))
    with pytest.raises(Exception, match="digest|header"):
        warc.read_records(spark, str(tmp_path)).collect()
    rows = warc.read_records(spark, str(tmp_path), aside=True).collect()
    assert {bytes(r.payload) for r in rows if r.error is None} == {b"page 0", b"page 2", b"page 3"}
    assert len([r for r in rows if r.error is not None]) == 4


def test_archives_are_read_as_streams():
    records = [r for k in range(30) for r in warc._records(k, "u", (f"page {k}" + "\r\n\r\n" * (k % 4)).encode() * 3_000, None)]
    data = b"".join(r + warc.END.encode() for r in records)
    for size in (1, 7, 4_096):
        some = data if size > 1 else data[: len(records[0]) + len(records[1]) + 8]
        chunks = (some[k : k + size] for k in range(0, len(some), size))
        assert [b"".join(block for _, block in warc.parse_stream(chunks))] == [b"".join(block for _, block in warc.parse(some))]


@pytest.mark.parametrize("payload", [b"", b"a", b"x" * 10_000, b"\r\n0\r\n\r\n"])
def test_chunks(payload):
    assert warc.dechunk(warc.chunked(payload, 7)) == payload
    with pytest.raises(ValueError):
        warc.dechunk(warc.chunked(payload + b"abc", 7)[:-9])


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


# --- pipeline ---------------------------------------------------------------------


def test_pipeline_stages_keep_the_columns_and_do_their_work(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if name != "sharding":
            assert docs.columns == columns
    first, deduped, clean, mixed, sharded = counts
    assert 200 >= first > deduped >= clean > 0 and sharded == mixed
    items = {plain(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    assert not any(b in plain(r.text) for r in spark.read.parquet(str(tmp_path / "3")).collect() for b in items)
    shards = spark.read.parquet(str(tmp_path / "4"))
    assert shards.columns == [*columns, "shard", "slot"]
    texts = lambda k: Counter((r.doc_id, r.text, r.source) for r in spark.read.parquet(str(tmp_path / str(k))).collect())
    assert texts(3) == texts(4)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_pipeline_of_no_documents(spark, data, tmp_path):
    spark.read.parquet(f"{data}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
