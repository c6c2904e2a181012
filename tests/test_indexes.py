"""Indexes: trained cells of vectors, and postings kept up to date."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.operators import neighbours as N
from ferrule.operators import search
from ferrule.streaming import postings as P

VECTORS = "vec_id long, embedding array<double>, label int"


def exact(rows, k=10, keep=lambda label: True):
    """(query_id, vec_id) by brute force over unit vectors."""
    fine = [(i, np.array(v), label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    units = {i: v / (np.linalg.norm(v) or 1) for i, v, _ in fine}
    out = {}
    for q in units:
        scored = sorted((-round(float(units[q] @ units[i]), 9), i) for i, _, label in fine if i != q and keep(label))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def clustered(n, seed=1, d=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, d)) * 3
    rows = [(k, (centres[min(k % 17, 8)] + rng.normal(size=d)).tolist(), k % 4) for k in range(n)]  # one cluster holds half of all
    return [*rows, (n, [0.0] * d, 1), (n + 1, None, 1), (n + 2, [float("nan")] * d, 1), (n + 3, rows[0][1], 2)]


@pytest.mark.parametrize("sizes", [(8192, 512), (16, 5)])
def test_all_cells_are_exact_and_blocks_change_nothing(spark, monkeypatch, sizes):
    monkeypatch.setattr(N, "BLOCK", sizes[0])
    monkeypatch.setattr(N, "ASKED", sizes[1])
    rows = clustered(300)
    vectors = spark.createDataFrame(rows, VECTORS).repartition(3)
    index = N.build(vectors, cells=6)
    asked = vectors.withColumnRenamed("vec_id", "query_id").where("query_id % 9 = 0 or query_id >= 300")
    want = exact(rows)
    got = {}
    for r in N.search(index, asked, probes=6).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {q for q in want if q % 9 == 0 or q >= 300}
    for q, found in got.items():
        assert [found[k + 1] for k in range(10)] == [(i, pytest.approx(s, abs=2e-9)) for i, s in want[q]]
    some = exact(rows, keep=lambda label: label != 2)
    filtered = N.search(index, asked, probes=6, where=search.condition({"label": {"$ne": 2}})).collect()
    assert {(r.query_id, r.vec_id) for r in filtered} == {(q, i) for q in got for i, _ in some[q]}


def test_probed_cells_find_most_neighbours(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    index = N.build(vectors)
    whole = N.search(index, asked, probes=64).cache()
    assert N.recall(whole, whole) == 1.0
    assert N.recall(N.search(index, asked), whole) >= 0.9
    few = N.probes_for(index, asked.where("query_id % 40 = 0"), 0.5)
    assert 1 < few < 30 and 0.4 < N.recall(N.search(index, asked, probes=few), whole) < 0.65


def test_replacing_vectors_and_an_empty_index(spark):
    rows = clustered(60)
    vectors = spark.createDataFrame(rows, VECTORS)
    moved = [(5, rows[6][1], 9), (1000, rows[6][1], 9)]
    index = N.replace(N.build(vectors, cells=4), spark.createDataFrame(moved, VECTORS), vectors.where("vec_id = 7").select("vec_id"))
    found = N.search(index, spark.createDataFrame([(6, rows[6][1])], "query_id long, embedding array<double>"), k=2, probes=4).collect()
    assert [(r.vec_id, r.rank) for r in sorted(found)] == [(5, 1), (1000, 2)]
    assert index.vectors.where("vec_id = 7").isEmpty() and index.vectors.count() == 62
    empty = N.build(vectors.where("false"))
    assert N.search(empty, vectors.withColumnRenamed("vec_id", "query_id")).isEmpty()


# --- postings --------------------------------------------------------------------

VERSIONS = "id long, ts timestamp, text string"
WORDS = ["alpha", "beta", "gamma", "getUserName", "delta", "x1", "the", "epsilon"]


def at(k):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k)


def last(versions):
    """The texts that are left of versions, by the rule of the index."""
    import hashlib

    best = {}
    for i, ts, text in versions:
        mark = hashlib.md5(text.encode()).hexdigest() if text is not None else ""
        best[i] = max(best.get(i, (ts, "", None)), (ts, mark, text), key=lambda v: v[:2])
    return [(i, text) for i, (_, _, text) in best.items() if text is not None]


def same_index(spark, root, versions):
    docs = spark.createDataFrame(last(versions), "doc_id long, text string")
    want = {(r.term, r.doc_id, r.tf) for r in search.postings(docs).collect()}
    assert {(r.term, r.id, r.tf) for r in P.live(spark, root).collect()} == want
    query = "alpha getUserName delta nowhere"
    scores = {r.doc_id: r.score for r in search.bm25(docs, query).collect()}
    assert {r.id: r.score for r in P.search(spark, root, query).collect()} == pytest.approx(scores, abs=1e-8)


def test_any_order_of_versions_equals_a_rebuild(spark, tmp_path):
    rng = random.Random(4)
    versions = [(rng.randrange(25), at(rng.randrange(40)), rng.choice([None, "", *[" ".join(rng.choices(WORDS, k=rng.randrange(1, 9))) for _ in range(6)]])) for _ in range(80)]
    roots = []
    for order in range(2):
        rng.shuffle(versions)
        root = str(tmp_path / str(order))
        for number, k in enumerate(range(0, 80, 30)):
            P.apply(spark.createDataFrame(versions[k : k + 30], VERSIONS), number, root)
        P.apply(spark.createDataFrame(versions[60:], VERSIONS), 2, root)  # tried again
        same_index(spark, root, versions)
        roots.append(root)
    P.apply(spark.createDataFrame(versions[:50], VERSIONS), 3, roots[0])  # nothing new
    target = str(tmp_path / "compact")
    P.compact(spark, roots[0], target)
    same_index(spark, target, versions)
    more = [(3, at(100), "alpha alpha"), (4, at(100), None), (99, at(1), "delta")]
    P.apply(spark.createDataFrame(more, VERSIONS), 0, target)
    same_index(spark, target, versions + more)


def test_a_stream_feeds_the_index(spark, tmp_path):
    source, root, state = (str(tmp_path / x) for x in ("in", "root", "state"))
    schema = spark.createDataFrame([], VERSIONS).schema
    first, second = [(1, at(1), "alpha beta"), (2, at(1), "alpha")], [(1, at(2), None), (3, at(1), "beta delta"), (2, at(0), "gamma")]
    for rows in (first, second):
        spark.createDataFrame(rows, VERSIONS).coalesce(1).write.mode("append").parquet(source)
        P.follow(spark, source, schema, root, state).awaitTermination()
    same_index(spark, root, first + second)
    allowed = P.search(spark, root, "alpha beta", spark.createDataFrame([(3,)], "id long")).collect()
    assert [r.id for r in allowed] == [3]
    assert P.search(spark, str(tmp_path / "none"), "alpha").isEmpty()
    assert P.live(spark, root, ["alpha"]).select(F.max("tf")).first()[0] == 1


def test_a_batch_writes_no_copies_of_texts_and_deals_large_folders_in_parts(spark, tmp_path, monkeypatch):
    aside, whole = [], P.written
    monkeypatch.setattr(P, "written", lambda df: aside.append(df.columns) or whole(df))
    monkeypatch.setattr(P, "VERSIONS", 2, raising=False)
    monkeypatch.setattr(P, "POSTINGS", 3, raising=False)
    rng = random.Random(11)
    first, second = ([(rng.randrange(400), at(rng.randrange(40)), rng.choice([None, "", *[" ".join(rng.choices(WORDS, k=rng.randrange(1, 9))) for _ in range(6)]])) for _ in range(300)] for _ in range(2))
    removed = [(k, at(50), None) for k in range(0, 400, 3)]
    for number, batch in enumerate((first, second, [], removed)):
        P.apply(spark.createDataFrame(batch, VERSIONS), number, str(tmp_path))
    assert all(set(columns) <= {"id", "batch"} for columns in aside)
    monkeypatch.setattr(P, "written", whole)
    same_index(spark, str(tmp_path), first + second + removed)
