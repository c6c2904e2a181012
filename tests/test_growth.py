"""What keeps jobs in bounds as tables grow."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.functions.text import tokens
from ferrule.operators import codemodel, expressions, neighbours, search, unknowns
from ferrule.sources.tables import measured_joins, written
from ferrule.streaming import postings


def test_long_tables_in_small_files_are_not_broadcast(spark, monkeypatch):
    rows = written(spark.range(1_000_000).select("id", *[F.lit("x" * 500).alias(f"c{k}") for k in range(9)]))
    few = written(spark.range(5))
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(k, None) for k in names]

    def plan(other):
        df = rows.select("id").join(other.select("id"), "id")
        df.collect()
        return re.findall(r"\w+Join", df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])

    assert "BroadcastHashJoin" in plan(rows.select("id"))
    with measured_joins(spark):
        assert "BroadcastHashJoin" not in plan(rows.select("id")) and "BroadcastHashJoin" in plan(few)
    assert [spark.conf.get(k, None) for k in names] == before

    class Seen(Exception):
        pass

    def hierarchy(types):
        raise Seen(spark.conf.get(names[0]))

    monkeypatch.setattr(codemodel, "hierarchy", hierarchy)
    with pytest.raises(Seen, match="-1"):
        expressions.resolve_expressions(*[few] * 7)


@pytest.mark.parametrize("few", [0, 3, 64])
def test_literals_of_few_and_of_many_keys_end_alike(spark, monkeypatch, few):
    monkeypatch.setattr(unknowns, "FEW", few)
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab𝒳\n") for _ in range(n))
    literals = [(k, word(rng.randrange(5))) for k in range(9) for _ in range(k + 1)] + [(1, None)]
    texts = [(rng.randrange(10), word(rng.randrange(12))) for _ in range(15)] + [(2, None)]
    want = sorted(((k, x) for k, x in literals if x is None or not any(j == k and t is not None and x in t for j, t in texts)), key=str)
    got = unknowns.unexplained(spark.createDataFrame(literals, "method long, literal string"), spark.createDataFrame(texts, "method long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_scores_of_a_block_are_held_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=5).tolist()) for k in range(200)]
    rows += [(900 - k, rows[k][1]) for k in range(20)]  # equal scores go to the smaller id
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = neighbours.build(vectors, cells=3)
    asked = vectors.withColumnRenamed("vec_id", "query_id")
    whole = sorted(map(tuple, neighbours.search(index, asked, probes=3).collect()))
    monkeypatch.setattr(neighbours, "SCORES", 7)
    assert sorted(map(tuple, neighbours.search(index, asked, probes=3).collect())) == whole
    units = {k: np.array(v) / np.linalg.norm(v) for k, v in rows}
    for q in (0, 5, 150, 900):
        best = sorted((-round(float(units[q] @ units[k]), 9), k) for k in units if k != q)[:10]
        assert [r[2] for r in whole if r[0] == q] == [k for _, k in best]


def test_pairs_of_types_are_judged_once_whether_frequent_or_not(spark, monkeypatch):
    order = spark.createDataFrame([("A", "A", 0, True), ("A", "B", 1, True), ("B", "B", 0, True)], "cls string, ancestor string, ord int, known boolean")
    pairs = [("int", "int"), ("int", "B"), ("A", "B"), ("B", "A"), ("java.lang.String", "A"), ("lib.X", "A"), (None, "A"), ("null", "int"), ("A[]", "B[]"), ("A[]", "B")]
    rows = [(n, *p) for k, p in enumerate(pairs) for n in range(k * 20, k * 20 + k + 1)]
    fits = {("int", "int"): True, ("int", "B"): False, ("A", "B"): True, ("B", "A"): False, ("java.lang.String", "A"): False, ("lib.X", "A"): False, (None, "A"): True, ("null", "int"): False, ("A[]", "B[]"): True, ("A[]", "B"): False}
    for frequent in (0.5, 10, 1000):
        monkeypatch.setattr(codemodel, "FREQUENT", frequent)
        got = codemodel.assignable(spark.createDataFrame(rows, "id int, arg string, param string"), order).collect()
        assert sorted((r.id, r.arg, r.param, r.fits) for r in got) == [(n, a, p, fits[a, p]) for n, a, p in rows]


def test_texts_are_counted_where_they_are(spark):
    rng = random.Random(4)
    words = ["the", "The", "getURLFor", "a_the_b", "HTTPServer2x", "_", "__x", "état", "𝒳y", "license", "12ab34", "AAa", "version", "\n"]
    texts = [None, "", "the", *[rng.choice(" .é").join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(300)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {r.doc_id: r.t for r in docs.select("doc_id", tokens(F.col("text")).alias("t")).collect()}
    for r in search.counted(docs, "doc_id", hashes=True).collect():
        t = want[r.doc_id]
        assert r.len == (None if t is None else len(t)) and {x.term: x.tf for x in r.terms} == {x: t.count(x) for x in t or []}
        assert r.weights == [sum(s for b, s in map(search._bucket, t or []) if b == k) if any(search._bucket(x)[0] == k for x in t or []) else None for k in range(search.DIMENSION)]
    plan = search.hashed(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Exchange RoundRobin")  # that of the input
    query = "license version getURLFor the"
    for a, b in zip(search.legs(docs, query), (search.bm25(docs, query), search.hashed_cosine(docs, query)), strict=True):
        assert sorted(a.collect()) == sorted(b.collect()) and not b.isEmpty()


def test_a_batch_writes_few_files_however_many_tasks_it_has(spark, tmp_path):
    names = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": str(1 << 30)}
    before = {k: spark.conf.get(k) for k in names}
    docs = spark.range(1000).select("id", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), F.concat(F.lit("word x"), "id").alias("text"))
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        postings.apply(docs, 0, str(tmp_path))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for part in ("forward", "postings"):
        assert len(list(tmp_path.glob(f"{part}/batch=0/*/*.parquet"))) <= postings.BUCKETS
    assert postings.live(spark, str(tmp_path), ["word"]).count() == 1000
