from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ferrule.functions import text as X
from ferrule.operators import graph, intervals, ordered, relational, search


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("calculateTotal", ["calculatetotal", "calculate", "total"]),
        ("max_retry_count", ["max_retry_count", "max", "retry", "count"]),
        ("HTTPServer2", ["httpserver2", "http", "server", "2"]),
        ("the value of it", ["value"]),
        ("isValid", ["isvalid", "valid"]),
        ("", []),
    ],
)
def test_tokens(spark, value, expected):
    assert one(spark, X.tokens(F.col("t")), value) == expected


def test_null_text_has_no_tokens(spark):
    assert one(spark, X.tokens(F.col("t")), None) is None


@pytest.mark.parametrize(("value", "expected"), [("", 0), ("a", 1), ("abcd", 2), ("x" * 35, 10)])
def test_estimate_tokens(spark, value, expected):
    assert one(spark, X.estimate_tokens(F.col("t")), value) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("Adds {@code a}. Then more.", "Adds a."),
        ("Sums up\n  @param x what", "Sums up"),
        ("<p>One</p> two! three", "One two!"),
        ("no end", "no end"),
        (". Then. more", ". Then."),
        ("a . b", "a ."),
        ("one<br>two <b>x</b>! y", "one two x !"),
        ("", ""),
        (None, None),
    ],
)
def test_first_sentence(spark, value, expected):
    assert one(spark, X.first_sentence(F.col("t")), value) == expected


@pytest.mark.parametrize(("value", "expected"), [('"a"', "String"), ('"a\\"b"', "String"), ('"a" + "b"', None), ("'a'", "char"), ("'\\n'", "char"), ("''", None), ("true", "boolean"), ("10L", "long"), ("10", "int"), ("+5", "int"), (" 7\n", "int"), ("1.5f", "float"), ("5f", None), ("1.5", "double"), ("5.", "double"), (".5d", "double"), ("x", None), ("", None), (None, None)])
def test_literal_type(spark, value, expected):
    assert one(spark, X.literal_type(F.col("t")), value) == expected


def test_content_id_tells_null_from_empty(spark):
    rows = spark.createDataFrame([(None,), ("",)], "t string").select(X.content_id(F.col("t")).alias("x")).collect()
    assert len({r.x for r in rows}) == 2


def test_bm25_is_the_formula(spark):
    texts = {1: "read file", 2: "read read cache", 3: "write cache line", 4: None, 5: "the of"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    split = {k: (v or "").split() if v != "the of" else [] for k, v in texts.items()}
    # A null text is no document of tokens: its length is unknown and leaves the average alone.
    lengths = [len(v) for k, v in split.items() if texts[k] is not None]
    n, avg = len(texts), sum(lengths) / len(lengths)
    expected = {}
    for term in ("read", "cache"):
        df = sum(term in v for v in split.values())
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
        for k, v in split.items():
            if tf := Counter(v)[term]:
                expected[k] = expected.get(k, 0) + idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(v) / avg))
    got = {r.doc_id: r.score for r in search.bm25(docs, "cache read read").collect()}
    assert got == pytest.approx(expected, abs=1e-8)


def test_bm25_without_a_known_token(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert search.bm25(docs, "zebra").count() == 0
    assert search.bm25(docs, "the").count() == 0


def test_fuse_leaves_an_empty_leg_out(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "doc_id long, rank int")
    b = spark.createDataFrame([(2, 1)], "doc_id long, rank int")
    empty = spark.createDataFrame([], "doc_id long, rank int")
    got = {r.doc_id: r.score for r in search.fuse([a, b, empty]).collect()}
    assert got == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61})


@pytest.mark.parametrize(
    ("where", "expected"),
    [
        ({}, [1, 2, 3]),
        ({"lang": "en"}, [1]),
        ({"lang": {"$ne": "en"}}, [2, 3]),
        ({"lang": {"$in": ["en", None]}}, [1, 3]),
        ({"$or": [{"lang": "en"}, {"n": 2}]}, [1, 2]),
        ({"$and": [{"lang": "de"}, {"n": {"$eq": 3}}]}, []),
        ({"$or": []}, []),
    ],
)
def test_condition(spark, where, expected):
    df = spark.createDataFrame([("en", 1), ("de", 2), (None, 3)], "lang string, n int")
    assert sorted(r.n for r in df.where(search.condition(where)).collect()) == expected


def test_greedy_fill_skips_and_goes_on(spark):
    items = spark.createDataFrame([("g", 1, 60), ("g", 2, 50), ("g", 3, 30), ("h", 1, 200)], "g string, id int, cost int")
    got = {(r.g, r.id): r.taken for r in ordered.greedy_fill(items, ["g"], "id", "cost", ["id"], F.lit(100)).collect()}
    assert got == {("g", 1): True, ("g", 2): False, ("g", 3): True, ("h", 1): False}


def test_islands_and_labels(spark):
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate(["a", "a", "b", "a", None, None])], "g int, t int, kind string")
    assert [r.island for r in ordered.islands(rows, ["g"], "t", "kind").orderBy("t").collect()] == [1, 1, 2, 3, 4, 4]
    assert [r.label for r in ordered.labels(rows, ["kind"], ["g"], "t").orderBy("t").collect()] == ["E1", "E1", "E2", "E1", "E3", "E3"]


EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 6)]


def test_reach_ends_on_cycles_and_leaves_the_start_out(spark):
    edges = spark.createDataFrame(EDGES, "src long, dst long")
    starts = spark.createDataFrame([(1,), (6,)], "start long")
    got = {(r.start, r.node): r.depth for r in graph.reach(edges, starts, 9).collect()}
    assert got == {(1, 2): 1, (1, 3): 2, (1, 4): 3, (1, 5): 4}


def test_cycles_and_shortest_paths(spark):
    edges = spark.createDataFrame([*EDGES, (1, 4), (2, 5)], "src long, dst long")
    assert sorted(r.node for r in graph.on_cycle(edges).collect()) == [1, 2, 3, 6]
    got = {r.node: r.path for r in graph.shortest_paths(edges, spark.createDataFrame([(1,)], "start long"), 5).collect()}
    assert got == {2: [1, 2], 4: [1, 4], 3: [1, 2, 3], 5: [1, 2, 5]}


def test_nodes_on_cycles_are_those_of_brute_force(spark):
    rng = random.Random(3)
    for n, m in ((30, 30), (40, 60), (25, 80)):
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        paths = set(pairs)
        while longer := {(a, d) for a, b in paths for c, d in pairs if b == c} - paths:
            paths |= longer
        edges = spark.createDataFrame([*pairs, (None, 1)], "src long, dst long")
        assert sorted(r.node for r in graph.on_cycle(edges).collect()) == sorted(a for a, b in paths if a == b)


def test_preorder_of_trees(spark):
    rows = [("t", 1, None, 0), ("t", 2, 1, 5), ("t", 3, 1, 2), ("t", 4, 3, 0), ("t", 5, None, 1), ("u", 1, None, 0), ("u", 2, 3, 0), ("u", 3, 2, 0)]
    found = graph.preorder(spark.createDataFrame(rows, "tree string, id int, parent int, o int"), "tree", "id", "parent", "o").collect()
    assert {(r.tree, r.id, r.depth, r.ord) for r in found} == {("t", 1, 0, 1), ("t", 3, 1, 2), ("t", 4, 2, 3), ("t", 2, 1, 4), ("t", 5, 0, 5), ("u", 1, 0, 1)}


@pytest.mark.parametrize("n", [1, 5, 12, 100])
def test_text_is_cut_between_lines(spark, n):
    text = "\n".join("x" * k for k in (3, 0, 10, 25, 4, 60))
    got = one(spark, X.cut_to_tokens(F.col("t"), F.lit(n)), text)
    room, kept = max(0, int(n * 3.5) - len("[... truncated]") - 1), []
    for line in text.split("\n"):
        if sum(map(len, kept)) + len(kept) + len(line) + 1 > room:
            break
        kept.append(line)
    cut = math.ceil(len(text) / 3.5) > n
    assert (got.text, got.cut) == ("\n".join([*kept, f"[... truncated] ({6 - len(kept)} more lines)"]) if cut else text, cut)


def test_graph_operators_take_empty_tables(spark):
    edges = spark.createDataFrame([], "src long, dst long")
    starts = spark.createDataFrame([(1,)], "start long")
    assert graph.reach(edges, starts, 3).count() == 0
    assert graph.on_cycle(edges).count() == 0
    assert graph.shortest_paths(edges, starts, 3).count() == 0


def test_interval_operators(spark):
    rows = spark.createDataFrame([("a", 1, 0, 10), ("a", 2, 2, 5), ("a", 3, 2, 5), ("b", 4, 2, 5)], "k string, id int, start int, end int")
    pairs = {(r[0], r[1]) for r in intervals.containing(rows, rows, ["k"]).select("a.id", "b.id").collect()}
    assert pairs == {(2, 1), (3, 1)}
    assert {r.id for r in intervals.outermost(rows, ["k"]).collect()} == {1, 4}
    points = spark.createDataFrame([("a", 7, 3), ("a", 8, 9), ("c", 9, 1)], "k string, p int, at int")
    scopes = rows.withColumn("ord", F.col("id"))
    found = {r[0]: r[1] for r in intervals.innermost(points, scopes, ["k"], ["p"]).select("a.p", "b.id").collect()}
    assert found == {7: 3, 8: 1, 9: None}
    with pytest.raises(ValueError, match="equi key"):
        intervals.near(rows, rows, [])


def test_interval_joins_never_compare_all_with_all(spark):
    rows = spark.createDataFrame([("a", 1, 0, 10)], "k string, id int, start int, end int")
    plan = intervals.containing(rows, rows, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Cartesian|NestedLoop", plan)


def test_snapshot_diff_and_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "k int, h string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (5, "e")], "k int, h string")
    status = {r.k: r.status for r in relational.snapshot_diff(old, new, "k", "h").collect()}
    assert status == {1: "unchanged", 2: "changed", 3: "unchanged", 4: "removed", 5: "added"}
    touched, removed = new.where("k in (2, 5)"), old.where("k = 4")
    assert {(r.k, r.h) for r in relational.upsert(old, touched, removed, "k").collect()} == {(r.k, r.h) for r in new.collect()}


def test_resolve_keeps_every_reference(spark):
    refs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, ref string")
    known = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y")], "name string, target string")
    got = {r.id: (r.status, r.targets) for r in relational.resolve(refs, "ref", known, "name", "target").collect()}
    assert got == {1: ("resolved", ["x"]), 2: ("ambiguous", ["x", "y"]), 3: ("unresolved", []), 4: ("unresolved", [])}


def test_ladder_takes_the_first_branch_that_has_any(spark):
    a = spark.createDataFrame([(1, "local")], "ref int, what string")
    b = spark.createDataFrame([(1, "field"), (2, "field"), (2, "other")], "ref int, what string")
    assert {(r.ref, r.what, r.priority) for r in relational.ladder([a, b], "ref").collect()} == {(1, "local", 0), (2, "field", 1), (2, "other", 1)}


def test_multiset_match(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "k string")
    b = spark.createDataFrame([("x",), ("z",), ("z",)], "k string")
    got = {r.k: (r.expected, r.found, r.extra) for r in relational.multiset_match(a, b, ["k"]).collect()}
    assert got == {"x": (2, 1, 0), "y": (1, 0, 0), "z": (0, 0, 2)}


def test_cosine_of_a_zero_vector(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.score for r in search.cosine(rows, rows.where("vec_id = 2")).collect()}
    assert got == {1: 0.0, 2: 1.0}


def test_reach_moves_lists_of_neighbours_not_steps(spark):
    """In a dense graph the rows that a level deals are those of the frontier's lists, not one for each step."""
    nodes = spark.range(60)
    edges = nodes.select(F.col("id").alias("src")).crossJoin(nodes.select(F.col("id").alias("dst"))).where("src <> dst")
    found = graph.reach(edges, nodes.select(F.col("id").alias("start")), 2)
    assert sorted(map(tuple, found.collect())) == sorted((a, b, 1) for a in range(60) for b in range(60) if a != b)
    long = graph.reach(edges.limit(0).unionByName(spark.range(1, 2501).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))), spark.createDataFrame([(0,)], "start long"), 1)
    assert long.count() == long.select("node").distinct().count() == 2500


def test_reach_holds_a_row_for_each_node_and_block_of_starts(spark, monkeypatch):
    rows = []
    for name in ("durable", "written"):
        if hasattr(graph, name):
            whole = getattr(graph, name)
            monkeypatch.setattr(graph, name, lambda df, whole=whole: rows.append((kept := whole(df)).count()) or kept)
    nodes = spark.range(60)
    edges = nodes.select(F.col("id").alias("src")).crossJoin(nodes.select(F.col("id").alias("dst")))
    assert graph.reach(edges, nodes.select(F.col("id").alias("start")), 2).count() == 60 * 59
    assert max(rows) <= 60
    # Starts of several blocks, all bits of a long, nodes that are structs, and starts that are null or no nodes.
    node = lambda k: F.struct((F.pmod(k, F.lit(150))).alias("a"), F.lit("x").alias("b"))
    ring = spark.range(150).select(node(F.col("id")).alias("src"), node(F.col("id") + 1).alias("dst"))
    starts = spark.range(200).select(F.when(F.col("id") < 150, node(F.col("id"))).when(F.col("id") < 190, F.struct(F.col("id").alias("a"), F.lit("y").alias("b"))).alias("start"))
    got = {(r.start.a, r.node.a, r.depth) for r in graph.reach(ring, starts, 3).collect()}
    assert got == {(k, (k + d) % 150, d) for k in range(150) for d in (1, 2, 3)}
