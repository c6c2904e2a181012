"""Types in text, against trees that they were written from."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ferrule.functions.types import type_tree
from ferrule.operators.codemodel import resolve_texts


def written(rng, depth, wild=True):
    """A type as text, and its tree: (name, dims, args); no wildcard bounds another."""
    if wild and depth and rng.random() < 0.2:
        bound = written(rng, depth - 1, False) if rng.random() < 0.7 else None
        return (f"? {rng.choice(['extends', 'super'])} {bound[0]}", ("?", 0, [bound[1]])) if bound else ("?", ("?", 0, []))
    name = rng.choice(["int", "String", "a.b.C", "Map", "_x", "Größe", "A . B"])
    text, args = name, []
    if depth and rng.random() < 0.7:
        parts = [written(rng, depth - 1) for _ in range(rng.choice([1, 1, 2, 3]))]
        text += "<" + rng.choice([",", ", ", " ,\n"]).join(p[0] for p in parts) + ">"
        args = [p[1] for p in parts]
        if rng.random() < 0.2:
            text, name = text + ".In", name + ".In"
    dims = rng.choice([0, 0, 0, 1, 2])
    return text + "[]" * dims, (name.replace(" ", ""), dims, args)


def trees(nodes):
    of = lambda parent: [(n.name, n.dims, of(n.id)) for n in sorted(nodes, key=lambda n: n.pos) if n.parent == parent]
    return of(-1)


def test_trees_are_those_that_were_written(spark):
    rng = random.Random(2)
    cases = [written(rng, rng.randrange(4)) for _ in range(300)]
    texts = {t: [tree] for t, tree in cases if not t.startswith("?")} | {"A | b.B": [("A", 0, []), ("b.B", 0, [])], "int...": [("int", 1, [])], "@NotNull @A(x = 1) String": [("String", 0, [])], " T extends A & B<C> ": [("T", 0, [("A", 0, []), ("B", 0, [("C", 0, [])])])], "?": [("?", 0, [])], "Map<? extends A, ? super B[]>": [("Map", 0, [("?", 0, [("A", 0, [])]), ("?", 0, [("B", 1, [])])])], "A" + "<A" * 30 + ">" * 30: None}
    deep = ("A", 0, [])
    for _ in range(30):
        deep = ("A", 0, [deep])
    texts["A" + "<A" * 30 + ">" * 30] = [deep]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", type_tree(F.col("t")).alias("n"))
    bad = [(r.t, r.n and trees(r.n), texts[r.t]) for r in df.collect() if r.n is None or trees(r.n) != texts[r.t]]
    assert bad == []


def test_what_is_no_type_is_null(spark):
    broken = ["", " ", "A<", "A>", "A<B", "A<B>>", "<A>", "A<,B>", "A<B,>", "A B", "A<>", "[]", "A..B", "A.", ".A", "A,B", "A |", "| A", "A & B", "A + B", "A<B | C>", "extends A", "A<B C>", "A[]B", None, "f(x)"]
    found = spark.createDataFrame([(t,) for t in broken], "t string").select("t", type_tree(F.col("t")).alias("n")).collect()
    assert [r.t for r in found if r.n is not None] == []


def test_texts_mean_types(spark):
    types = spark.createDataFrame([("p.Shop", None), ("p.Shop.Inner", "p.Shop"), ("p.Shop.Inner.Deep", "p.Shop.Inner"), ("q.Item", None)], "fqn string, outer string")
    simple = [("p.Shop", "Inner", "resolved", "project", "p.Shop.Inner", None, []), ("p.Shop", "Shop", "resolved", "project", "p.Shop", None, []), ("p.Shop", "String", "resolved", "external", "java.lang.String", None, []), ("p.Shop", "Map", "resolved", "external", "java.util.Map", None, []), ("p.Shop", "T", "resolved", "type_variable", "T", None, []), ("p.Shop", "Two", "ambiguous", "project", None, "multiple_on_demand_imports", ["a.Two", "b.Two"]), ("p.Shop", "Gone", "unresolved", None, None, "unknown_type", [])]
    simple = spark.createDataFrame(simple, "cls string, name string, status string, origin string, fqn string, reason string, candidates array<string>")
    expected = {
        "String[]": ("resolved", "class", "java.lang.String", 1, None), "int...": ("resolved", "primitive", "int", 1, None), "T": ("resolved", "type_variable", "T", 0, None), "?": ("resolved", "wildcard", None, 0, None), "Map<String, Two>": ("resolved", "class", "java.util.Map", 0, None), "Map.Entry": ("resolved", "class", "java.util.Map.Entry", 0, None),
        "Inner.Deep": ("resolved", "class", "p.Shop.Inner.Deep", 0, None), "Shop<String>.Inner": ("resolved", "class", "p.Shop.Inner", 0, None), "Inner.None": ("unresolved", "unknown", None, 0, "unknown_nested_type"), "q.Item": ("resolved", "class", "q.Item", 0, None), "p.Shop.Inner.Deep[][]": ("resolved", "class", "p.Shop.Inner.Deep", 2, None), "p.Shop.None": ("unresolved", "unknown", None, 0, "unknown_nested_type"),
        "java.util.List": ("resolved", "class", "java.util.List", 0, None), "a.b.c": ("unresolved", "unknown", None, 0, "unknown_qualified_name"), "Two": ("ambiguous", "unknown", None, 0, "multiple_on_demand_imports"), "Gone": ("unresolved", "unknown", None, 0, "unknown_type"), "Never": ("unresolved", "unknown", None, 0, "unknown_type"), "String | q.Item": ("resolved", "union", None, 0, None), "String | Gone": ("unresolved", "union", None, 0, "union_member_unresolved"), "A<": ("unresolved", "unknown", None, 0, "unparseable_type"),
    }
    texts = spark.createDataFrame([("p.Shop", t) for t in expected], "cls string, text string")
    got = {r.text: (r.status, r.kind, r.fqn, r.dims, r.reason) for r in resolve_texts(texts.unionByName(texts), types, simple).collect()}
    assert [(k, v, expected[k]) for k, v in got.items() if v != expected[k]] == [] and len(got) == len(expected)
