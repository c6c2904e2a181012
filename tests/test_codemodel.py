from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ferrule.operators import codemodel as C
from ferrule.sources import repository as R
from ferrule.streaming import incremental

TYPES = "cls string, kind string, superclass string, interfaces array<string>, components array<struct<name:string,type:string>>"
METHODS = "cls string, method_id string, name string, params array<string>, is_static boolean, kind string"


def types(spark):
    return spark.createDataFrame(
        [
            ("Base", "class", "lib.Root", [], []),
            ("Plain", "class", None, None, None),
            ("Shop", "class", "Base", ["Seller", "Closer"], []),
            ("Seller", "interface", None, ["Closer"], []),
            ("Closer", "interface", None, [], []),
            ("A", "class", "B", [], []),
            ("B", "class", "A", [], []),
            ("Color", "enum", None, [], []),
            ("Point", "record", None, [], [("x", "int"), ("y", "int")]),
        ],
        TYPES,
    )


def methods(spark):
    rows = [
        ("Base", "Base#sell(int)", "sell", ["int"], False, "method"),
        ("Base", "Base#open()", "open", [], True, "method"),
        ("Seller", "Seller#sell(int)", "sell", ["int"], False, "method"),
        ("Seller", "Seller#sell(String)", "sell", ["String"], False, "method"),
        ("Shop", "Shop#sell(int)", "sell", ["int"], False, "method"),
        ("Shop", "Shop#open()", "open", [], False, "method"),
        ("Point", "Point#x()", "x", [], False, "method"),
        ("Base", "Base#Base()", "Base", [], False, "constructor"),
        ("Plain", "Plain#go()", "go", [], False, "method"),
    ]
    return spark.createDataFrame(rows, METHODS)


def test_hierarchy_is_depth_first_and_ends_on_cycles(spark):
    rows = C.hierarchy(types(spark)).collect()
    of = lambda cls: [r.ancestor for r in sorted(rows, key=lambda r: r.ord) if r.cls == cls]
    assert of("Shop") == ["Shop", "Base", "lib.Root", "Seller", "Closer"]
    assert of("A") == ["A", "B"] and of("Plain") == ["Plain"]
    assert {r.ancestor for r in rows if not r.known} == {"lib.Root"}


def test_call_edges_keep_every_call(spark):
    order = C.hierarchy(types(spark))
    calls = [("1", "m", "Shop", "sell", ["int"]), ("2", "m", "Shop", "sell", [None]), ("3", "m", "Shop", "fly", []), ("4", "m", "Plain", "fly", []), ("5", "m", "Unknown", "go", []), ("6", "m", "Plain", "go", []), ("7", "m", "Shop", "sell", ["long"]), ("8", "m", None, "go", [])]
    df = spark.createDataFrame(calls, "call_id string, caller string, receiver string, name string, args array<string>")
    got = {r.call_id: (r.status, r.targets) for r in C.call_edges(df, methods(spark), order).collect()}
    both = ["Seller#sell(String)", "Shop#sell(int)"]
    assert got == {
        "1": ("resolved", ["Shop#sell(int)"]), "2": ("ambiguous", both), "3": ("external", []), "4": ("unresolved", []),
        "5": ("external", []), "6": ("resolved", ["Plain#go()"]), "7": ("ambiguous", both), "8": ("external", []),
    }


def test_overrides_and_implicit_members(spark):
    order = C.hierarchy(types(spark))
    got = {(r.method_id, r.overridden) for r in C.overrides(methods(spark), order).collect()}
    assert got == {("Shop#sell(int)", "Base#sell(int)"), ("Shop#sell(int)", "Seller#sell(int)")}
    new = {r.method_id for r in C.implicit_members(types(spark), methods(spark)).collect()}
    assert new == {"Plain#Plain()", "Shop#Shop()", "A#A()", "B#B()", "Color#values()", "Color#valueOf(String)", "Point#Point(int,int)", "Point#y()"}


def test_purpose(spark):
    rows = [("getTotalPrice", "method", "returns the total price"), ("isOpen", "method", "checks whether open"), ("hasItems", "method", "checks whether it has items"), ("calculate", "method", "calculates"), ("frobnicateAll", "method", "performs frobnicate all"), ("x", "constructor", "constructs a http server")]
    df = spark.createDataFrame(rows, "name string, kind string, says string")
    assert all(r.got == r.says for r in df.withColumn("got", C.purpose(F.col("name"), F.col("kind"), F.lit("HTTPServer"))).collect())


def test_risks(spark):
    rows = [("a", 16, 4, 1, 100, False), ("b", 10, 1, 1, 5, False), ("t", 1, 1, 1, 2, True), *[(f"c{k}", 1, 1, 1, 2, False) for k in range(5)]]
    df = spark.createDataFrame(rows, "method_id string, complexity int, nesting int, start_line int, end_line int, is_test boolean")
    edges = spark.createDataFrame([*[(f"c{k}", "b") for k in range(5)], ("t", "a")] * 2, "caller string, callee string")
    got = {(r.method_id, r.kind, r.level) for r in C.risks(df, edges).collect()}
    assert got == {("a", "complexity", "high"), ("a", "nesting", "medium"), ("a", "length", "medium"), ("b", "complexity", "medium"), ("b", "wide_impact", "medium")}


def test_scan(spark, tmp_path):
    files = {"b/B.java": b"/* package no; */ package a.b;\nclass B {}", "A.java": "é".encode("latin-1"), "build/C.java": b"x", "Aa.java": b"x" * 50, "z/Z.java": b"class Z", "note.md": b"# x"}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows = {r.relative_path: r for r in R.scan(spark, str(tmp_path), "repo", most_files=2, most_bytes=45).collect()}
    assert {k: r.reason for k, r in rows.items()} == {"A.java": None, "b/B.java": None, "Aa.java": "too_large", "z/Z.java": "max_source_files"}
    assert rows["A.java"].text == "é" and rows["A.java"].encoding_issue
    assert rows["b/B.java"].package == "a.b" and not rows["b/B.java"].encoding_issue and len(rows["b/B.java"].id) == 16
    assert rows["z/Z.java"].text is None


def test_markdown_sections_and_lines(spark):
    docs = spark.createDataFrame([("a.md", "intro\n# One #\n\n## Two\nx\ny\n")], "path string, text string")
    got = [(r.heading, r.start_line, r.end_line, r.text) for r in R.markdown_sections(docs).orderBy("start_line").collect()]
    assert got == [("(top)", 1, 1, "intro"), ("Two", 4, 7, "x\ny")]
    assert docs.select(R.lines_of(F.col("text"), F.lit(2), F.lit(4)).alias("x")).first().x == "# One #\n\n## Two"


def test_is_test(spark):
    rows = [("src/test/A.java", "a.A", [], True), ("src/A.java", "a.FooTest", [], True), ("src/A.java", "a.A", ["Test"], True), ("src/contest/A.java", "a.Testing", None, False)]
    df = spark.createDataFrame(rows, "path string, cls string, annotations array<string>, expected boolean")
    assert all(r.got == r.expected for r in df.withColumn("got", R.is_test(F.col("path"), F.col("cls"), F.col("annotations"))).collect())


def test_stream_of_versions(spark, tmp_path):
    schema = "id string, ts timestamp, hash string"
    at = lambda h: dt.datetime(2024, 1, 1, h)
    source, log, state = (str(tmp_path / x) for x in ("in", "log", "state"))
    for rows in ([("a", at(1), "x"), ("b", at(1), "y"), ("b", at(1), "y")], [("a", at(3), "z"), ("b", at(2), None), ("a", at(2), "w")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = incremental.follow(spark, source, spark.createDataFrame([], schema).schema, log, state)
        query.awaitTermination()
    assert {(r.id, r.hash) for r in incremental.latest(spark.read.parquet(log)).collect()} == {("a", "z")}
    assert spark.read.parquet(log).count() == 5


def test_counts_by_window(spark):
    events = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m), "view") for m in (1, 59)] + [(dt.datetime(2024, 1, 1, 1, 0), "view")], "ts timestamp, event_type string")
    assert sorted(r.n for r in incremental.counts_by_window(events).collect()) == [1, 2]
