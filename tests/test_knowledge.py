from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ferrule.operators import answers as A
from ferrule.operators import budget, graph, ordered
from ferrule.operators import codemodel as C
from ferrule.operators import knowledge as K
from ferrule.operators import metrics as M
from ferrule.sources import repository as R

METHODS = "repository_id string, id string, method_id string, class_id string, class_fqn string, name string, signature string, purpose string, source string, is_test boolean, file string, start_line int, end_line int"


def methods(spark):
    rows = [
        ("r", "m1", "a.Shop#sell(int)", "c1", "a.Shop", "sell", "sell(int)", "sells", "int sell(int n) {}", False, "Shop.java", 5, 9),
        ("r", "m2", "a.Shop#open()", "c1", "a.Shop", "open", "open()", None, "x" * 5000, False, "Shop.java", 2, 4),
        ("r", "m3", "a.ShopTest#sells()", "c2", "a.ShopTest", "sells", "sells()", "tests", None, True, "ShopTest.java", 1, 3),
    ]
    return spark.createDataFrame(rows, METHODS)


def test_documents(spark):
    classes = spark.createDataFrame(
        [("r", "c1", "a.Shop", "class", "a shop", "class with 2 methods", [("int", "n"), ("String", "s")], ["a.Till"], "Shop.java", 1, 20), ("r", "c9", "a.Empty", "enum", None, None, None, None, "Empty.java", 1, 2)],
        "repository_id string, id string, fqn string, kind string, purpose string, structure string, fields array<struct<type:string,name:string>>, dependencies array<string>, file string, start_line int, end_line int",
    )
    rules = spark.createDataFrame([("q1", "m1", "n must be positive", "n > 0", None, None, "throw", 6, 7)], "rule_id string, method string, summary string, condition string, scope string, calculation string, action string, start_line int, end_line int")
    evidence = spark.createDataFrame(
        [("r", "e1", 1, "comment", "Sells.", "Shop.java", "a.Shop", "a.Shop", "sell", 4, 4, "b"), ("r", "e1", 2, "comment", "other", "X.java", None, "z", None, 1, 1, "a"), ("r", "e1", 3, "comment", "other", "X.java", None, "z", None, 1, 1, "b"), ("r", "e2", 4, "readme", "About", "README.md", None, "a.Shop", None, 1, 3, "a.Shop"), ("r", "e3", 5, "code", "no", "X", None, "z", None, 1, 1, "q")],
        "repository_id string, evidence_id string, ord int, source_type string, snippet string, file string, class_name string, owner string, method string, start_line int, end_line int, symbol string",
    )
    docs = K.documents(methods(spark), classes, rules, evidence)
    got = {r.id: r for r in docs.collect()}
    assert set(got) == {"ms:m1", "ms:m2", "ts:m3", "rc:q1:m1", "cs:c1", "cs:c9", "ev:e1", "ev:e2"}
    assert got["ms:m1"].text == "a.Shop.sell sell(int)\npurpose: sells\nint sell(int n) {}" and got["ms:m1"].symbol_ids == ["a.Shop#sell(int)"]
    assert len(got["ms:m2"].text) == 3000 and got["ts:m3"].type == "test" and got["ts:m3"].text.endswith("purpose: tests\n")
    assert got["rc:q1:m1"].text == "a.Shop.sell: n must be positive\ncondition: n > 0\nscope:  calculation:  action: throw"
    assert got["cs:c1"].text == "class a.Shop\npurpose: a shop\nclass with 2 methods\nfields: int n, String s\nmethods: open(), sell(int)\nuses: a.Till"
    assert got["cs:c9"].text == "enum a.Empty\npurpose: \n\nfields: \nmethods: \nuses: "
    assert (got["ev:e1"].text, got["ev:e1"].symbol_ids, got["ev:e1"].type, got["ev:e1"].method_name) == ("Sells.", ["a", "b"], "evidence", "sell")
    assert got["ev:e2"].type == "documentation" and got["ev:e2"].class_name == "a.Shop"
    hashes = {r.id: r.hash for r in K.document_hash(docs).collect()}
    assert len(set(hashes.values())) == len(hashes)
    assert {r.symbol_ids for r in K.metadata(docs).where("id = 'ev:e1'").collect()} == {"a,b"}


def test_calls_tests_summaries_and_uses(spark):
    edges = spark.createDataFrame([("1", "a.ShopTest#sells()", 2, ["a.Shop#sell(int)"]), ("2", "a.ShopTest#sells()", 1, ["a.Shop#sell(int)", "a.Shop#open()"]), ("3", "a.Shop#open()", 3, [])], "call string, caller string, line int, targets array<string>")
    rows = K.call_rows(edges)
    assert sorted((r.call, r.callee_id or "") for r in rows.collect()) == [("1", "a.Shop#sell(int)"), ("2", "a.Shop#open()"), ("2", "a.Shop#sell(int)"), ("3", "")]
    assert {(r.method_id, tuple(r.lines)) for r in K.tested_by(rows, methods(spark)).collect()} == {("a.Shop#sell(int)", (1, 2)), ("a.Shop#open()", (1,))}
    reached = spark.createDataFrame([("a.Shop#open()",), ("lib#x()",)], "method_id string")
    twice = methods(spark).unionByName(methods(spark).withColumn("file", F.lit("A.java")))
    assert {(r.method_id, r.file) for r in K.with_summaries(reached, twice).collect()} == {("a.Shop#open()", "A.java"), ("lib#x()", None)}
    flows = spark.createDataFrame([("r", "a.Shop#open()", "argument", "till"), ("r", "a.Shop#open()", "result", "till"), ("other", "a.Shop#open()", "argument", "till")], "repository_id string, method_id string, via string, target string")
    assert [(r.class_fqn, r.method_name) for r in K.value_uses(flows, methods(spark), "argument", F.col("target") == "till").collect()] == [("a.Shop", "open")]
    events = spark.createDataFrame([("m", "x", "created", "new", 1, 0), ("m", "x", "modified", "add", 5, 2), ("m", "x", "modified", "add", 5, 3), ("m", "x", "modified", "set", 4, 1), ("m", "x", "read", "r", 6, 4), ("m", "y", "read", "r", 6, 5)], "method_id string, variable string, kind string, detail string, line int, ord int")
    lives = K.lifecycles(events)
    assert [(r.variable, r.lifecycle) for r in lives.collect()] == [("x", {"created": ["L1 new"], "modified": ["L4 set", "L5 add"]})]
    own = lives.select(F.lit("r").alias("repository_id"), F.lit("a.Shop#open()").alias("method_id"), "variable", "lifecycle")
    assert K.writers(own, methods(spark)).count() == 1


def test_predicates(spark):
    names = spark.createDataFrame([("add", True), ("setName", True), ("set", True), ("settle", False), ("get", False), (None, False)], "n string, e boolean")
    assert all(r.got == r.e for r in names.withColumn("got", K.is_mutator(F.col("n"))).collect())
    owners = spark.createDataFrame([("a.b.Shop", True), ("Shop", True), ("a.b.shop", True), ("a.MyShop", False)], "c string, e boolean")
    assert all(r.got == r.e for r in owners.withColumn("got", K.of_owner(F.col("c"), "Shop")).collect())
    rows = spark.createDataFrame([("x", 1, True), ("x", 2, False), ("y", 3, True)], "g string, i int, is_test boolean")
    assert sorted(r.i for r in K.prefer_code(rows, ["g"]).collect()) == [2, 3]


def test_mentions_in_documentation(spark):
    sections = spark.createDataFrame([(1, "Shop", "Use Shop.sell (3) or open()."), (2, "Other", "They sell things; Bar and resell(1)"), (3, "sell", "Till.sell(1)")], "section_id int, heading string, text string")
    symbols = spark.createDataFrame([("S", "class", "Shop", "Shop", False), ("B", "class", "Bar", "Bar", False), ("sell", "method", "Shop", "sell", False), ("q", "method", "Shop", "sell", True), ("open", "method", "Shop", "open", False)], "symbol_id string, kind string, class_name string, name string, qualified_only boolean")
    assert {tuple(r) for r in K.mentioned(sections, symbols).collect()} == {("S", 1), ("sell", 1), ("sell", 3), ("q", 1), ("open", 1)}


def test_measures_roots_and_orders(spark):
    rows = spark.createDataFrame([("m", "if", 0), ("m", "for", 1), ("m", "expr", 2), ("n", "expr", 0)], "method_id string, kind string, depth int")
    assert {tuple(r) for r in K.outlined(rows).collect()} == {("m", 3, 3, 1, 1), ("n", 1, 1, 0, 0)}
    links = spark.createDataFrame([(k, k - 1 if k % 10 else None) for k in range(25)], "id int, receiver int")
    assert all((r.root, r.steps) == (r.id // 10 * 10, r.id % 10) for r in K.roots(links).collect())
    calls = spark.createDataFrame([("a", 3, 1), ("a", 1, 9), ("a", 1, 2)], "caller string, line int, expr_id int")
    assert [(r.line, r.expr_id) for r in K.ordered_calls(calls).orderBy("ord").collect()] == [(1, 2), (1, 9), (3, 1)]


def test_walks_keep_how_a_method_was_met(spark):
    edges = spark.createDataFrame([("e1", "a", 1, "resolved", ["b"]), ("e2", "a", 2, "ambiguous", ["b", "c"]), ("e3", "b", 1, "resolved", ["i"]), ("e4", "i", 1, "resolved", ["a"]), ("e5", "c", 1, "unresolved", [])], "edge string, caller string, ord int, status string, targets array<string>")
    starts = spark.createDataFrame([("a",)], "start string")
    over = spark.createDataFrame([("i", "impl"), ("b", "c")], "method string, implementation string")
    got = {r.node: (r.depth, r.edge, r.ambiguous, r.via_override) for r in graph.reach_calls(edges, starts, 5, over).collect()}
    assert got == {"b": (1, "e1", False, False), "c": (1, "e1", False, True), "i": (2, "e3", False, False), "impl": (2, "e3", False, True)}
    sure = {r.node for r in graph.reach_calls(edges, starts, 5, candidates=False).collect()}
    assert sure == {"b", "i"}
    back = {r.node: r.depth for r in graph.reach_calls(edges, spark.createDataFrame([("i",)], "start string"), 5, over, forward=False).collect()}
    assert back == {"b": 1, "a": 2}
    assert graph.reach_calls(edges, starts.where("false"), 5).count() == 0


ANSWER = """<think>hm [E9]</think>Preamble line
## 1. What this method does
- It sells `sell(n)` and `Ghost` for 42 [E1, E7]
- It returns `true`
**Inputs**:
n is 3 at L12-14
Evidence and unknowns
It is unclear why 99. [E2; E1]
<think>tail"""


def test_answers(spark):
    rows = spark.createDataFrame([(1, ANSWER, ["E1", "E2"]), (2, "no headings", ["E1"]), (3, "", None)], "answer_id int, text string, labels array<string>")
    found = A.sections(rows)
    got = [(r.answer_id, r.key, r.title, r.text) for r in found.orderBy("answer_id", "ord").collect()]
    assert [g[:3] for g in got] == [(1, "preamble", ""), (1, "What this method does", "What this method does"), (1, "Inputs", "Inputs"), (1, "Evidence and unknowns", "Evidence and unknowns"), (2, "preamble", "")]
    assert got[2][3] == "n is 3 at L12-14"
    read = {r.answer_id: r for r in A.parsed(rows, found).collect()}
    assert read[1].citations_used == ["E1", "E7", "E2"] and read[1].invalid_citations == ["E7"] and read[1].states_unknowns
    assert set(A.SECTIONS) - set(read[1].missing_sections) == {"What this method does", "Inputs", "Evidence and unknowns"} and len(read[2].missing_sections) == 9 and not read[2].states_unknowns
    support = spark.createDataFrame([(1, "sell"), (1, "N"), (1, "42"), (2, "x")], "answer_id int, token string")
    told = {(r.section, r.kind, r.claim, r.supported) for r in A.claims(found, support).collect()}
    first = "What this method does"
    assert told == {(first, "code", "sell(n)", True), (first, "code", "Ghost", False), (first, "number", "42", True), (first, "code", "true", True), ("Inputs", "number", "3", False)}
    lines = {r.answer_id: (r.lines, r.cited) for r in A.claim_lines(found, labels=rows.select("answer_id", "labels")).collect()}
    assert lines == {1: (2, 1)}
    texts = spark.createDataFrame([("a [E1, E3]  b [E4] c[E2;E1]", ["E1", "E2"]), ("none", [])], "t string, v array<string>")
    fixed = [(r.x.text, r.x.removed) for r in texts.select(A.clean_citations(F.col("t"), F.col("v")).alias("x")).collect()]
    assert fixed == [("a [E1] b c[E2, E1]", ["E3", "E4"]), ("none", [])]


def test_metrics(spark):
    ids = "method_id string, "
    words = spark.createDataFrame([("m", "Price"), ("m", "tax"), ("gone", "x")], ids + "word string")
    got = {r.method_id: (r.found, r.expected, r.missing, r.percent) for r in M.mentions(spark.createDataFrame([("m", "the PRICE of it")], ids + "text string"), words).collect()}
    assert got == {"m": (1, 2, ["tax"], 50.0), "gone": (0, 1, ["x"], 0.0)}
    parts = lambda rows: spark.createDataFrame([("m", p) for p in rows], ids + "part string")
    row = M.structure(parts(["int n", "loop", "loop", "if"]), parts(["intN", "loop", "try", "try"])).first()
    assert (row.found, row.expected, row.extra, row.percent) == (2, 4, 2, 50.0)
    edges = spark.createDataFrame([("m", "a", "b", "assign", None), ("m", "b", "p", "argument", "call"), ("m", "call", "r", "return", None), ("n", "a", "z", "assign", None)], ids + "source string, target string, via string, detail string")
    pairs = spark.createDataFrame([("m", "a", "r"), ("m", "a", "z"), ("m", "a", "a"), ("n", "a", "z")], ids + "source string, target string")
    assert {r.method_id: (r.found, r.expected, r.missing) for r in M.flows(edges, pairs).collect()} == {"m": (1, 3, ["a -> a", "a -> z"]), "n": (1, 1, [])}
    want = spark.createDataFrame([("m", 1, "threshold", None, None), ("m", 2, "threshold", "10", None), ("m", 3, "validation", None, "NULL"), ("m", 4, "validation", None, "null"), ("e", 1, "x", None, None)], ids + "ord int, kind string, literal string, contains string")
    have = spark.createDataFrame([("m", 1, "threshold", ["10"], "n > 10"), ("m", 2, "threshold", ["10", "3"], "n > 3"), ("m", 3, "validation", [], "x is null"), ("m", 4, "other", [], "null")], ids + "ord int, kind string, literals array<string>, text string")
    assert {r.method_id: (r.found, r.expected, r.extra) for r in M.rules(want, have).collect()} == {"m": (3, 4, 1), "e": (0, 1, 0)}
    ratios = spark.createDataFrame([("a", 1, 2), ("a", 1, 2), ("b", 0, 0)], "metric string, found int, expected int")
    assert {r.metric: r.percent for r in M.summary(ratios).collect()} == {"a": 50.0, "b": None}
    assert {(r.method_id, r.known) for r in M.evaluated(words, spark.createDataFrame([("m", 1)], ids + "x int")).collect()} == {("m", True), ("gone", False)}


def brute_fill(items, limit, shares, partial):
    """The two passes over lists."""
    room = {c: int(limit * v / sum(shares.values())) for c, v in shares.items()}
    pool, kept, over = sum(room.values()), {}, []
    for c in shares:
        for i in sorted((i for i in items if i["category"] == c), key=lambda i: (i["priority"], i["id"])):
            if i["tokens"] <= room[c]:
                room[c] -= i["tokens"]
                pool -= i["tokens"]
                kept[i["id"]] = ("kept", i["tokens"], None)
            else:
                over.append(i)
    for i in sorted(over, key=lambda i: (i["priority"], list(shares).index(i["category"]), i["id"])):
        if i["tokens"] <= pool:
            kept[i["id"]], pool = ("pooled", i["tokens"], None), pool - i["tokens"]
        elif partial and pool >= budget.LEAST_PART:
            used = budget.part_tokens([len(x) for x in i["text"].split("\n")], pool)
            kept[i["id"]], pool = ("shortened", used, pool), pool - used
        else:
            kept[i["id"]] = ("omitted", 0, None)
    return kept


@pytest.mark.parametrize("partial", [True, False])
def test_budget_is_filled_in_two_passes(spark, partial):
    rng = random.Random(5)
    rows = defaultdict(list)
    for k in range(400):
        text = "\n".join("x" * rng.randrange(60) for _ in range(rng.randrange(1, 40)))
        rows[rng.choice("abc")].append({"id": k, "category": rng.choice([*budget.SHARES, "target"]), "priority": rng.randrange(5), "tokens": math.ceil(len(text) / 3.5), "text": text})
    flat = [(g, i["id"], i["category"], i["priority"], i["tokens"], i["text"]) for g, v in rows.items() for i in v] + [(None, 1, "target", 1, 1, ""), ("a", 999, "none", 1, 1, "")]
    items = spark.createDataFrame(flat, "g string, id int, category string, priority int, tokens int, text string").repartition(3)
    found = budget.fill(items, "g", "id", 4000, partial=partial).collect()
    for g, v in rows.items():
        expected = brute_fill(v, 4000, budget.SHARES, partial)
        assert {r.id: (r.state, r.used, r.room) for r in found if r.g == g} == expected
        assert sum(r.used for r in found if r.g == g) <= 4000
    assert len(found) == 400
    assert budget.fill(items.where("false"), "g", "id", 100).count() == 0


def test_tails_are_collapsed(spark):
    rows = spark.createDataFrame([("a", k, f"s{k}") for k in range(15)] + [("b", 1, "only")], "g string, t int, title string")
    got = {(r.g, r.ord): (r.title, r.n, r.first, r.last) for r in ordered.collapse_tail(rows, ["g"], "t", "title").collect()}
    assert len(got) == 13 and got["a", 12] == ("4 further steps", 4, 11, 14) and got["a", 11] == ("s10", 1, 10, 10) and got["b", 1] == ("only", 1, 1, 1)


def test_type_names_are_resolved_by_the_first_rule_that_has_any(spark):
    types = spark.createDataFrame([("p.A", "1"), ("p.A.In", "1"), ("p.B", "2"), ("q.C", "3"), ("q.D", "4"), ("r.D", "5"), ("p.Dup", "6"), ("p.Dup", "7"), ("p.Base.Kind", "8"), ("q.String", "9")], "fqn string, location string")
    hierarchy = spark.createDataFrame([("p.A", "p.A", 0, True), ("p.A", "p.Base", 1, True)], "cls string, ancestor string, ord int, known boolean")
    files = spark.createDataFrame([("f", "p"), ("g", None)], "file string, package string")
    imports = spark.createDataFrame([("f", "q.C", False), ("f", "lib.Out", False), ("f", "q", True), ("f", "r", True), ("f", "dark.x", True), ("g", "java.util", True), ("g", "java.awt", True)], "file string, target string, on_demand boolean")
    known = spark.createDataFrame([("java.lang", "String"), ("java.lang", "Integer"), ("java.util", "List"), ("java.awt", "List"), ("java.util", "Map")], "package string, name string")
    cases = {
        "T": ("f", "T", ["p.A"], ["T"], ("resolved", "type_variable", None, "T", [])),
        "self": ("f", "A", ["p.A"], [], ("resolved", "project", None, "p.A", [])),
        "member": ("f", "In", ["p.A"], [], ("resolved", "project", None, "p.A.In", [])),
        "inherited": ("f", "Kind", ["p.A"], [], ("resolved", "project", None, "p.Base.Kind", [])),
        "single": ("f", "C", [], [], ("resolved", "project", None, "q.C", [])),
        "out": ("f", "Out", [], [], ("resolved", "external", None, "lib.Out", [])),
        "same": ("f", "B", [], [], ("resolved", "project", None, "p.B", [])),
        "stars": ("f", "D", [], [], ("ambiguous", "project", "multiple_on_demand_imports", None, ["q.D", "r.D"])),
        "dup": ("f", "Dup", [], [], ("ambiguous", "project", "duplicate_class_definition", "p.Dup", ["6", "7"])),
        "ours": ("f", "String", [], [], ("resolved", "project", None, "q.String", [])),
        "lang": ("g", "Integer", None, None, ("resolved", "external", None, "java.lang.Integer", [])),
        "two": ("g", "List", [], [], ("ambiguous", "external", "multiple_on_demand_imports", None, ["java.awt.List", "java.util.List"])),
        "one": ("g", "Map", [], [], ("resolved", "external", None, "java.util.Map", [])),
        "dark": ("f", "Nope", [], [], ("unresolved", None, "external_unverifiable", None, ["dark.x.Nope"])),
        "no": ("h", "Nope", [], [], ("unresolved", None, "unknown_type", None, [])),
    }
    refs = spark.createDataFrame([(k, *c[:4]) for k, c in cases.items()], "ref string, file string, name string, scopes array<string>, type_vars array<string>")
    got = {r.ref: (r.status, r.origin, r.reason, r.fqn, r.candidates) for r in C.resolve_types(refs, files, imports, types, hierarchy, known).collect()}
    assert got == {k: c[4] for k, c in cases.items()}


def test_overloads(spark):
    hierarchy = spark.createDataFrame([("p.Dog", "p.Dog", 0, True), ("p.Dog", "p.Animal", 1, True), ("p.Animal", "p.Animal", 0, True), ("p.Ext", "p.Ext", 0, True), ("p.Ext", "lib.X", 1, False), ("p.Cat", "p.Cat", 0, True)], "cls string, ancestor string, ord int, known boolean")
    S, O = "java.lang.String", "java.lang.Object"
    cases = {
        "arity": ([S], [("m0", [], False)], ("unresolved", "no_matching_arity", [])),
        "none": ([S], [], ("unresolved", "unknown_method", [])),
        "only": (["p.Cat"], [("m", ["p.Animal"], False)], ("resolved", None, ["m"])),
        "sub": (["p.Dog"], [("a", ["p.Animal"], False), ("c", ["p.Cat"], False)], ("resolved", None, ["a"])),
        "exact": (["int"], [("i", ["int"], False), ("l", ["long"], False)], ("resolved", None, ["i"])),
        "widen": (["short"], [("i", ["int"], False), ("b", ["boolean"], False)], ("resolved", None, ["i"])),
        "box": (["int"], [("w", ["java.lang.Long"], False), ("o", [O], False)], ("resolved", None, ["o"])),
        "unbox": (["java.lang.Integer"], [("l", ["long"], False), ("s", [S], False)], ("resolved", None, ["l"])),
        "null": (["null"], [("i", ["int"], False), ("s", [S], False)], ("resolved", None, ["s"])),
        "unknown": ([None], [("i", ["int"], False), ("s", [S], False)], ("ambiguous", "overload_not_disambiguated", ["i", "s"])),
        "external": (["p.Ext"], [("x", ["lib.Y"], False), ("c", ["p.Cat"], False)], ("ambiguous", "overload_not_disambiguated", ["c", "x"])),
        "misfit": ([S], [("i", ["int"], False), ("c", ["p.Cat"], False)], ("ambiguous", "overload_not_disambiguated", ["c", "i"])),
        "dims": (["int[]"], [("i", ["int"], False), ("a", ["int[]"], False)], ("resolved", None, ["a"])),
        "fixed": ([S, S, S], [("v", [S, f"{S}[]"], True), ("f", [S, O, O], False)], ("resolved", None, ["f"])),
        "array": ([S, S], [("v", [S, f"{S}[]"], True), ("f", [S, O], False)], ("ambiguous", "overload_not_disambiguated", ["f", "v"])),
        "many": ([S, "int", "int"], [("v", [S, "int[]"], True), ("w", [S, f"{S}[]"], True)], ("resolved", None, ["v"])),
        "zero": ([], [("v", ["int[]"], True), ("z", [], False)], ("resolved", None, ["z"])),
    }
    calls = spark.createDataFrame([(k, c[0]) for k, c in cases.items()], "call_id string, args array<string>")
    candidates = spark.createDataFrame([(k, *m) for k, c in cases.items() for m in c[1]], "call_id string, method_id string, params array<string>, var_args boolean")
    got = {r.call_id: (r.status, r.reason, r.targets) for r in C.overloads(calls, candidates, hierarchy).collect()}
    assert got == {k: c[2] for k, c in cases.items()}


def test_documentation_of_a_repository(spark, tmp_path):
    files = {"README.md": b"# Top\nhello", "sub/readme-more.MD": b"text", "docs/a/b.md": b"## B\nbody", "other/c.md": b"# C\nno", "node_modules/README.md": b"# N\nno", "docs/bad.md": b"\xff\xfe", "docs/large.md": b"# L\n" + b"x" * 300}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {(r.path, r.heading, r.text, r.is_readme) for r in R.documentation(spark, str(tmp_path), most_bytes=200).collect()}
    assert got == {("README.md", "Top", "hello", True), ("sub/readme-more.MD", "(top)", "text", True), ("docs/a/b.md", "B", "body", False)}


def test_a_pool_is_taken_from_where_all_of_its_items_are(spark):
    """The planner splits a join that meets one large key; what folds over a key's items needs them dealt anew after it."""
    items = spark.range(4000).selectExpr("if(id < 3990, 'a', concat('k', id)) as key", "id", "if(id % 2 = 0, 'target', 'callees') as category", "id % 7 as priority", "cast(10 + id % 13 as long) as tokens")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        filled = budget.fill(items, "key", "id", 1000, partial=False)
        plan = [line.lstrip(" :+-") for line in filled._jdf.queryExecution().executedPlan().toString().splitlines()]
        rows = filled.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    below = [line.split(" ")[0] for line in plan[next(k for k, line in enumerate(plan) if line.startswith("MapInArrow spill")) :]]
    assert below.index("Exchange") < below.index("SortMergeJoin")
    assert len(rows) == 4000
    assert sum(r.used for r in rows if r.key == "a") <= 1000
