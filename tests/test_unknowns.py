from __future__ import annotations

import random

from ferrule.operators import unknowns as U


def test_unexplained_literals_are_those_of_all_pairs(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ab.é𝒳\n\\\"") for _ in range(n))
    literals = [(f"m{rng.randrange(6)}", word(rng.randrange(6))) for _ in range(200)] + [("none", "a"), ("none", ""), ("null", "a")]
    texts = [(f"m{rng.randrange(5)}", word(rng.randrange(30))) for _ in range(12)] + [("null", None)]
    want = sorted((m, x) for m, x in literals if not any(k == m and t is not None and x in t for k, t in texts))
    got = U.unexplained(spark.createDataFrame(literals, "method string, literal string"), spark.createDataFrame(texts, "method string, text string"))
    assert sorted(map(tuple, got.collect())) == want


def test_unknowns(spark):
    methods = spark.createDataFrame([("m", 1, "comment"), ("n", 5, "name"), ("o", 9, None)], "method string, line int, basis string")
    calls = spark.createDataFrame([("m", "go", "unresolved", "no_such_method", [], [], 3), ("m", "at", "ambiguous", "overload_not_disambiguated", ["a", "b"], [], 2), ("n", "run", "resolved", None, [], ["x", "y", "z"], 7), ("n", "fine", "resolved", None, [], [], 8)], "method string, name string, status string, reason string, candidates array<string>, dispatch array<string>, line int")
    rules = spark.createDataFrame([("m", 8, ["18", "0"]), ("m", 4, ["18", '"EU"']), ("n", 6, ["2.5"])], "method string, line int, literals array<string>")
    evidence = spark.createDataFrame([("m", "comment", 'only in the "EU"'), ("m", "source_code", "18"), ("n", "test", "12.50")], "method string, source_type string, snippet string")
    found = U.ordered(U.unknowns(methods, calls, rules, evidence)).collect()
    got = {(r.method, r.ord): (r.kind, r.line, r.message) for r in found}
    assert got == {
        ("m", 1): ("ambiguous_call", 2, "at() could be any of 2 methods (overload_not_disambiguated)"),
        ("m", 2): ("unresolved_call", 3, "cannot determine what go() refers to (no_such_method)"),
        ("m", 3): ("unestablished_constant", 4, "the repository does not establish why 18 was chosen (no comment or test mentions it)"),
        ("n", 1): ("purpose_not_documented", 5, "no comment states the purpose; it is inferred from the name and the code's structure"),
        ("n", 2): ("dynamic_dispatch", 7, "run() is resolved on its declared type; at runtime one of 3 overriding methods may run"),
    }
    assert U.unknowns(methods.where("false"), calls.where("false"), rules.where("false"), evidence).isEmpty()
