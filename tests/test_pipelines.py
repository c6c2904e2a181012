from __future__ import annotations

import random

from ferrule.operators import pipelines as P

CALLS = "method string, expr string, name string, receiver string, args array<string>, line int, start int, end int, kind string, scope string, text string, target string"


def test_pipelines_are_ordered_and_upgraded_by_collectors(spark):
    call = lambda expr, name, receiver, start, end, kind="stream", scope=None, target=None, method="m": (method, expr, name, receiver, [], start, start, end, kind, scope, f"{name}()", target)
    rows = [
        call("a3", "collect", "a2", 0, 90), call("a1", "filter", "a0", 0, 30), call("a2", "map", "a1", 0, 50), call("a0", "stream", "xs", 0, 10, scope="xs"), call("xs", "getAll", None, 0, 4, "call", target="M.getAll"),
        call("g", "groupingBy", None, 55, 85, "collector"), call("c", "counting", None, 70, 80, "collector"), call("k", "key", None, 60, 65, "call", target="M.key"), call("j", "jdk", None, 61, 62, "call"),
        call("b1", "sum", "b0", 100, 140), call("b0", "of", None, 100, 110), call("d1", "collect", "d0", 200, 240, method="n"), call("d0", "range", None, 200, 205, method="n"), call("dc", "counting", None, 210, 220, "collector", method="n"),
        call("e1", "collect", "e0", 200, 240, method="o"), call("e0", "stream", None, 200, 205, method="o"), call("ec", "toSet", None, 210, 220, "collector", method="o"), call("f0", "odd", "zz", 300, 310, method="o"),
        *[call(f"long{k}", "map" if k else "stream", f"long{k - 1}" if k else None, 0, k, method="long") for k in range(37)],
    ]
    calls = spark.createDataFrame(rows, CALLS).repartition(3)
    got = {r.pipeline: r for r in P.pipelines(calls).collect()}
    assert set(got) == {"a3", "b1", "d1", "e1", "f0", "long36"}
    a = got["a3"]
    assert [(o.name, o.category) for o in a.ops] == [("stream", "source"), ("filter", "filter"), ("map", "map"), ("collect", "group")]
    assert (a.source, a.detail, a.calls) == ("xs", "stream > filter > map > collect > groupingBy > counting", ["M.getAll", "M.key"])
    assert [o.category for o in got["b1"].ops] == ["source", "aggregate"] and got["b1"].source == "of()"
    assert got["d1"].ops[-1].category == "aggregate" and got["e1"].ops[-1].category == "collect" and got["e1"].source == "stream()"
    assert [(o.name, o.category) for o in got["f0"].ops] == [("odd", "other")]
    assert len(got["long36"].ops) == 37 and [r.expr for r in P.operations(calls).where("pipeline = 'long36'").orderBy("ord").collect()] == [f"long{k}" for k in range(37)]
    assert P.pipelines(calls.where("false")).count() == 0


def test_calls_are_dealt_once_and_methods_may_span_batches(spark):
    """One shuffle by method, whatever the length of chains; ids need to be unique within their method only."""
    rng = random.Random(5)
    rows, want, held, inside = [], {}, {}, {}
    for m in (None, "a", "b", "c", "d"):
        links = [(f"{k}.{j}", f"{k}.{j - 1}" if j else None) for k in range(rng.randrange(1, 6)) for j in range(rng.randrange(1, 40))]
        spans = {e: (s := rng.randrange(50), s + rng.randrange(1, 30)) for e, _ in links}  # overlap at will
        others = [(f"{kind}{k}", kind, s := rng.randrange(70), s + rng.randrange(6)) for kind in ("collector", "call") for k in range(9)]
        for e, to in links:
            rows.append((m, e, "collect" if e.endswith(".3") else "map", to, [], 1, *spans[e], "stream", None, e, None))
            want.setdefault((m, e.split(".")[0]), []).append(e)
        rows += [(m, x, x, None, [], 1, s, t, kind, None, x, f"T.{x}") for x, kind, s, t in others]
        for (_, _), chain in [x for x in want.items() if x[0][0] == m]:
            for e in chain:
                a, b = spans[e]
                proper = lambda s, t, a=a, b=b: a <= s and t <= b and (a, b) != (s, t)
                held[m, e] = [x for s, t, x in sorted((s, t, x) for x, kind, s, t in others if kind == "collector" and proper(s, t))] if e.endswith(".3") else []
                inside[m, chain[-1]] = [f"T.{x}" for s, t, x in sorted((s, t, x) for x, kind, s, t in others if kind == "call" and proper(s, t))]
    calls = spark.createDataFrame(rows, CALLS).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = P.operations(calls).collect()
        found = P.pipelines(calls)
        ends = found.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    chains = {}
    for r in sorted(got, key=lambda r: r.ord):
        chains.setdefault((r.method, r.pipeline), []).append(r.expr)
    assert chains == {(m, chain[-1]): chain for (m, _), chain in want.items()}
    assert {(r.method, r.expr): r.collectors for r in got} == held
    assert {(r.method, r.pipeline): r.calls for r in ends} == inside
    initial = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert initial.count("Exchange hashpartitioning") == 1 and "Join" not in initial
