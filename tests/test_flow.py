"""Control and data flow within methods, against walks of every path."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict

import pytest

from ferrule.jobs.catalog import ORACLE_SQL, QUERIES
from ferrule.operators import flow as W
from tests.oracle import connect, same

SPANS = "method string, id string, kind string, start int, end int"
ACCESSES = "method string, id string, symbol string, kind string, at int"


def test_nesting_and_branches(spark):
    rows = [
        ("m", "if", "if", 1, 50), ("m", "a", "return", 5, 9), ("m", "elif", "else_if", 10, 40), ("m", "b", "for", 12, 20), ("m", "c", "throw", 14, 18), ("m", "else", "else", 41, 49), ("m", "z", "expression", 60, 70),
        ("n", "try", "try", 1, 30), ("n", "k", "catch", 10, 20), ("n", "f", "finally", 21, 30), ("n", "s", "switch", 40, 60), ("n", "x", "case", 45, 50), ("n", "y", "if", 45, 50), ("e", "one", "return", 3, 3), (None, "no", "if", 1, 2),
    ]
    spans = spark.createDataFrame(rows, SPANS).repartition(4)
    got = {(r.method, r.id): (r.parent, r.depth, r.ord) for r in W.nested(spans).collect()}
    assert got == {
        ("m", "if"): (None, 0, 1), ("m", "a"): ("if", 1, 2), ("m", "elif"): ("if", 1, 3), ("m", "b"): ("elif", 2, 4), ("m", "c"): ("b", 3, 5), ("m", "else"): ("if", 1, 6), ("m", "z"): (None, 0, 7),
        ("n", "try"): (None, 0, 1), ("n", "k"): ("try", 1, 2), ("n", "f"): ("try", 1, 3), ("n", "s"): (None, 0, 4), ("n", "x"): ("s", 1, 5), ("n", "y"): ("x", 2, 6), ("e", "one"): (None, 0, 1),
    }
    flow = W.control_flow(spans)
    placed = {(r.method, r.id): (r.kind, r.loop_kind, r.branch) for r in flow.collect()}
    assert {k for k, v in placed.items() if v[2]} == {("m", "elif"), ("m", "else"), ("n", "k"), ("n", "f"), ("n", "x")}
    assert placed["m", "b"] == ("loop", "for", False) and placed["n", "y"] == ("if", None, False)
    sums = {r.method: (r.statements, r.decisions, r.loops, r.exits, r.handlers, r.depth) for r in W.summary(flow).collect()}
    assert sums == {"m": (7, 2, 1, 2, 0, 3), "n": (6, 2, 0, 0, 1, 2), "e": (1, 0, 0, 1, 0, 0)}


# --- reaching writes: a program is a list of items ("w"/"r", id, symbol) or (kind, [parts]) -------------------


def program(rng, depth, ids):
    out = []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.choice(["w", "r", "r", "w", "if", "loop", "do", "try", "switch"] if depth else ["w", "r"])
        if kind in "wr":
            out.append((kind, f"{kind}{next(ids)}", rng.choice("xy")))
        elif kind == "if":
            arms = [("else_if", program(rng, depth - 1, ids)) for _ in range(rng.choice([0, 0, 1]))] + [("else", program(rng, depth - 1, ids)) for _ in range(rng.choice([0, 1]))]
            out.append(("if", program(rng, depth - 1, ids), arms))
        elif kind == "try":
            arms = [("catch", program(rng, depth - 1, ids)) for _ in range(rng.choice([0, 1, 2]))]
            arms += [("finally", program(rng, depth - 1, ids))] if not arms or rng.random() < 0.3 else []
            out.append(("try", program(rng, depth - 1, ids), arms))
        elif kind == "switch":
            arms = [("case", program(rng, depth - 1, ids)) for _ in range(2)] + [("default", program(rng, depth - 1, ids))] * rng.choice([0, 1])
            out.append(("switch", [], arms))
        else:
            out.append(("while" if kind == "loop" else "do", program(rng, depth - 1, ids), []))
    return out


def laid_out(items, method, spans, accesses, at, ids):
    for item in items:
        if item[0] in "wr":
            accesses.append((method, item[1], item[2], "write" if item[0] == "w" else "read", next(at)))
            continue
        kind, body, arms = item
        id_, start = f"s{next(ids)}", next(at)
        laid_out(body, method, spans, accesses, at, ids)
        for name, part in arms:
            arm, begin = f"s{next(ids)}", next(at)
            laid_out(part, method, spans, accesses, at, ids)
            spans.append((method, arm, name, begin, next(at)))
        spans.append((method, id_, kind, start, next(at)))


def paths(items):
    """Sets of (variable, last write) states are carried by running every path: each is a tuple of accesses."""
    done = [()]
    for item in items:
        if item[0] in "wr":
            tails = [(item,)]
        else:
            kind, body, arms = item
            inner = paths(body)
            named = defaultdict(list)
            for name, part in arms:
                named[name].append(paths(part))
            if kind == "if":
                tails = inner + [p for name in ("else_if", "else") for part in named[name] for p in part]
                tails += [] if named["else"] else [()]
            elif kind == "switch":
                tails = [p for name in ("case", "default") for part in named[name] for p in part]
                tails += [] if named["default"] else [()]
            elif kind == "try":
                broken = [p[:k] for p in inner for k in range(len(p) + 1)]
                if len(broken) * sum(map(len, named["catch"])) > 20_000:
                    raise OverflowError
                tails = inner + [b + c for part in named["catch"] for b in broken for c in part]
                for part in named["finally"]:
                    if len(tails) * len(part) > 20_000:
                        raise OverflowError
                    tails = [p + f for p in tails for f in part]
            else:
                if len(inner) > 20:
                    raise OverflowError
                # Two rounds show whatever one round can hand to the next; a third lets it pass through.
                tails = ([()] if kind == "while" else []) + inner + [a + b for a in inner for b in inner] + [a + b + c for a in inner for b in inner for c in inner]
        tails = set(tails)
        if len(done) * len(tails) > 20_000:
            raise OverflowError
        done = list({a + b for a in done for b in tails})
    return done


def by_paths(items):
    found = set()
    for path in paths(items):
        last = {}
        for kind, id_, symbol in path:
            if kind == "w":
                last[symbol] = id_
            elif symbol in last:
                found.add((id_, last[symbol]))
    return found


def test_reaching_writes_are_those_of_all_paths(spark):
    rng = random.Random(3)
    spans, accesses, expected = [], [], set()
    made = 0
    while made < 120:
        ids, at = itertools.count(), itertools.count(1)
        items = program(rng, 2, ids)
        try:
            want = by_paths(items)
        except OverflowError:
            continue
        method = f"m{made}"
        laid_out(items, method, spans, accesses, at, ids)
        expected |= {(method, r, w) for r, w in want}
        made += 1
    got = {tuple(r) for r in W.reaching_writes(spark.createDataFrame(spans, SPANS).repartition(5), spark.createDataFrame(accesses, ACCESSES)).collect()}
    assert got - expected == set() and expected - got == set() and len(expected) > 300


# --- values --------------------------------------------------------------------------

EXPRS = "method string, expr string, kind string, name string, text string, line int, start int, end int, ref_kind string, symbol string, status string, origin string, type string, declared int, target boolean, in_field boolean"
SLOTS = "slot string, method string, via string, start int, end int, target struct<kind:string,name:string,symbol:string>, expr string, line int, callee string, param string, detail string, literal string"
CALLS = "method string, expr string, kind string, name string, line int, callee string, owner string, receiver struct<kind:string,name:string,symbol:string,start:int,end:int>, params array<string>, args array<struct<start:int,end:int,literal:string>>"
OTHERS = "method string, symbol string, name string, var_kind string, kind string, line int, detail string, expr string"


def test_values_flow_through_slots(spark):
    # 1: total = price(item) + rate;   2: list.add(total, item.name);   3: use(x -> item, this.rate, "s");   4: return total;
    ex = lambda expr, kind, name, line, start, end, ref=None, symbol=None, origin=None, **k: ("m", expr, kind, name, k.get("text", name), line, start, end, ref, symbol, "resolved", origin, "T", 1, k.get("target"), k.get("in_field"))
    exprs = spark.createDataFrame([
        ex("e0", "name_ref", "total", 1, 10, 14, "local_variable", "m$total", target=True), ex("e1", "method_call", "price", 1, 20, 30, "method", "A.price", "project"), ex("e2", "name_ref", "item", 1, 26, 29, "parameter", "m$item"), ex("e3", "name_ref", "rate", 1, 33, 36, "field", "A.rate"),
        ex("e4", "method_call", "add", 2, 40, 60, "method", None, "external"), ex("e5", "name_ref", "list", 2, 40, 43, "local_variable", "m$list"), ex("e6", "name_ref", "total", 2, 45, 49, "local_variable", "m$total"), ex("e7", "field_access", "name", 2, 51, 59, "field", "I.name", text="item.name"), ex("e8", "name_ref", "item", 2, 51, 54, "parameter", "m$item", in_field=True),
        ex("e9", "method_call", "use", 3, 70, 99, "method", "B.use", "project"), ex("e10", "name_ref", "item", 3, 80, 83, "parameter", "m$item"), ex("e11", "field_access", "rate", 3, 86, 94, "field", "A.rate", text="this.rate"),
        ex("e12", "name_ref", "total", 4, 110, 114, "local_variable", "m$total"), ex("e13", "object_creation", "Box", 5, 120, 130, "constructor", "Box.new"), ex("e14", "name_ref", "Type", 5, 122, 124, "type"),
    ], EXPRS)
    calls = spark.createDataFrame([
        ("m", "e1", "method_call", "price", 1, "A.price", "A", None, ["of"], [(26, 29, None)]),
        ("m", "e4", "method_call", "add", 2, None, "java.util.List", ("local", "list", "m$list", 40, 43), [], [(45, 49, None), (51, 59, None)]),
        ("m", "e9", "method_call", "use", 3, "B.use", "B", None, ["f", "rest"], [(74, 83, None), (86, 94, None), (96, 98, "String")]),
        ("m", "e13", "object_creation", "Box", 5, None, None, None, [], [(125, 126, "int")]),
        ("m", "e6", "method_call", "size", 6, None, "L", ("local", "list", "m$list", 40, 43), [], []),
    ], CALLS)
    slots = spark.createDataFrame([
        ("d", "m", "declare", 20, 36, ("local", "total", "m$total"), "e0", 1, None, None, None, None), ("r", "m", "return", 110, 114, ("return", "return", "m$return"), "e12", 4, None, None, None, None),
        ("c", "m", "compound_assign", 122, 124, ("local", "total", "m$total"), "e14", 5, None, None, "+=", None), ("l", "m", "declare", 1, 2, ("local", "n", "m$n"), "e99", 9, None, None, None, "int"), ("z", "m", "declare", 1, 2, ("local", "q", "m$q"), "e98", 9, None, None, None, "null"),
    ], SLOTS)
    lambdas = spark.createDataFrame([("m", 74, 83)], "method string, start int, end int")
    every = slots.unionByName(W.value_slots(calls).select(*slots.columns))
    edges = W.value_edges(exprs, every, lambdas)
    got = {(r.via, r.source.kind, r.source.name, r.target.name, r.param) for r in edges.collect()}
    assert got == {
        ("declare", "call_result", "price", "total", None), ("declare", "field", "rate", "total", None), ("argument", "parameter", "item", "of", "of"), ("mutation", "local", "total", "list", None), ("mutation", "field", "item.name", "list", None),
        ("argument", "field", "this.rate", "rest", "rest"), ("argument", "literal", "String", "rest", "rest"), ("return", "local", "total", "return", None), ("argument", "literal", "int", "new Box#0", None),
        ("compound_assign", "local", "total", "total", None), ("declare", "literal", "int", "n", None), ("receiver", "local", "list", "size", None),
    }
    others = spark.createDataFrame([("m", "m$item", "item", "parameter", "created", 0, "parameter Item item", None), ("m", "m$list", "list", "local", "modified", 2, "add(total, item.name)", "e4")], OTHERS)
    events = sorted((r.symbol, r.ord, r.kind, r.detail) for r in W.flow_events(edges, exprs, others).collect())
    assert events == [
        ("A.rate", 1, "read", ""), ("A.rate", 2, "derived", "into total"), ("A.rate", 3, "read", ""), ("A.rate", 4, "passed", "to use(rest)"), ("I.name", 1, "read", ""),
        ("m$item", 1, "created", "parameter Item item"), ("m$item", 2, "read", ""), ("m$item", 3, "passed", "to price(of)"), ("m$item", 4, "read", ""), ("m$list", 1, "read", ""), ("m$list", 2, "modified", "add(total, item.name)"),
        ("m$total", 1, "read", ""), ("m$total", 2, "read", ""), ("m$total", 3, "returned", "returned"),
    ]
    assert {(r.symbol, r.created) for r in W.created_from(edges).collect()} == {("m$total", "initialized from call price(), field rate"), ("m$n", "initialized from int literal")}
    assert W.value_edges(exprs.where("false"), every.where("false"), lambdas).count() == 0


@pytest.fixture
def uneven(spark):
    """Partitions merge by tiny sizes, as those of large tables do: some inputs of a step end in more of them than others."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["reaching_writes", "value_edges", "control_flow"])
def test_a_method_stays_whole_however_partitions_are_merged(spark, uneven, name):
    data = "/root/testdata/sf0.01"
    same(QUERIES[name](spark, data), connect(data), ORACLE_SQL[name])
