"""Conditions: where they split and what they say."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ferrule.functions import conditions as C


def parts_by_flags(text):
    """The parts of a condition from a flag for each character: within quotes or brackets, or not."""
    depth, quote, free, k = 0, "", [False] * len(text), 0
    while k < len(text):
        c = text[k]
        if quote:
            k += c == "\\"
            quote = "" if c == quote else quote
        else:
            quote = c if c in "\"'" else ""
            depth += (c in "([{") - (c in ")]}")
            free[k] = depth == 0 and not quote
        k += 1
    out, at, op, k = [], 0, "", 0
    while k < len(text):
        if free[k] and text[k : k + 2] in ("&&", "||"):
            out.append((op, text[at:k]))
            op, at = text[k : k + 2], k + 2
            k += 1
        k += 1
    return [*out, (op, text[at:])]


def peeled(text):
    text = text.strip()
    while text[:1] == "(" and text[-1:] == ")" and len(text) > 1:
        level, inner = 0, text[1:-1]
        for c in inner:
            level += (c == "(") - (c == ")")
            if level < 0:
                return text
        if level:
            return text
        text = inner.strip()
    return text


def test_conditions_split_outside_quotes_and_brackets(spark):
    rng = random.Random(6)
    pieces = ["&&", "||", "(", ")", "[", "]", "{", "}", '"', "'", "\\", "a", "b == 1", " ", "\n", "&", "|", "é", "((", "))", "𝒳"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(600)]
    texts += ["a && (b || c) && d", '"x && y" == z || \'"\' != q', "(" * 60 + "a && b" + ")" * 60, "((a) && (b))", "((a)) && ((b) || c)", "( a ) ", "()", "(", ")", "", '"open && x', "a" * 5000 + " && " + "b" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", C.split_condition(F.col("t")).alias("p"), C.strip_brackets(F.col("t")).alias("s"))
    for r in df.collect():
        text = texts[r.k]
        assert r.s == peeled(text), repr(text)
        assert [(x.op, x.atom) for x in r.p] == [(op, peeled(part)) for op, part in parts_by_flags(text)], repr(text)
    assert spark.createDataFrame([(None,)], "t string").select(C.split_condition(F.col("t")).alias("p")).first().p is None


def test_what_atoms_say(spark):
    expected = {
        "x == null": ("null", "x is missing", []), "null != a.b()": ("null", "a.b() is present", []), "!(x == null)": ("null", "not (x is missing)", []), "age >= 18": ("threshold", "age is at least 18", ["18"]), "3.5f > rate": ("threshold", "3.5f is greater than rate", ["3.5f"]),
        "a < b": ("comparison", "a is less than b", []), 'name == "x > y"': ("literal_match", 'name equals "x > y"', ['"x > y"']), "state != Status.OPEN_NOW": ("literal_match", "state does not equal Status.OPEN_NOW", ["Status.OPEN_NOW"]), "f(a > b)": ("test", "f(a > b)", []), "f(a > b) == true": ("literal_match", "f(a > b) equals true", ["true"]),
        'a.equals("k")': ("literal_match", 'a equals "k"', ['"k"']), "a.b().equalsIgnoreCase(c(d))": ("comparison", "a.b() equals (ignoring case) c(d)", []), "!list.isEmpty()": ("test", "not (list is empty)", []), "s.isBlank( )": ("test", "s is blank", []), "s.isEmpty(x)": ("test", "s.isEmpty(x)", []), "d.isAfter(now())": ("comparison", "d is after now()", []),
        's.startsWith("a")': ("literal_match", 's starts with "a"', ['"a"']), "s.contains(t)": ("test", "s contains t", []), "a.compareTo(b)": ("comparison", "compare a with b", []), "a.compareTo(b) > 0": ("threshold", "a.compareTo(b) is greater than 0", ["0"]), "x -> x > 3": ("test", "x -> x > 3", []), "(a, b) -> a == b": ("test", "(a, b) -> a == b", []),
        "flag": ("test", "flag", []), "x >> 2 > y": ("threshold", "x >> 2 is greater than y", []), "m instanceof Map<K, List<V>>": ("test", "m instanceof Map<K, List<V>>", []), "run()": ("test", "run()", []), "!done": ("test", "not (done)", []), "": ("test", "", []), "a).b(c)": ("test", "a).b(c)", []),
    }
    expected["x >> 2 > y"] = ("comparison", "x >> 2 is greater than y", [])
    df = spark.createDataFrame([(t,) for t in expected], "t string").select("t", C.atom(F.col("t")).alias("a"))
    got = {r.t: (r.a.kind, r.a.meaning, r.a.literals) for r in df.collect()}
    assert [(k, v, expected[k]) for k, v in got.items() if v != expected[k]] == []
    whole = spark.createDataFrame([("(a == null) || b > 1 && !c",)], "t string").select(C.split_condition(F.col("t")).alias("p"))
    said = whole.select(C.meaning(F.transform("p", lambda p: F.struct(p["op"].alias("op"), C.atom(p["atom"])["meaning"].alias("meaning")))).alias("m")).first().m
    assert said == "a is missing OR b is greater than 1 AND not (c)"


def test_no_step_is_repeated_at_each_use(spark):
    text = spark.createDataFrame([("a > 1",)], "t string").select(C.atom(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert text.lower().count("regexp_") + text.lower().count("rlike") < 200
