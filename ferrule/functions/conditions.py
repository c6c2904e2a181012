"""Conditions of C-like languages as column expressions: where they split, and what their parts say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrule.functions.text import let, literal_type

# How operators and tests of a method's name read, and operators that compare nothing.
OPERATORS = {">": "is greater than", ">=": "is at least", "<": "is less than", "<=": "is at most", "==": "equals", "!=": "does not equal"}
EQUALS = {"equals": "equals", "equalsIgnoreCase": "equals (ignoring case)"}
TESTS = {"contains": "contains", "startsWith": "starts with", "endsWith": "ends with", "matches": "matches"}
TIMES = {"isAfter": "is after", "isBefore": "is before", "isEqual": "is the same as"}
STATES = {"isEmpty": "is empty", "isBlank": "is blank"}
NO_COMPARISON = [">>>=", "<<=", ">>=", ">>>", ">>", "<<", "->"]

ATOM = "struct<text:string,kind:string,meaning:string,literals:array<string>>"
# A text is cut into quoted literals (to its end, if one is open), brackets, joining operators, and what lies between.
_TOKEN = r"""(?s)"(?:\\.|[^"\\])*(?:"|\\?$)|'(?:\\.|[^'\\])*(?:'|\\?$)|[(\[{]|[)\]}]|&&|\|\||[&|]|[^"'(\[{)\]}&|]+"""
_MASKED = r"""(?s)"[^"]*(?:"|$)|'[^']*(?:'|$)|[(\[{]|[)\]}]|[^"'(\[{)\]}]+"""
_GENERIC = r"(?U)\b[A-Z][\w.]*<[\w\s,.?\[\]&<>]*>"
_CONSTANT = r"(?U)^[A-Z][\w.]*\.[A-Z][A-Z0-9_]+$"
_COMPARE = r"(?s)^(.+?)\s*(>=|<=|==|!=|>|<)\s*(.+)$"
_NULL = r"(?s)^(.+?)\s*(==|!=)\s*null$"
_NULL_FIRST = r"(?s)^null\s*(==|!=)\s*(.+)$"
_ARROW = r"(?U)^\(?[\w\s,]*\)?\s*->"


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _texts(*items: Column) -> Column:
    return F.array_compact(F.array(*items)).cast("array<string>")


def _depth(acc: Column, token: Column) -> Column:
    return acc + F.when(token.isin("(", "[", "{"), 1).when(token.isin(")", "]", "}"), -1).otherwise(0)


def split_condition(text: Column) -> Column:
    """The parts of a condition between the ``&&`` and ``||`` that no bracket or quote holds: array of (op, atom), op being what comes before.

    One fold over the tokens of the text keeps the depth of brackets, which a closing one too many makes negative, and the
    places to cut; parts are slices between those. Parts lose white space and brackets around them. Null gives null.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("cuts"))

    def step(acc: Column, token: Column) -> Column:
        cut = (acc["depth"] == 0) & token.isin("&&", "||")
        return F.struct(_depth(acc["depth"], token).alias("depth"), (acc["i"] + 1).alias("i"), F.when(cut, F.array_append(acc["cuts"], acc["i"])).otherwise(acc["cuts"]).alias("cuts"))

    def parts(tokens: Column) -> Column:
        cuts = F.aggregate(tokens, start, step, lambda acc: F.array_append(F.array_prepend(acc["cuts"], F.lit(-1)), acc["i"]))
        return let(F.struct(tokens.alias("t"), cuts.alias("c")), lambda x: F.transform(F.sequence(F.lit(1), F.size(x["c"]) - 1), lambda k: _part(x, k)))

    return F.when(text.isNotNull(), let(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), parts))


def _part(x: Column, k: Column) -> Column:
    """Part ``k`` of tokens t cut at c."""
    a, b = F.get(x["c"], k - 1), F.get(x["c"], k)
    atom = F.array_join(F.slice(x["t"], a + 2, b - a - 1), "")
    return F.struct(F.when(a < 0, "").otherwise(F.get(x["t"], a)).alias("op"), strip_brackets(atom).alias("atom"))


def strip_brackets(text: Column) -> Column:
    """``text`` without white space and without the round brackets that hold all of it.

    As many pairs go as brackets open the text, close it, and stay open throughout what lies between: the least depth there,
    if the whole is balanced.
    """
    pattern = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    def ends(plain: Column) -> Column:
        lead, trail = F.regexp_extract(plain, r"(?U)^[(\s]*", 0), F.regexp_extract(plain, r"(?U)[)\s]*$", 0)
        return let(F.struct(lead.alias("lead"), trail.alias("trail")), lambda x: counted(plain, x["lead"], x["trail"]))

    def counted(plain: Column, lead: Column, trail: Column) -> Column:
        opened, closed = F.regexp_count(lead, F.lit(r"\(")), F.regexp_count(trail, F.lit(r"\)"))
        inner = F.substring(plain, F.length(lead) + 1, F.greatest(F.length(plain) - F.length(lead) - F.length(trail), F.lit(0)))
        return let(F.struct(opened.alias("opened"), closed.alias("closed")), lambda x: let(layers(inner, x["opened"], x["closed"]), lambda n: bare(plain, n)))

    def layers(inner: Column, opened: Column, closed: Column) -> Column:
        start = F.struct(opened.alias("depth"), opened.alias("least"))
        step = lambda acc, mark: let(_depth(acc["depth"], mark), lambda d: F.struct(d.alias("depth"), F.least(acc["least"], d).alias("least")))
        least = F.aggregate(F.regexp_extract_all(inner, F.lit("[()]"), F.lit(0)), start, step, lambda acc: F.when(acc["depth"] == closed, F.least(acc["least"], closed)).otherwise(0))
        return F.greatest(least, F.lit(0)).cast("string")

    def bare(plain: Column, n: Column) -> Column:
        peeled = F.regexp_replace(F.regexp_replace(plain, pattern(r"(?U)^(?:\(\s*){", n, "}"), F.lit("")), pattern(r"(?U)(?:\s*\)){", n, "}$"), F.lit(""))
        return F.when(n == "0", plain).otherwise(peeled)

    return let(_trim(text), lambda plain: F.when(plain.startswith("(") & plain.endswith(")"), ends(plain)).otherwise(plain))


def _blank(text: Column, pattern: str) -> Column:
    """``text`` with each match of ``pattern`` as underscores."""
    rest, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(rest, found, lambda a, b: F.concat(a, F.coalesce(F.repeat(F.lit("_"), F.length(b)), F.lit(""))))
    return F.array_join(pieces, "")


def outside_brackets(text: Column) -> Column:
    """``text`` with all that quotes or brackets hold as underscores, as are arguments of types, shifts and arrows: same length, top level only."""
    masked = _blank(text, _GENERIC)
    for token in NO_COMPARISON:
        masked = F.replace(masked, F.lit(token), F.lit("_" * len(token)))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(acc: Column, token: Column) -> Column:
        depth = _depth(acc["depth"], token)
        plain = (acc["depth"] == 0) & ~token.rlike(r"^[\"'(\[{)\]}]")
        return F.struct(depth.alias("depth"), F.concat(acc["out"], F.when(plain, token).otherwise(F.repeat(F.lit("_"), F.length(token)))).alias("out"))

    return F.aggregate(F.regexp_extract_all(masked, F.lit(_MASKED), F.lit(0)), start, step, lambda acc: acc["out"])


def last_call(text: Column) -> Column:
    """The last call that ends ``text``, as (receiver, name, args), by the bracket that its closing one answers; null if there is none."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] - F.when(piece == "(", 1).when(piece == ")", -1).otherwise(0)
        n = F.when(acc["done"], acc["n"]).otherwise(acc["n"] + F.length(piece))
        return F.struct(F.when(acc["done"], acc["depth"]).otherwise(depth).alias("depth"), n.alias("n"), (acc["done"] | (depth == 0)).alias("done"))

    def found(plain: Column) -> Column:
        pieces = F.reverse(F.regexp_extract_all(plain, F.lit("[()]|[^()]+"), F.lit(0)))
        n = F.aggregate(pieces, start, step, lambda acc: F.when(acc["done"], acc["n"]))
        return let(F.when(plain.endswith(")"), n), lambda n: let(F.substring(plain, F.lit(1), F.length(plain) - n), lambda head: named(plain, n, head)))

    def named(plain: Column, n: Column, head: Column) -> Column:
        parts = F.struct(_trim(F.regexp_replace(head, r"(?U)\.\w+$", "")).alias("receiver"), F.regexp_extract(head, r"(?U)\.(\w+)$", 1).alias("name"), _trim(F.substring(plain, F.length(plain) - n + 2, n - 2)).alias("args"))
        return F.when(n.isNotNull() & head.rlike(r"(?U)\.(\w+)$"), parts)

    return let(_trim(text), found)


def _constant(text: Column, kind: Column) -> Column:
    """``text`` if it is a literal, as ``kind`` says, or the qualified name of a constant, else null."""
    return F.when(kind.isNotNull() | _trim(text).rlike(_CONSTANT), text)


def _say(names: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key)


def atom(text: Column) -> Column:
    """What one condition says: ``ATOM``. Kind is null, threshold, literal_match, comparison or test; literals are the constants it names.

    A leading ``!`` negates the meaning. By priority: a function value says itself; a test against null; a comparison outside
    any call, a threshold if it orders numbers, a literal_match if it equals a constant; a call that tests its receiver; any other text says itself.
    """
    numbers = ["int", "long", "float", "double"]

    def opened(raw: Column) -> Column:
        negated = raw.startswith("!") & ~raw.startswith("!=")
        body = F.when(negated, strip_brackets(F.substring(raw, F.lit(2), F.length(raw)))).otherwise(raw)
        return let(F.struct(negated.alias("negated"), body.alias("body")), lambda x: finished(raw, x["negated"], x["body"]))

    def finished(raw: Column, negated: Column, body: Column) -> Column:
        said = let(F.struct(outside_brackets(body).alias("masked"), last_call(body).alias("call")), lambda x: placed(body, x["masked"], x["call"]))
        made = lambda a: F.struct(raw.alias("text"), a["kind"].alias("kind"), F.when(negated, F.concat(F.lit("not ("), a["meaning"], F.lit(")"))).otherwise(a["meaning"]).alias("meaning"), a["literals"].alias("literals"))
        return let(said, made)

    def placed(b: Column, masked: Column, call: Column) -> Column:
        compares = masked.rlike(_COMPARE)
        left = _trim(F.substring(b, F.lit(1), F.length(F.regexp_extract(masked, _COMPARE, 1))))
        right = _trim(F.right(b, F.length(F.regexp_extract(masked, _COMPARE, 3))))
        op = F.regexp_extract(masked, _COMPARE, 2)
        # What stands on either side: of a comparison, or of the name of a call.
        sides = F.struct(F.when(compares, op).alias("op"), F.when(compares, left).otherwise(call["receiver"]).alias("left"), F.when(compares, right).otherwise(call["args"]).alias("right"), call["name"].alias("name"))
        typed = lambda x: F.struct(*[x[k].alias(k) for k in ("op", "left", "right", "name")], literal_type(x["left"]).alias("left_type"), literal_type(x["right"]).alias("right_type"))
        known = lambda x: F.struct(*[x[k].alias(k) for k in ("op", "left", "right", "name")], (x["left_type"].isin(numbers) | x["right_type"].isin(numbers)).alias("number"), _constant(x["left"], x["left_type"]).alias("a"), _constant(x["right"], x["right_type"]).alias("b"))
        return let(let(let(sides, typed), known), lambda x: judged(b, x))

    def judged(b: Column, x: Column) -> Column:
        made = lambda kind, meaning, *literals: F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), meaning.alias("meaning"), _texts(*literals).alias("literals"))
        subject = F.when(b.rlike(_NULL), F.regexp_extract(b, _NULL, 1)).otherwise(F.regexp_extract(b, _NULL_FIRST, 2))
        sign = F.when(b.rlike(_NULL), F.regexp_extract(b, _NULL, 2)).otherwise(F.regexp_extract(b, _NULL_FIRST, 1))
        state = F.concat(_trim(subject), F.when(sign == "==", " is missing").otherwise(" is present"))
        op, on, left, right = x["op"], x["name"], x["left"], x["right"]
        constant = F.coalesce(x["a"], x["b"]).isNotNull()
        kind = F.when(op.isin("<", ">", "<=", ">=") & F.coalesce(x["number"], F.lit(False)), "threshold").when(op.isin("==", "!=") & constant, "literal_match").otherwise("comparison")
        says = lambda names: F.concat_ws(" ", left, _say(names, on), right)
        return (
            F.when(b.rlike(_ARROW), made("test", b))
            .when(b.rlike(_NULL) | b.rlike(_NULL_FIRST), made("null", state))
            .when(op.isNotNull(), made(kind, F.concat_ws(" ", left, _say(OPERATORS, op), right), x["a"], x["b"]))
            .when(on.isin(list(EQUALS)), made(F.when(constant, "literal_match").otherwise("comparison"), says(EQUALS), x["a"], x["b"]))
            .when(on.isin(list(TIMES)), made("comparison", says(TIMES)))
            .when(on.isin(list(STATES)) & (right == ""), made("test", F.concat_ws(" ", left, _say(STATES, on))))
            .when(on.isin(list(TESTS)), made(F.when(x["b"].isNotNull(), "literal_match").otherwise("test"), says(TESTS), x["b"]))
            .when(on.isin("compareTo", "compare"), made("comparison", F.concat(F.lit("compare "), left, F.lit(" with "), right)))
            .otherwise(made("test", b))
        )

    return F.when(text.isNotNull(), let(_trim(text), opened))


def meaning(parts: Column) -> Column:
    """One sentence for the parts of a condition, an array of (op, meaning)."""
    return F.array_join(F.transform(parts, lambda p: F.concat(F.when(p["op"] == "&&", " AND ").when(p["op"] == "||", " OR ").otherwise(""), p["meaning"])), "")
