"""Metrics of what was found about methods against what is expected of them: found, expected and the missing ones; none expected gives no percentage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.text import ratio
from ferrule.operators.graph import reach
from ferrule.operators.relational import multiset_match


def squashed(text: Column) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(text, r"[ \t\r\n\f\x0B]+", ""))


def totals(rows: DataFrame, found: Column, what: Column, id_: str = "method_id") -> DataFrame:
    """One row per method of expectation rows: found, expected, missing (sorted), percent."""
    sums = rows.groupBy(id_).agg(F.count_if(found).alias("found"), F.count("*").alias("expected"), F.array_sort(F.collect_list(F.when(~found, what))).alias("missing"))
    return sums.withColumn("percent", ratio(F.col("found"), F.col("expected")))


def mentions(texts: DataFrame, words: DataFrame, id_: str = "method_id") -> DataFrame:
    """How many of the expected ``words`` (id, word) a method's ``texts`` (id, text) hold, any case: purposes and admitted unknowns."""
    joined = words.join(texts.select(id_, F.lower("text").alias("_text")), id_, "left")
    return totals(joined, F.coalesce(F.col("_text").contains(F.lower("word")), F.lit(False)), F.col("word"), id_)


def structure(expected: DataFrame, actual: DataFrame, id_: str = "method_id") -> DataFrame:
    """Expected parts of methods (id, part) against the ``actual`` ones, as multisets without regard to white space and case: found, expected, extra, percent."""
    key = [id_, "part"]
    plain = [df.select(id_, squashed(F.col("part")).alias("part")) for df in (expected, actual)]
    sums = multiset_match(*plain, key).groupBy(id_).agg(*[F.sum(c).alias(c) for c in ("found", "expected", "extra")])
    return sums.withColumn("percent", ratio(F.col("found"), F.col("expected")))


def flows(edges: DataFrame, pairs: DataFrame, id_: str = "method_id", depth: int = 64) -> DataFrame:
    """Expected flows (id, source, target) that the value edges of the method (id, source, target, via, detail) lead along.

    Names are nodes of their method's graph; an argument also flows into what it is passed to, the edge's ``detail``. Nothing
    flows from a name to itself. Paths of up to ``depth`` edges are followed, from the expected sources only.
    """
    node = lambda c: F.struct(F.col(id_).alias("m"), F.col(c).alias("n"))
    passed = edges.where("via = 'argument' and detail is not null and detail <> ''")
    graph = edges.select(node("source").alias("src"), node("target").alias("dst")).unionByName(passed.select(node("source").alias("src"), node("detail").alias("dst")))
    wanted = pairs.withColumns({"start": node("source"), "node": node("target")})
    reached = reach(graph, wanted.select("start").distinct(), depth).select("start", "node", F.lit(True).alias("_led"))
    joined = wanted.join(reached, ["start", "node"], "left")
    return totals(joined, F.coalesce("_led", F.lit(False)), F.concat_ws(" -> ", "source", "target"), id_)


def rules(expected: DataFrame, actual: DataFrame, id_: str = "method_id") -> DataFrame:
    """Expected rules matched one to one, each with the first rule in order that fits and that none before it took: found, expected, extra, percent.

    ``expected`` has id, ord, kind, literal, contains; ``actual`` id, ord, kind, literals, text. A rule fits if its kind is the
    same, it has the literal, if one is asked for, and its text holds ``contains``, in any case. A join would count a
    rule twice, so the few rules of a method are two arrays and a fold whose state is which of them are taken.
    """
    want = F.struct("ord", "kind", "literal", F.lower("contains").alias("contains"))
    have = F.struct("ord", "kind", "literals", F.lower("text").alias("text"))
    a = expected.groupBy(id_).agg(F.array_sort(F.collect_list(want)).alias("_want"))
    b = actual.groupBy(id_).agg(F.array_sort(F.collect_list(have)).alias("_have"))
    both = a.join(b, id_, "left").withColumn("_n", F.coalesce(F.size("_have"), F.lit(0)))

    def fits(w: Column, r: Column) -> Column:
        return (r["kind"] == w["kind"]) & (w["literal"].isNull() | F.array_contains(r["literals"], w["literal"])) & (w["contains"].isNull() | r["text"].contains(w["contains"]))

    def take(taken: Column, w: Column) -> Column:
        at = F.array_position(F.transform("_have", lambda r, i: F.coalesce(fits(w, r), F.lit(False)) & ~F.array_contains(taken, i)), True)
        return F.when(at > 0, F.array_append(taken, (at - 1).cast("int"))).otherwise(taken)

    taken = F.aggregate("_want", F.array().cast("array<int>"), take)
    counted = both.withColumn("_taken", F.when(F.col("_n") > 0, taken).otherwise(F.array().cast("array<int>")))
    found, wanted = F.size("_taken").cast("long"), F.size("_want").cast("long")
    return counted.select(id_, found.alias("found"), wanted.alias("expected"), (F.col("_n") - F.size("_taken")).cast("long").alias("extra"), ratio(found, wanted).alias("percent"))


def summary(ratios: DataFrame, by: str = "metric") -> DataFrame:
    """Totals of ratios (``by``, found, expected) over all methods."""
    return ratios.groupBy(by).agg(F.sum("found").alias("found"), F.sum("expected").alias("expected")).withColumn("percent", ratio(F.col("found"), F.col("expected")))


def evaluated(expected: DataFrame, measured: DataFrame, id_: str = "method_id") -> DataFrame:
    """Expected methods with what was measured of them; ``known`` is false for those that were not found, which stay."""
    return expected.select(id_).distinct().join(measured.withColumn("known", F.lit(True)), id_, "left").fillna(False, ["known"])
