"""Joins of intervals. Every one asks for an equi key: a join on ranges alone would compare all rows with all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _keyed(a: DataFrame, b: DataFrame, key: Sequence[str]):
    if not key:
        raise ValueError("an interval join needs an equi key")
    same = F.lit(True)
    for k in key:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.alias("a"), b.alias("b"), same


def containing(inner: DataFrame, outer: DataFrame, key: Sequence[str], proper: bool = True, how: str = "inner") -> DataFrame:
    """Pairs of intervals [start, end] of one key where outer (b) holds inner (a); ``proper`` leaves equal ones out."""
    a, b, same = _keyed(inner, outer, key)
    held = (F.col("b.start") <= F.col("a.start")) & (F.col("a.end") <= F.col("b.end"))
    if proper:
        held = held & ((F.col("b.start") < F.col("a.start")) | (F.col("a.end") < F.col("b.end")))
    return a.join(b, same & held, how)


def outermost(intervals: DataFrame, key: Sequence[str]) -> DataFrame:
    """Intervals that no other of their key properly contains."""
    return containing(intervals, intervals, key, how="left_anti")


def near(a: DataFrame, b: DataFrame, key: Sequence[str], before: float = 0, after: float = 0) -> DataFrame:
    """Pairs where b meets a, a being widened by ``before`` at its start and ``after`` at its end."""
    x, y, same = _keyed(a, b, key)
    return x.join(y, same & (F.col("b.start") <= F.col("a.end") + after) & (F.col("b.end") >= F.col("a.start") - before))


def innermost(points: DataFrame, scopes: DataFrame, key: Sequence[str], point_id: Sequence[str]) -> DataFrame:
    """Each point with the scope of its key that holds it and starts last, the later one of equal starts; others with nulls.

    ``points`` have ``at``, ``scopes`` start, end and ord.
    """
    a, b, same = _keyed(points, scopes, key)
    joined = a.join(b, same & (F.col("b.start") <= F.col("a.at")) & (F.col("a.at") <= F.col("b.end")), "left")
    order = Window.partitionBy(*[F.col(f"a.{c}") for c in point_id]).orderBy(F.col("b.start").desc_nulls_last(), F.col("b.ord").desc())
    return joined.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
