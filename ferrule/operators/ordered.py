"""Operators that depend on the order of rows within a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_sections(lines: DataFrame, key: Sequence[str], line: str, is_head: Column) -> DataFrame:
    """Add ``section``: 0 up to the first head, then the number of heads so far."""
    order = Window.partitionBy(*key).orderBy(line).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("section", F.sum(F.when(is_head, 1).otherwise(0)).over(order))


def islands(rows: DataFrame, key: Sequence[str], order: str, kind: str) -> DataFrame:
    """Add ``island``, counted from 1: rows that follow one another with the same kind share it."""
    w = Window.partitionBy(*key).orderBy(order)
    change = F.when(F.lag(kind).over(w).eqNullSafe(F.col(kind)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("_change", change).withColumn("island", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_change")


def labels(rows: DataFrame, key: Sequence[str], within: Sequence[str], order: str, prefix: str = "E") -> DataFrame:
    """Add ``label``: prefix and number of the key by first occurrence in ``order``."""
    first = F.min(order).over(Window.partitionBy(*within, *key))
    return rows.withColumn("_first", first).withColumn("label", F.concat(F.lit(prefix), F.dense_rank().over(Window.partitionBy(*within).orderBy("_first")).cast("string"))).drop("_first")


def greedy_fill(items: DataFrame, key: Sequence[str], id_: str, cost: str, order: Sequence[str], budget: Column) -> DataFrame:
    """Per group, take items in order while they fit what is left; one that does not fit is skipped, and smaller later ones may still fit.

    No window can say this: whether an item fits depends on which earlier ones did. The fold runs over each group's array of
    (id, cost), so a group must fit a task; returns a row per item: taken.
    """
    item = F.struct(*order, F.col(id_).alias("_id"), F.col(cost).cast("long").alias("_cost"))
    groups = items.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("_items"), F.first(budget).cast("long").alias("_budget"))
    start = F.struct(F.col("_budget").alias("room"), F.array().cast("array<boolean>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = x["_cost"] <= acc["room"]
        return F.struct((acc["room"] - F.when(fits, x["_cost"]).otherwise(0)).alias("room"), F.concat(acc["taken"], F.array(fits)).alias("taken"))

    folded = groups.withColumn("_taken", F.aggregate("_items", start, step, lambda acc: acc["taken"]))
    pairs = folded.select(*key, F.explode(F.arrays_zip("_items", "_taken")).alias("p"))
    return pairs.select(*key, F.col("p._items._id").alias(id_), F.col("p._items._cost").alias(cost), F.col("p._taken").alias("taken"))


def collapse_tail(rows: DataFrame, key: Sequence[str], order: str, title: str, most: int = 12) -> DataFrame:
    """At most ``most`` rows per group: beyond that the last ones become one row that counts them: key, ord, title, n, first, last.

    ``first`` and ``last`` are the ``order`` of what a row stands for. Only the tail's count and ends are aggregated.
    """
    place = Window.partitionBy(*key).orderBy(order)
    ranked = rows.withColumns({"_r": F.row_number().over(place), "_n": F.count("*").over(Window.partitionBy(*key))})
    tail = (F.col("_n") > most) & (F.col("_r") >= most)
    slot = F.when(tail, most).otherwise(F.col("_r")).alias("ord")
    groups = ranked.groupBy(*key, slot).agg(F.count("*").alias("n"), F.min_by(title, order).alias("_title"), F.min(order).alias("first"), F.max(order).alias("last"))
    named = F.when(F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit(" further steps"))).otherwise(F.col("_title"))
    return groups.select(*key, "ord", named.alias("title"), "n", "first", "last")
