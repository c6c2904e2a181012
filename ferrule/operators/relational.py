"""Relational building blocks: differences of snapshots, picks per group, lookups that keep their outcome."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """The status of every key of two snapshots: added, changed, unchanged or removed."""
    a = old.select(F.col(key), F.col(digest).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(F.col(key), F.col(digest).alias("_new"), F.lit(True).alias("_in_new"))
    status = (
        F.when(F.col("_in_old").isNull(), "added")
        .when(F.col("_in_new").isNull(), "removed")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged")
        .otherwise("changed")
    )
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def upsert(old: DataFrame, touched: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """``old`` without removed keys, touched rows replaced or added, the rest as it was."""
    rest = old.join(removed.select(key), key, "left_anti").join(touched.select(key), key, "left_anti")
    return rest.unionByName(touched)


def pick(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group; Spark drops the others before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def resolve(refs: DataFrame, ref: str, candidates: DataFrame, name: str, target: str) -> DataFrame:
    """Look references up by name and keep every one, with how it ended: resolved, ambiguous or unresolved.

    ``candidates`` has rows (``name``, ``target``). Adds status, targets (sorted, distinct) and n_targets.
    """
    known = candidates.groupBy(name).agg(F.array_sort(F.collect_set(target)).alias("targets"))
    joined = refs.join(known, F.col(ref) == F.col(name), "left").drop(name) if ref != name else refs.join(known, ref, "left")
    n = F.coalesce(F.size("targets"), F.lit(0))
    status = F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved")
    return joined.withColumns({"status": status, "n_targets": n, "targets": F.coalesce("targets", F.array().cast("array<string>"))})


def ladder(branches: Sequence[DataFrame], ref: str) -> DataFrame:
    """Candidates of the first branch that has any for a reference; ``priority`` says which."""
    union = reduce(DataFrame.unionByName, [b.withColumn("priority", F.lit(k)) for k, b in enumerate(branches)])
    return union.withColumn("_least", F.min("priority").over(Window.partitionBy(ref))).where("priority = _least").drop("_least")


def multiset_match(expected: DataFrame, actual: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per key: how many are expected, found among the actual ones, and extra."""
    a = expected.groupBy(*key).agg(F.count("*").alias("expected"))
    b = actual.groupBy(*key).agg(F.count("*").alias("have"))
    both = a.join(b, list(key), "full_outer").fillna(0, ["expected", "have"])
    return both.select(*key, "expected", F.least("expected", "have").alias("found"), F.greatest(F.col("have") - F.col("expected"), F.lit(0)).alias("extra"))
