"""Models of several tables that are replaced as a whole: written aside, published by one pointer, read as of a version."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators.relational import upsert

_POINTER = "table string, path string, version long"


@dataclass(frozen=True)
class Snapshot:
    """One version of a model, which later versions do not change: where each of its tables lies. Version 0 has none."""

    spark: SparkSession
    root: str
    version: int
    paths: Mapping[str, str]

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.paths[table])


def _pointers(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(_POINTER).parquet(f"{root}/published")
    except AnalysisException:  # nothing is published
        return spark.createDataFrame([], _POINTER)


def versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(r.version for r in _pointers(spark, root).select("version").distinct().collect())


def current(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """The version published last, or the given one. A reader keeps what it has, whatever is published meanwhile."""
    rows = _pointers(spark, root)
    found = rows.agg(F.max("version")).first()[0] if version is None else version
    paths = {r.table: r.path for r in rows.where(F.col("version") == F.lit(found)).collect()}  # a row for each table of the model
    if version is not None and not paths:
        raise ValueError(f"no version {version} under {root}")
    return Snapshot(spark, root, found or 0, paths)


def _publish(base: Snapshot, paths: Mapping[str, str]) -> Snapshot:
    """Name the tables of the next version in one small file, which appears whole or not at all; a writer that was slower than another fails."""
    n = base.version + 1
    base.spark.createDataFrame(sorted(paths.items()), "table string, path string").coalesce(1).write.mode("errorifexists").parquet(f"{base.root}/published/version={n}")
    return Snapshot(base.spark, base.root, n, dict(paths))


def _written(base: Snapshot, tables: Mapping[str, DataFrame]) -> dict[str, str]:
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{base.root}/tables/{name}-{uuid.uuid4().hex}"
        df.write.parquet(paths[name])
    return paths


def replace_model(spark: SparkSession, root: str, tables: Mapping[str, DataFrame]) -> Snapshot:
    """Publish ``tables`` as the whole model. Until the last of them is written, and if any fails, readers find the version before."""
    base = current(spark, root)
    return _publish(base, _written(base, tables))


def replace_parts(base: Snapshot, changes: Mapping[str, DataFrame], key: str, removed: DataFrame | None = None) -> Snapshot:
    """Publish ``base`` with the rows of some keys, such as files, replaced in some tables.

    Rows of the keys that a table's change has, and of those in ``removed``, go from that table, and the change comes in; of
    tables that are not named, ``removed`` keys go where they have the column ``key``. Tables that nothing touches are not written anew:
    the new version points to where they are.
    """
    made = {}
    for name in base.paths:
        old = base.read(name)
        if name in changes:
            new = changes[name].select(*old.columns)
            gone = new.select(key).distinct() if removed is None else new.select(key).unionByName(removed.select(key)).distinct()
            made[name] = upsert(old.join(gone, key, "left_anti").select(*old.columns), new, gone.where("false"), key)
        elif removed is not None and key in old.columns:
            made[name] = old.join(removed.select(key).distinct(), key, "left_anti").select(*old.columns)
    return _publish(base, {**base.paths, **_written(base, made)})


def unused(spark: SparkSession, root: str, keep: Iterable[int]) -> list[str]:
    """Folders of tables that none of the versions to ``keep`` points to, for the cluster's own clean-up to delete."""
    rows = _pointers(spark, root)
    kept = rows.where(F.col("version").isin(list(keep))).select("path").distinct()
    return sorted(r.path for r in rows.select("path").distinct().join(kept, "path", "left_anti").collect())
