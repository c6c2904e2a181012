"""Tables, and durable copies of intermediate ones."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, ``spark.checkpoint.dir``; only a local session without one, as in a test, gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ferrule-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """A copy of ``df`` in the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """A copy of ``df`` as Parquet in the shared folder.

    Unlike a checkpoint it takes along no constraints, which the planner would multiply from step to step where a job builds
    many columns on one another, and readers read the columns they need.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def measured_joins(spark: SparkSession) -> Iterator[None]:
    """What runs within broadcasts by sizes that are measured as it runs, up to the session's threshold, not by sizes of files.

    The planner takes a share of a file's bytes for the size of some of its columns. Where the others repeat few values, the
    file is small, however many rows it has, and a join would send all of them through the driver.
    """
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k, None) for k in (planned, measured)}
    spark.conf.set(measured, before[measured] or spark.conf.get(planned))
    spark.conf.set(planned, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def gathered(df: DataFrame, *keys: str, order: Sequence[Column | str]) -> DataFrame:
    """``df`` with the rows of equal ``keys`` in one partition, sorted by ``order`` within each, for what folds over partitions.

    A hash of the keys is what rows are dealt by: the planner drops a repartition by columns that the rows already seem to be
    dealt by, and then, as a fold requires nothing that it knows of, may still split or merge the partitions of inputs beneath.
    """
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*order)
