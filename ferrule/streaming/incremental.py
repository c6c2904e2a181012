"""Keeping a table of documents up to date from a stream of versions. An extension: the batch operators need no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def latest(versions: DataFrame) -> DataFrame:
    """Of all versions (id, ts, hash, ...), the last of each id; equal times go to the greater hash. A null hash is a removal."""
    order = Window.partitionBy("id").orderBy(F.desc("ts"), F.desc_nulls_last("hash"))
    return versions.withColumn("_r", F.row_number().over(order)).where("_r = 1 and hash is not null").drop("_r")


def follow(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch of versions from ``source`` to the log ``target``, partitioned by batch; one run over what is there.

    A batch that is tried again overwrites its own partition, so each version is in the log once. ``latest`` reads the log.
    """

    def append(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["id", "ts", "hash"]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type, on a stream or a table; on a stream, events later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
