"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.common import BUCKETS, materialize, running_sum, shuffle_key

#: Bytes that a row's framing adds to its text.
FRAME = 16


def shard(docs: DataFrame, shards: int = 40, seed: int = 17) -> DataFrame:
    """Cut all documents into ``shards`` shards of one mixture, under the law ``rows``.

    The rows of each source are shuffled by a seeded hash of the text, then of the doc_id, and ranked. A row's place in the
    whole is its fractional rank, (2 rank - 1) / (2 rows of the source), so any stretch of that order holds each source in
    proportion; N rows in order are cut at multiples of N / shards. Both ranks come from ``running_sum``: no task ever holds
    a source. Texts are read once, for their size and checksum, and never shuffled.

    Equal texts have equal hashes: those of one source are neighbours, and those of several sources are at about the same
    place of each. So a group of equal texts shares a shard, unless a cut falls on it, or it is larger than a shard, as the
    counts, at most one apart, then demand; its source's rows in those shards are few texts, the mixture of sources holds.

    Returns doc_id, source, size, text_crc32, law, shard, slot, grown_shard. Shard counts are at most one apart and
    slots run without gaps from 0. A null source is a source of its own; a null text has size 16 and a null checksum;
    rows that repeat are dealt one by one; an empty table gives no rows; other columns are ignored.
    """
    rows = materialize(
        docs.select(
            "doc_id",
            "source",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + FRAME).cast("long").alias("size"),
            F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
            shuffle_key(seed, F.col("text")).alias("key"),
            shuffle_key(seed, F.col("doc_id")).alias("own"),
            F.lit(1).alias("one"),
        ).withColumn("coarse", F.conv(F.substring("key", 1, 3), 16, 10).cast("long"))
    )
    # Coarse buckets follow the texts, long so that their products with the rows are; one that holds more than its share, as that of a very frequent text, is dealt by doc_id.
    n = rows.count()
    counts = rows.groupBy("coarse").agg(F.greatest(F.lit(1), F.floor(F.count("*") * BUCKETS / max(n, 1))).alias("parts"))
    part = F.pmod(F.conv(F.substring("own", 1, 8), 16, 10).cast("long"), F.col("parts"))
    rows = materialize(rows.join(F.broadcast(counts), "coarse").withColumn("bucket", F.col("coarse") * n + part).drop("coarse", "parts"))  # BUCKETS counts at most
    ties = ["key", "own", "doc_id", "size", "text_crc32"]
    ranked = running_sum(rows, ["source"], "bucket", ties, "one", "before", "of_source")
    place = (2 * F.col("before") + 1) / (2 * F.col("of_source"))
    placed = materialize(ranked.drop("bucket").withColumn("place", place).withColumn("bucket", F.floor(F.col("place") * BUCKETS)))
    dealt = running_sum(placed, [], "bucket", ["place", F.col("source").asc_nulls_last(), *ties], "one", "position", "n")
    index = F.expr(f"(position * {shards}) div n")
    first = F.expr(f"(shard * n + {shards - 1}) div {shards}")
    return dealt.withColumn("shard", index).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("position") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_whole(docs: DataFrame, shards: int = 40, seed: int = 17) -> DataFrame:
    """The documents with all their columns, dealt as ``shard`` does: every column of ``docs``, then shard and slot, which replace columns of those names.

    Rows of equal doc_id, source, size and checksum are told apart by a number within them. Texts are shuffled once: the join
    with what ``shard`` dealt is by the hash that the numbers are counted in. Columns of any other name are kept, for a row
    travels as one value.
    """
    docs = docs.drop("shard", "slot")
    keys = ["doc_id", "source", "size", "crc"]
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + FRAME).cast("long")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, "doc_id", "source", size.alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("crc"), F.xxhash64("text").alias("tie"))
    dealt = shard(docs, shards, seed).select("doc_id", "source", "size", F.col("text_crc32").alias("crc"), "shard", "slot")

    def nth(df: DataFrame, *order: str) -> DataFrame:
        df = df.withColumn("key", F.xxhash64(*keys))
        return df.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(*keys, *order)))

    places = nth(dealt, "shard", "slot").select("key", F.col("n").alias("m"), "shard", "slot")
    joined = nth(rows, "tie").select("row", "key", "n").join(places, "key").where(F.col("n") - F.col("m") == 0)
    return joined.select(*[F.col("row")[c].alias(c) for c in docs.columns], "shard", "slot")
