"""An inverted index kept up to date from a stream of document versions: postings as sums of deltas, by term bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ferrule.functions.text import tokens
from ferrule.operators.search import K1, B, counted
from ferrule.sources.tables import written

#: Folders that terms, and documents, are dealt over. A search reads those of its terms, a batch those of its documents.
BUCKETS = 64
#: About the most versions, and postings, of a folder that one task of a batch holds.
VERSIONS, POSTINGS = 50_000, 2_000_000
_FORWARD = "id long, ts timestamp, mark string, len long, terms array<struct<term:string,tf:long>>, replaced long, batch long, slot int"
_POSTINGS = "term string, id long, tf long, len long, batch long, bucket int"
_SIZES = "n long, len long, batch long"
#: What stands between the terms of a document while it is dealt; no term has it.
_BETWEEN = "\x01"


def _bucket(c: Column | str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def _part(c: str, rows: int, most: int) -> Column:
    """A part of a folder of about ``rows`` rows, so that each has about ``most``."""
    return F.pmod(F.xxhash64(F.lit(1), c), F.lit(1 + rows // most)).cast("int")


def _read(spark: SparkSession, root: str, part: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{root}/{part}")
    except AnalysisException:  # nothing has been written
        return spark.createDataFrame([], schema)


def apply(versions: DataFrame, number: int, root: str) -> None:
    """Add batch ``number`` of versions (id, ts, text) to the index under ``root``: the last of each document counts, a null text removes it.

    A version older than the one that the index has, or equal to it, changes nothing, so versions may come in any order and
    more than once; of equal times the greater text hash is the later one, a removal the earliest. What a document loses is
    appended as negative postings, what it gains as positive ones: a posting is the sum of its rows, as are the number and the
    length of documents, so nothing that is written is ever rewritten, and any batches that end in the same documents have the
    same sums. Only the folders of this batch's documents are read. Tried again, a batch reads the state before it and
    overwrites its own folders.

    Texts are counted where they are. What is dealt is the terms of a document, once, with the short heads of those that the
    index has, and its postings, once; nothing but the index and the list of replaced versions is written.
    """
    spark = versions.sparkSession
    new = versions.where("id is not null and ts is not null").select("id", "ts", "text", F.coalesce(F.md5("text"), F.lit("")).alias("mark"), _bucket("id").alias("slot"))
    slots = {r.slot: r["count"] for r in new.groupBy("slot").count().collect()}  # BUCKETS at most
    older = _read(spark, root, "forward", _FORWARD).where(F.col("slot").isin(list(slots)) & (F.col("batch") < number))
    # Terms as one string and a list of counts take less room than as structs.
    terms = F.array_join("terms.term", _BETWEEN).alias("words"), F.col("terms.tf").alias("tfs")
    rows = counted(new, "id", "ts", "mark", "slot").select("slot", "id", "ts", "mark", "len", *terms, F.lit(None).cast("long").alias("batch"))
    heads = older.select("slot", "id", "ts", "mark", "batch")
    # Dealt by folder and part of it, so that a folder takes few files, however many tasks there are, and no task holds a large folder.
    rows = rows.unionByName(heads, allowMissingColumns=True).withColumn("part", _part("id", max(slots.values(), default=0), VERSIONS)).repartition("slot", "part")
    order = Window.partitionBy("slot", "part", "id").orderBy(F.desc("ts"), F.desc("mark"), F.asc_nulls_last("batch"))
    last = F.max(F.when(F.col("batch").isNotNull(), F.struct("ts", "mark", "batch"))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    due = rows.withColumns({"_r": F.row_number().over(order), "replaced": last["batch"]}).where("_r = 1 and batch is null")
    pair = lambda word, tf: F.struct(word.alias("term"), tf.alias("tf"))
    terms = F.when(F.size("tfs") > 0, F.zip_with(F.split("words", _BETWEEN), "tfs", pair)).otherwise(F.when(F.col("tfs").isNotNull(), F.array().cast("array<struct<term:string,tf:long>>")))
    due.select("id", "ts", "mark", "len", terms.alias("terms"), "replaced", "slot").write.mode("overwrite").partitionBy("slot").parquet(f"{root}/forward/batch={number}")
    now = _read(spark, root, "forward", _FORWARD).where(F.col("batch") == number)
    moves = now.where("len is not null").select("id", "terms", "len", F.lit(1).alias("sign"))
    replaced = written(now.where("replaced is not null").select("id", F.col("replaced").alias("batch")))
    if again := not replaced.isEmpty():
        lost = older.where("len is not null").join(replaced, ["id", "batch"]).select("id", "terms", "len", F.lit(-1).alias("sign"))
        moves = moves.unionByName(lost)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sizes = moves.agg(total("sign").alias("n"), total(F.col("len") * F.col("sign")).alias("len"), total(F.size("terms")).alias("postings")).first()
    # Dealt once, by bucket and part: what is summed lies in one of them, and so does what a file takes.
    rows = moves.select("id", F.explode("terms").alias("t"), "sign", "len").select("t.term", "id", (F.col("t.tf") * F.col("sign")).alias("tf"), (F.col("len") * F.col("sign")).alias("len"))
    bucket, part = _bucket("term"), _part("id", sizes.postings // BUCKETS, POSTINGS)
    if not again:  # no two rows have the same term and document
        rows = rows.repartition(bucket, part).withColumn("bucket", bucket)
    else:
        rows = rows.withColumns({"bucket": bucket, "part": part}).repartition("bucket", "part")
        rows = rows.groupBy("bucket", "part", "term", "id").agg(F.sum("tf").alias("tf"), F.sum("len").alias("len")).where("tf <> 0 or len <> 0")
    rows.select("term", "id", "tf", "len", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/postings/batch={number}")
    spark.createDataFrame([(sizes.n, sizes.len)], "n long, len long").write.mode("overwrite").parquet(f"{root}/sizes/batch={number}")


def follow(spark: SparkSession, source: str, schema: StructType, root: str, checkpoint: str) -> StreamingQuery:
    """Apply each micro-batch of versions that lies in ``source``; one run over what is there."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(lambda batch, number: apply(batch, number, root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live(spark: SparkSession, root: str, terms: Sequence[str] | None = None) -> DataFrame:
    """The postings as they stand, of the given terms or all: term, id, tf, len. Folders of other terms are not read."""
    rows = _read(spark, root, "postings", _POSTINGS)
    if terms is not None:
        asked = spark.createDataFrame([(t,) for t in terms], "term string")
        buckets = [r[0] for r in asked.select(_bucket("term")).distinct().collect()]  # of the query's terms
        rows = rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(list(terms)))
    return rows.groupBy("term", "id").agg(F.sum("tf").alias("tf"), F.sum("len").alias("len")).where("tf > 0")


def search(spark: SparkSession, root: str, query: str, allowed: DataFrame | None = None) -> DataFrame:
    """The BM25 score of every document that holds a token of ``query``: id, score. ``allowed`` (id) restricts what is scored, not the statistics."""
    asked = spark.range(1).select(F.array_distinct(tokens(F.lit(query))).alias("t")).first().t
    n, total = _read(spark, root, "sizes", _SIZES).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("len"), F.lit(0))).first()
    held = written(live(spark, root, asked))
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    rows = held if allowed is None else held.join(allowed.select("id"), "id", "left_semi")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / (total / max(n, 1) or 1.0)))
    scored = rows.join(F.broadcast(df), "term")  # a row for each term of the query
    return scored.groupBy("id").agg(F.round(F.sum(part), 9).alias("score"))


def compact(spark: SparkSession, root: str, target: str) -> None:
    """Write the sums of all batches as batch -1 of a fresh index, to be followed from there; readers of ``root`` are not disturbed."""
    live(spark, root).withColumn("bucket", _bucket("term")).repartition("bucket").write.partitionBy("bucket").parquet(f"{target}/postings/batch=-1")
    last = F.max_by(F.struct("ts", "mark", "len", "terms", "slot"), F.struct("ts", "mark")).alias("v")
    _read(spark, root, "forward", _FORWARD).groupBy("id").agg(last).select("id", "v.*").repartition("slot").write.partitionBy("slot").parquet(f"{target}/forward/batch=-1")
    _read(spark, root, "sizes", _SIZES).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("len")).write.parquet(f"{target}/sizes/batch=-1")
