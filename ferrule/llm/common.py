"""What several operators of this subpackage share: durable cuts of lineage and ranks without hot tasks."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, as the contracts define it: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Hash buckets in which distributed ranks are taken.
BUCKETS = 4096


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: ``spark.checkpoint.dir``. Only a local session without one, as in a test, gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ferrule-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from that copy."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(seed: int, doc_id: Column) -> Column:
    """64 seeded pseudo-random bits of an id, as 16 hex digits that sort like a shuffle."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 16)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_``, ``name__`` and so on that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Blocks of a Bloom filter, of 64 bits each, up to which it is broadcast.
MOST_BLOCKS = 1 << 20
#: Bits that each key sets in its block, and bits of the filter for each key.
PROBES, BITS_PER_KEY = 4, 16


def may_hold(rows: DataFrame, key: str, keys: DataFrame, out: str) -> DataFrame:
    """Add ``out`` to ``rows``: may the value of ``key`` be one of ``keys``? A blocked Bloom filter: true for every key, and for few others.

    The hashes of ``keys``, a materialized table of one column, are OR-ed into one word per block; the number of blocks goes
    with that of the keys. A filter of up to ``MOST_BLOCKS`` blocks, some 4 million keys, is broadcast, and ``rows`` are not
    shuffled; a larger one is joined by block. Null is never held.
    """
    blocks = 1 << max(8, (keys.count() * BITS_PER_KEY // 64).bit_length())
    h, mask = F.xxhash64(key), F.lit(0).cast("long")
    for k in range(PROBES):
        bit = F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    block = F.shiftrightunsigned(h, 6 * PROBES).bitwiseAND(blocks - 1)
    # Names that the rows' own columns leave free.
    at, mine, bits = (unused(rows, name) for name in ("block", "mask", "bits"))
    filled = keys.where(F.col(key).isNotNull()).select(block.alias(at), mask.alias(mine))
    bloom = filled.groupBy(at).agg(F.bit_or(mine).alias(bits))
    probed = rows.withColumns({at: block, mine: mask})
    probed = probed.join(F.broadcast(bloom) if blocks <= MOST_BLOCKS else bloom, at, "left")
    may = F.coalesce(F.col(bits).bitwiseAND(F.col(mine)) == F.col(mine), F.lit(False)) & F.col(key).isNotNull()
    return probed.withColumn(out, may).drop(at, mine, bits)


def running_sum(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str], value: str, out: str, total: str) -> DataFrame:
    """Add ``out``, the sum of ``value`` over the earlier rows of the group, and ``total``, over all its rows.

    Rows are ordered by ``bucket``, then by ``order``. A first aggregate sums every (group, bucket); a window over
    those few sums gives each bucket its base; only rows of one bucket are sorted together. So a group that holds
    most rows is still dealt over as many tasks as there are buckets. ``df`` is read twice: materialize it first.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        *[F.col(c).alias(f"_{c}") for c in [*group, bucket]],
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"),
        F.sum("_sum").over(whole).alias(total),
    )
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*group, bucket]]
    joined = ranked.join(bases, same)
    return joined.withColumn(out, F.col("_base") + F.col("_within")).drop("_base", "_within", *[f"_{c}" for c in [*group, bucket]])
