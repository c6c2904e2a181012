"""Mixing sources to target weights on a low-discrepancy schedule; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.common import BUCKETS, materialize, running_sum, shuffle_key, word_count

#: Times that the mix may take one source, and so one document.
MOST_PASSES = 3
#: Words of a block, which one slot of the schedule takes: at most, and fewer where that would make less than LEAST_SLOTS slots,
#: so that the few slots by which a low-discrepancy sequence may miss a share are a small share of any corpus.
BLOCK_WORDS, LEAST_SLOTS = 128, 1 << 18
#: The golden-ratio sequence in whole numbers: point i is (i * STEP mod PERIOD) / PERIOD. STEP is the odd number nearest PERIOD / 1.618.
PERIOD, STEP = 1 << 31, 1327217885


def _targets(rows: DataFrame) -> DataFrame:
    """One row per source: sid, source, source_size and target.

    Water filling: sources in the order of most words per weight; a source is full if its level, what is left over the
    weights that are left, reaches that. A window over all sources, of which there is one row each.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("sid", F.row_number().over(order)).withColumn("weight", (F.col("sid") - 1) % 3 + 1)
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - MOST_PASSES * F.coalesce(F.sum("source_size").over(fill), F.lit(0))
    weights = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(fill), F.lit(0))
    full = MOST_PASSES * F.col("source_size") <= F.col("level") * F.col("weight")
    leveled = ranked.withColumn("level", left / weights).withColumn("full", full)
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)
    target = F.when(F.col("full"), (MOST_PASSES * F.col("source_size")).cast("double")).otherwise(level * F.col("weight"))
    return leveled.withColumn("target", target).select("sid", "source", "source_size", "target")


def block_words(total: int) -> int:
    """Words of a block of a mix of ``total`` words."""
    return max(1, min(BLOCK_WORDS, total // LEAST_SLOTS))


def _schedule(sources: DataFrame, total: int) -> DataFrame:
    """The slots: sid, slot, and rank, the slot's number among those of its source.

    Slot i draws the golden-ratio point i, which the cumulative targets map to a source: how often and where a source is
    drawn is what the sequence says, within a few slots of its share at any place of the mix. The map is an equi-join on the
    cell of the unit interval; a source lists the cells it touches. Ranks come from ``running_sum`` over stretches of the
    schedule.
    """
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    ends = sources.select("sid", F.coalesce(F.sum("target").over(before), F.lit(0.0)).alias("lo"), F.sum("target").over(before.rowsBetween(Window.unboundedPreceding, 0)).alias("hi"))
    all_ = F.max("hi").over(Window.partitionBy())
    spans = ends.select("sid", *[F.floor(F.col(c) / all_ * PERIOD).alias(c) for c in ("lo", "hi")]).where("lo < hi")
    size = PERIOD // BUCKETS
    cells = spans.select("sid", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {size}"), F.expr(f"(hi - 1) div {size}"))).alias("cell"))
    n = -(-total // block_words(total))
    slots = sources.sparkSession.range(n).withColumnRenamed("id", "slot").withColumn("point", F.col("slot") % PERIOD * STEP % PERIOD)
    drawn = slots.withColumn("cell", F.expr(f"point div {size}")).join(cells, "cell").where("point >= lo and point < hi")
    drawn = materialize(drawn.select("sid", "slot", F.expr(f"(slot * {BUCKETS}) div {max(n, 1)}").alias("bucket"), F.lit(1).alias("one")))
    return running_sum(drawn, ["sid"], "bucket", ["slot"], "one", "rank", "drawn").select("sid", "slot", "rank", "drawn")


def _plan(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with size and outcome of their source, ``start`` null without words; and the pieces of them that the slots take.

    (sid, start) tells the rows with words apart.
    """
    rows = materialize(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), shuffle_key(seed, F.col("doc_id")).alias("key"), F.xxhash64("text").alias("mark"))
    )
    sources = materialize(_targets(rows))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    words = block_words(total)
    schedule = materialize(_schedule(sources, total))
    drawn = schedule.groupBy("sid").agg(F.max("drawn").alias("drawn"))
    most = F.least(F.coalesce("drawn", F.lit(0)) * words, MOST_PASSES * F.col("source_size"))
    sources = sources.join(drawn, "sid", "left").select(F.col("source").alias("_source"), "sid", "source_size", "target", most.alias("most"))
    sized = rows.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    sized = materialize(sized.withColumn("bucket", F.substring("key", 1, 3)))
    placed = running_sum(sized.where("size > 0"), ["sid"], "bucket", ["key", "doc_id", "size", "mark"], "size", "start", "stream")
    placed = materialize(placed.select("doc_id", "source", "size", "mark", "source_size", "target", "sid", "most", "start"))
    passes = F.explode(F.sequence(F.lit(0), F.lit(MOST_PASSES - 1))).alias("pass")
    spread = placed.select("doc_id", "source", "size", "source_size", "sid", "start", "most", passes)
    spread = spread.withColumn("lo", F.col("start") + F.col("pass") * F.col("source_size"))
    spread = spread.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("most"))).where("lo < hi")
    pieces = spread.withColumn("rank", F.explode(F.sequence(F.expr(f"lo div {words}"), F.expr(f"(hi - 1) div {words}"))))
    head, tail = F.greatest("lo", F.col("rank") * words), F.least("hi", (F.col("rank") + 1) * words)
    pieces = pieces.select(
        "sid",
        "rank",
        "start",
        "source",
        "doc_id",
        "pass",
        (head - F.col("rank") * words).alias("at"),
        (head - F.col("lo")).alias("first"),
        (tail - F.col("lo")).alias("last"),
    )
    empty = sized.where("size = 0").select("doc_id", "source", "size", "mark", "source_size", "target", "sid", "most", F.lit(None).cast("long").alias("start"))
    return placed.unionByName(empty), pieces.join(schedule.drop("drawn"), ["sid", "rank"]).drop("rank")


def blocks(docs: DataFrame, seed: int = 29) -> DataFrame:
    """The mix itself, what each slot takes: slot, at, source, doc_id, pass, first, last.

    The order of the slots, counted from 0, is the interleaving of the sources; a slot that is drawn for a source which has
    been taken ``MOST_PASSES`` times by then stays empty. A slot takes one block of one source, which is a run of pieces of
    documents: ``at`` words of the block come before the piece, the words ``first`` to ``last`` of the document, counted
    from 0, end exclusive, in its ``pass``, from 0. Ordered by slot and ``at``, the pieces are the mixed text. See ``mix``
    for the sources' shares and streams.
    """
    _, pieces = _plan(docs, seed)
    return pieces.select("slot", "at", "source", "doc_id", "pass", "first", "last")


def mix(docs: DataFrame, seed: int = 29) -> DataFrame:
    """How many words of each document the mix takes, and from which slot on.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share as many words as there are; a target stops at
    three times its source, the excess reshared by weight. Each source is a stream: its documents in seeded-shuffled
    order, repeated, cut into blocks of ``block_words`` words. Slot number r that the schedule draws for a source takes the
    stream's block r; the stream ends after three passes. So what a source gives is what its slots take: its target but
    for the few slots of the sequence's discrepancy. A document is taken at most once in each pass. All orders come from
    seeded hashes: reruns agree. ``blocks`` has the slots in their order; here they are summed by document.

    Returns the columns of ``docs`` it needs and the outcome: doc_id, source, size, source_size, target, taken, first_slot
    (null if nothing is taken). Documents without words (or text) have size 0 and are taken 0 times; null ids and sources
    are values like others; rows that repeat are mixed one by one; an empty table gives no rows; other columns are ignored.
    """
    rows, pieces = _plan(docs, seed)
    sums = pieces.groupBy(F.col("sid").alias("_sid"), F.col("start").alias("_start")).agg(F.sum(F.col("last") - F.col("first")).alias("taken"), F.min("slot").alias("first_slot"))
    mixed = rows.join(sums, (F.col("sid") == F.col("_sid")) & (F.col("start") == F.col("_start")), "left")
    return mixed.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def mixed(docs: DataFrame, seed: int = 29, slot: str | None = None, ordered: bool = True) -> DataFrame:
    """The documents as the mix takes them, with all their columns: each as often as the words taken hold it, rounded.

    Rows come in the order of the mix: each copy stands at the first slot that takes a word of it, copies of one slot in
    the order of its block. That order costs a sort of all rows; where a next step deals them anew, ``ordered`` is False.
    ``slot`` names a column to keep that slot in. Rows of equal doc_id, source, size and text are told apart by a number
    within them, so that repeated rows are not multiplied. Columns of any name are kept, for a row travels as one value.
    """
    keys = ["doc_id", "source", "size", "mark"]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    numbered = docs.select(whole, "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"))
    numbered = numbered.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))))
    rows, pieces = _plan(docs, seed)
    turns = pieces.groupBy("sid", "start", "pass").agg(F.sum(F.col("last") - F.col("first")).alias("words"), F.min(F.struct("slot", "at")).alias("turn"))
    turn = F.struct("pass", "turn")
    plan = turns.groupBy(F.col("sid").alias("_sid"), F.col("start").alias("_start")).agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(turn)).alias("turns"))
    plan = rows.where("size > 0").join(plan, (F.col("sid") == F.col("_sid")) & (F.col("start") == F.col("_start")))
    plan = plan.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("taken"), "start")))
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    plan = plan.select(*[F.col(c).alias(f"_{c}") for c in [*keys, "n"]], F.slice("turns", F.lit(1), copies).alias("turns"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*keys, "n"]]
    joined = numbered.join(plan.where("size(turns) > 0"), same).select("row", F.explode("turns.turn").alias("turn"))
    joined = joined.orderBy("turn.slot", "turn.at") if ordered else joined
    kept = [F.col("turn.slot").alias(slot)] if slot else []
    return joined.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != slot], *kept)
