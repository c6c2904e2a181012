"""Filling a budget of tokens by category, with what categories leave over going to the items that did not fit."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.functions.text import CHARS_PER_TOKEN
from ferrule.sources.tables import durable, gathered

# Shares of the categories of a context, and tokens that a part of an item must have to be worth keeping.
SHARES = {"target": 0.35, "callees": 0.25, "flow": 0.20, "evidence": 0.20}
LEAST_PART = 60
MARKER = "[... truncated]"

Batches = Iterator[pa.RecordBatch]


def _stream(start: Callable[[dict], object], take: Callable[[dict, object], tuple], names: list[str]) -> Callable[[Batches], Batches]:
    """Fold rows that come sorted by ``group``: ``take`` gives each row's outcome from the state, a list that it changes; no group is ever held."""

    def run(batches: Batches) -> Batches:
        group, state = object(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["group"] != group:
                    group, state = row["group"], start(row)
                out.append(take(row, state))
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            kinds = {"taken": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, columns, strict=True)], names)

    return run


def part_tokens(lines: list[int], room: int) -> int:
    """Tokens of a text of these line lengths, cut to ``room`` tokens as ``cut_to_tokens`` does: as many whole lines as end within it, and the marker."""
    ends = [0, *accumulate(n + 1 for n in lines)]
    kept = bisect_right(ends, max(0, int(room * CHARS_PER_TOKEN) - len(MARKER) - 1)) - 1
    return max(1, math.ceil((ends[kept] + len(f"{MARKER} ({len(lines) - kept} more lines)")) / CHARS_PER_TOKEN))


def fill(items: DataFrame, key: str, id_: str, limit: int, shares: Mapping[str, float] = SHARES, partial: bool = True) -> DataFrame:
    """Which items fit a budget of ``limit`` tokens per ``key``: key, id, state, used.

    ``items`` has key, id, category, priority, tokens and, if ``partial``, text. Each category has its share, rounded down, of
    the budget and takes its items by priority and id; one that does not fit is passed over, and later ones may still fit.
    What the categories leave over is a pool, and what was passed over takes from it by priority, category and id. ``partial``:
    an item too large for the pool gets what is left of it, if that is ``LEAST_PART`` tokens, cut between lines. States are
    ``kept``, ``pooled``, ``shortened`` and ``omitted``; ``used`` are the tokens taken, and ``room`` those a shortened item had.

    Whether an item fits depends on all before it, so each pass is a fold; it streams over sorted partitions and holds
    nothing but the room left, so a key may have any number of items. Items of other categories are left out, as are those of a
    null key; null priorities come first.
    """
    total = sum(shares.values()) or 1.0
    allotted = {c: int(limit * v / total) for c, v in shares.items()}
    table = F.create_map(*[F.lit(x) for k, c in enumerate(shares) for x in (c, k)])
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.length(x)) if partial else F.array().cast("array<int>")
    rows = items.withColumns({"_cat": F.try_element_at(table, F.col("category")), "_lines": lines}).where(F.col("_cat").isNotNull() & F.col(key).isNotNull())
    rows = durable(rows.select(F.col(key).alias("_key"), F.col(id_).alias("_id"), "category", "_cat", "priority", F.col("tokens").cast("long").alias("cost"), "_lines").withColumn("uid", F.monotonically_increasing_id()))

    group = F.struct(F.col("_key").cast("string"), "category")
    sorted_ = rows.select(group.alias("group"), "category", "priority", "_id", "cost", "uid")
    sorted_ = gathered(sorted_, "group", order=["group", "priority", "_id"])

    def first(row: dict, room: list[int]) -> tuple:
        fits = row["cost"] <= room[0]
        room[0] -= row["cost"] if fits else 0
        return row["uid"], fits

    passed = sorted_.mapInArrow(_stream(lambda row: [allotted[row["category"]]], first, ["uid", "taken"]), "uid long, taken boolean")
    judged = durable(rows.join(passed, "uid"))
    pools = judged.where("taken").groupBy("_key").agg(F.sum("cost").alias("spent"))
    over = judged.where("not taken").join(pools, "_key", "left")
    over = over.select(F.col("_key").cast("string").alias("group"), "priority", "_cat", "_id", "cost", "uid", "_lines", (F.lit(sum(allotted.values())) - F.coalesce("spent", F.lit(0))).alias("pool"))

    def second(row: dict, room: list[int]) -> tuple:
        left = room[0]
        if row["cost"] <= left:
            room[0] -= row["cost"]
            return row["uid"], row["cost"], None
        if partial and left >= LEAST_PART:
            used = part_tokens(row["_lines"] or [0], left)
            room[0] -= used
            return row["uid"], used, left
        return row["uid"], 0, None

    def spill(batches: Batches) -> Batches:
        yield from _stream(lambda row: [row["pool"]], second, ["uid", "used", "room"])(batches)

    schema = "uid long, used long, room long"
    pooled = gathered(over, "group", order=["group", "priority", "_cat", "_id"]).mapInArrow(spill, schema)
    state = F.when(F.col("taken"), "kept").when(F.col("room").isNotNull(), "shortened").when(F.col("used") > 0, "pooled").otherwise("omitted")
    used = F.when(F.col("taken"), F.col("cost")).otherwise(F.coalesce("used", F.lit(0)))
    joined = judged.join(pooled, "uid", "left").withColumns({"state": F.when(~F.col("taken") & (F.col("cost") == 0) & F.col("room").isNull(), "pooled").otherwise(state), "_used": used})
    return joined.select(F.col("_key").alias(key), F.col("_id").alias(id_), "state", F.col("_used").alias("used"), "room")
