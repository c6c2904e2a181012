"""Audit of how far the sources of a language diverge: term frequencies compared by exact products of one-hot levels."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.common import materialize

#: Documents of a language that must hold a term; what is added to every count; parts that frequencies are counted in; terms listed of a group.
LEAST_DOCS, SMOOTH, SCALE, LISTED = 30, 5, 1_000_000_000, 50
#: Terms and groups on either side of a block, which one task multiplies; terms and groups of one product within it.
TERMS, GROUPS, SLICE, TILE = 4_096, 64, 128, 16
#: Counts that a task holds before it passes them on, and bytes of a text that it splits at a time.
HELD, STRETCH = 100_000, 1 << 20

#: Bytes that are in no term become spaces, A-Z lower case; bytes of letters beyond ASCII stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

Batches = Iterator[pa.RecordBatch]


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, a stretch at a time: runs of ASCII letters, lower-cased, and characters beyond ASCII."""
    folded = text.translate(_FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + STRETCH)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _count(batches: Batches) -> Batches:
    """Occurrences of terms by group, and documents that hold them; the empty term stands for the group itself, once or more."""
    counts: dict[tuple[str, str], Counter[bytes]] = {}
    docs: dict[tuple[str, str], Counter[bytes]] = {}
    held = 0

    def flush() -> pa.RecordBatch:
        rows = [(*group, term, n, docs[group][term]) for group, found in counts.items() for term, n in found.items()]
        rows += [(*group, b"", 0, 0) for group in counts]
        counts.clear()
        docs.clear()
        lang, source, term, n, in_docs = zip(*rows, strict=True) if rows else ((), (), (), (), ())
        columns = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(in_docs, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
            group = counts.setdefault((lang, source), Counter())
            held -= len(group)
            distinct: set[bytes] = set()
            for words in terms(text.as_py()):
                group.update(words)
                distinct.update(words)
            docs.setdefault((lang, source), Counter()).update(distinct)
            held += len(group)
            if held > HELD:
                yield flush()
                held = 0
    yield flush()


def _frequency(n: str, total: str, v: str) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * v)), by decimals, which no count of any corpus overflows; null without kept terms."""
    part, whole = f"cast({SCALE} as decimal(10,0)) * (cast({n} as decimal(19,0)) + {SMOOTH})", f"cast({total} + {SMOOTH} * {v} as decimal(19,0))"
    return F.expr(f"case when {v} > 0 then ({part}) div {whole} + 1 end")


def _levels(counts: np.ndarray, prices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indicator columns (group, count level) of a block of terms: the one-hot matrix, the price of each column, and where each group's columns start."""
    n, groups = counts.shape
    hot, price, first, columns = [], [], [], 0
    for g in range(groups):
        _, at, level = np.unique(counts[:, g], return_index=True, return_inverse=True)
        hot.append(level + columns)
        price.append(prices[at, g])
        first.append(columns)
        columns += len(at)
    matrix = np.zeros((n, columns), np.float32)
    for level in hot:
        matrix[np.arange(n), level] = 1
    return matrix, np.concatenate(price), np.array(first)


def _distances(counts: tuple[np.ndarray, np.ndarray], prices: tuple[np.ndarray, np.ndarray], terms: int = SLICE, groups: int = TILE) -> np.ndarray:
    """Sums over the terms of |p - q| for each group of the first side and each of the second.

    The product of a side's indicators with the other's, transposed, holds for each pair of groups the joint table of their
    levels: how many terms have count c in one and d in the other. Entries are at most ``terms``, those of one product, so single floats hold them
    exactly; a table costs the price |p(c) - q(d)| of each cell, in whole numbers.
    """
    a, b = counts
    total = np.zeros((a.shape[1], b.shape[1]), np.int64)
    for t in range(0, len(a), terms):
        sides = [
            [(k, _levels(side[t : t + terms, k : k + groups], price[t : t + terms, k : k + groups])) for k in range(0, side.shape[1], groups)]
            for side, price in zip(counts, prices, strict=True)
        ]
        for i, (x, p, first_p) in sides[0]:
            for j, (y, q, first_q) in sides[1]:
                joint = (x.T @ y).astype(np.int64)
                cost = joint * np.abs(p[:, None] - q[None, :])
                total[i : i + len(first_p), j : j + len(first_q)] += np.add.reduceat(np.add.reduceat(cost, first_p, axis=0), first_q, axis=1)
    return total


def _pricer(in_side: int, slice_: int, tile: int) -> Callable[[pa.Table], pa.Table]:
    """What the terms of a block add to the distance of each of its pairs of groups: lang, a, b, value, where a < b; a side has ``in_side`` groups.

    Rows without a term name the groups, with the price of a count of 0; the others have the counts above 0.
    """

    def price(table: pa.Table) -> pa.Table:
        lang, i, j = (table.column(c)[0].as_py() for c in ("lang", "i", "j"))
        group, n, p = (table.column(c).to_numpy() for c in ("group", "n", "p"))
        named = table.column("term").is_null().to_numpy()
        codes = table.column("term").combine_chunks().dictionary_encode()
        term = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        groups = np.sort(group[named])
        at = np.searchsorted(groups, group)
        counts = np.zeros((len(codes.dictionary), len(groups)), np.int64)
        prices = np.empty_like(counts)
        prices[:, at[named]] = p[named]
        counts[term[~named], at[~named]], prices[term[~named], at[~named]] = n[~named], p[~named]
        rows, columns = np.flatnonzero(groups // in_side == i), np.flatnonzero(groups // in_side == j)
        total = _distances((counts[:, rows], counts[:, columns]), (prices[:, rows], prices[:, columns]), slice_, tile)
        a, b = (x.ravel() for x in np.meshgrid(groups[rows], groups[columns], indexing="ij"))
        keep = a < b
        columns = [pa.array([lang] * int(keep.sum()), pa.string()), pa.array(a[keep], pa.int32()), pa.array(b[keep], pa.int32()), pa.array(total.ravel()[keep], pa.int64())]
        return pa.Table.from_arrays(columns, ["lang", "a", "b", "value"])

    return price


def _counted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The kept terms' counts by group: lang, source, term, n, in_lang (n over the language); and the groups: lang, source, total, group, groups, v, lang_total."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    partial = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # Tasks count first; then one shuffle by term serves the sums by group and those over the language.
    sums = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    first = F.when((F.col("term") != "") & (F.row_number().over(of_term.orderBy("source")) == 1), 1).otherwise(0)
    sums = sums.withColumns({"in_docs": F.sum("docs").over(of_term), "in_lang": F.sum("n").over(of_term), "first": first})
    sums = materialize(sums.where((F.col("in_docs") >= LEAST_DOCS) | (F.col("term") == "")).select("lang", "source", "term", "n", "in_lang", "first"))
    langs = sums.groupBy("lang").agg(F.sum("first").alias("v"), F.sum("n").alias("lang_total"))
    of_lang = Window.partitionBy("lang")
    groups = sums.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.withColumns({"group": F.row_number().over(of_lang.orderBy("source")) - 1, "groups": F.count("*").over(of_lang)})
    groups = materialize(groups.join(langs, "lang"))
    return sums.where("term <> ''").drop("first"), groups


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """The distance of each pair of groups of a language that has terms: lang, a, b, value, where a < b."""
    blocks = F.ceil(F.col("v") / TERMS).cast("int")
    side = F.expr(f"group div {GROUPS}")
    others = F.explode(F.sequence(F.lit(0), F.expr(f"(groups - 1) div {GROUPS}"))).alias("other")
    key = [F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "group", "n", "p"]
    known = groups.where("v > 0").withColumns({"blocks": blocks, "side": side})
    named = known.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "group", "groups", "side", F.lit(0).cast("long").alias("n"), _frequency("0", "total", "v").alias("p"))
    named = named.select("lang", "block", F.lit(None).cast("string").alias("term"), "side", others, "group", "n", "p").select("lang", "block", "term", *key)
    held = counts.where("n > 0").join(known, ["lang", "source"])
    held = held.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "term", "side", others, "group", "n", _frequency("n", "total", "v").alias("p")).select("lang", "block", "term", *key)
    sums = named.unionByName(held).groupBy("lang", "block", "i", "j").applyInArrow(_pricer(GROUPS, SLICE, TILE), "lang string, a int, b int, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """How far the sources of each language are from one another, and by which terms: lang, source, part, item, value, rank.

    Null text, lang and source are empty strings; terms are runs of ASCII letters, lower-cased, and characters beyond ASCII;
    a language keeps those that ``LEAST_DOCS`` of its documents hold. A term's smoothed frequency p is counted in parts of
    ``SCALE``, in whole numbers. Part ``pair``: each other source of the language, and the sum of |p - q| over the kept terms, 0
    if there are none. Part ``term``: the ``LISTED`` terms that the source has most over the language's own frequency.

    Tasks count the terms of the documents they have, so a hot group or term reaches the shuffle as a row per task. The terms
    of a language are dealt by hash over blocks of about ``TERMS``, its groups over blocks of ``GROUPS``: a task multiplies the
    one-hot levels of two blocks of groups over one block of terms, and prices the joint tables that come of it. No pair of
    rows is ever made, only the pairs of groups, which are the result. Rows that repeat count as often; an empty table gives no
    rows; ids and other columns are ignored; long texts are split in stretches.
    """
    counts, groups = _counted(docs)
    ends = [groups.select("lang", F.col("group").alias(e), F.col("source").alias(f"{e}_source")) for e in ("a", "b")]
    one_way = _pairs(counts, groups)
    both = one_way.unionByName(one_way.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = ends[0].join(ends[1], "lang").where("a <> b").join(both, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", F.col("a_source").alias("source"), F.lit("pair").alias("part"), F.col("b_source").alias("item"), F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    priced = counts.where("n > 0").join(groups, ["lang", "source"])
    over = _frequency("n", "total", "v") - _frequency("in_lang", "lang_total", "v")
    over = priced.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), over.alias("value")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    listed = over.withColumn("rank", rank).where(F.col("rank") <= LISTED)
    return pairs.withColumn("rank", rank).unionByName(listed)
