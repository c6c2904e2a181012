"""N-gram Jaccard self-join of documents, by rare-first prefix filtering."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.common import materialize, may_hold, unused
from ferrule.llm.graph import components
from ferrule.llm.shingles import scramble, shingle_sets

#: Cells of the frequency sketch that orders shingles: its size does not depend on the data.
CELL_BITS, BLOCK_BITS = 20, 10
#: Bins of a document's histogram, for the suffix filter.
BINS = 64
#: A list of postings is dealt over SALTS tasks if its cell counts more than HOT shingles and HOT_TIMES the mean cell.
HOT, HOT_TIMES, SALTS = 1 << 20, 64, 64
#: Documents of a list that one part of it pairs with the whole list, where all links are asked for.
PAIRED = 256

Batches = Iterator[pa.RecordBatch]


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _profile(batches: Batches) -> Batches:
    """For each document its size, fingerprint and histogram; at the end, this task's part of the sketch."""
    cells = np.zeros(1 << CELL_BITS, np.int64)
    for batch in batches:
        n, a, b, bins = [], [], [], []
        for s in shingle_sets(batch.column("text")):
            n.append(len(s))
            a.append(s.sum().view(np.int64))
            b.append(scramble(s + np.uint64(len(s))).sum().view(np.int64))
            bins.append(np.bincount((s >> np.uint64(32)).astype(np.int64) % BINS, minlength=BINS).astype("<u4").tobytes())
            np.add.at(cells, _cells(s), 1)
        docs = [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bins, pa.binary())]
        yield pa.RecordBatch.from_arrays([*docs, pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.binary())], ["doc_id", "n", "fp_a", "fp_b", "bins", "block", "counts"])
    parts = [(k, zlib.compress(x.astype("<i8").tobytes(), 1)) for k, x in enumerate(cells.reshape(-1, 1 << BLOCK_BITS)) if x.any()]
    none = [pa.nulls(len(parts), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
    yield pa.RecordBatch.from_arrays([*none, pa.array([k for k, _ in parts], pa.int64()), pa.array([x for _, x in parts], pa.binary())], ["doc_id", "n", "fp_a", "fp_b", "bins", "block", "counts"])


def _sum_blocks(batches: Batches) -> Batches:
    """Add up the parts of each block that came to this task."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            total[k] = total.get(k, 0) + np.frombuffer(zlib.decompress(x), "<i8")
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "counts"])


def _prefixes(sketch, num: int, den: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        counts = sketch.value
        hot = counts > max(HOT, HOT_TIMES * counts.mean())
        seen: set[tuple[int, int, int]] = set()
        for batch in batches:
            out: list[tuple] = []
            rows = 0
            for doc, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text")), strict=True):
                n = len(s)
                key = (n, int(s.sum()), int(scramble(s + np.uint64(n)).sum()))
                if doc is None or not n or key in seen:
                    continue
                seen.add(key)
                of = counts[_cells(s)]
                first = np.argsort(of, kind="stable")[: n - (num * n + den - 1) // den + 1]
                out.append((s[first].view(np.int64), np.full(len(first), doc, np.int64), np.full(len(first), n, np.int32), np.arange(len(first), dtype=np.int32), hot[_cells(s[first])]))
                rows += len(first)
                if rows > 200_000:
                    yield _postings(out)
                    out, rows = [], 0
            yield _postings(out)

    return run


def _postings(out: list[tuple]) -> pa.RecordBatch:
    kinds = (np.int64, np.int64, np.int32, np.int32, bool)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, k), *x])) for k, x in zip(kinds, list(zip(*out, strict=True)) or [()] * 5, strict=True)], ["h", "doc", "n", "pos", "hot"])


def _suffix_filter(num: int, den: int) -> Callable[[Batches], Batches]:
    """Keep pairs whose histograms leave room for the overlap asked for."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, BINS).astype(np.int64) for c in ("bins_a", "bins_b"))
                most, both = np.minimum(x, y).sum(1), x.sum(1) + y.sum(1)
                batch = batch.filter(pa.array((num + den) * most >= num * both))
            yield batch.select(["a", "b"])

    return run


def _verify(num: int, den: int) -> Callable[[Batches], Batches]:
    """Keep pairs whose sets of shingles are alike enough."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            keep = []
            for x, y in zip(shingle_sets(batch.column("text_a")), shingle_sets(batch.column("text_b")), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common > 0 and den * common >= num * (len(x) + len(y) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _room(num: int, den: int) -> Column:
    """Length and positional filter of postings x and y of one list: can these two overlap enough, this being their first common shingle?"""
    long, short = F.greatest("x.n", "y.n"), F.least("x.n", "y.n")
    rest = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    return (den * short >= num * long) & ((num + den) * rest >= num * (F.col("x.n") + F.col("y.n")))


def _ordered() -> Column:
    """Is x the longer document, or of equal ones that of the smaller id?"""
    return (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.doc") < F.col("y.doc")))


def _level(n: Column) -> Column:
    """Lengths of about the same size: a step for every 15 %."""
    return F.floor(F.log(n) / math.log(1.15)).cast("int")


def _long(lists: DataFrame) -> DataFrame:
    """Postings as the longer of two documents: add ``level``."""
    return lists.withColumn("level", _level(F.col("n")))


def _short(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Postings as the shorter of two documents: one row for each ``level`` of a longer one that the length and positional filter let it link with.

    A posting late in its prefix admits no longer document, and hardly one of its own length, so it is dropped here; with the
    level as a key of the join, a list of very many documents that differ in length, or share only a late shingle, is never
    paired with itself as a whole.
    """
    n = F.col("n")
    most = F.least(F.floor(n * den / num), F.floor((num + den) * (n - F.col("pos")) / num) - n)
    return lists.where(most >= n).withColumn("level", F.explode(F.sequence(_level(n), _level(most))))


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).where("a <> b").distinct()


def _links(pairs: DataFrame, profiles: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that hold: suffix filter on histograms, then one comparison of the whole texts."""
    for side in ("a", "b"):
        pairs = pairs.join(profiles.select(F.col("rep").alias(side), F.col("bins").alias(f"bins_{side}")), side)
    pairs = materialize(pairs.select("a", "b", "bins_a", "bins_b").mapInArrow(_suffix_filter(num, den), "a long, b long"))
    ends = materialize(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    texts = may_hold(docs, "doc_id", ends, "may").where("may").drop("may")
    for side in ("b", "a"):
        pairs = pairs.join(texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}")), side)
    held = pairs.select("a", "b", "text_a", "text_b").mapInArrow(_verify(num, den), "a long, b long")
    return materialize(held.distinct())


def _index(docs: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Steps 1 and 2 of ``join``: the documents, their rows with class, the histogram of each class, (doc, rep), and the lists of postings."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n long, fp_a long, fp_b long, bins binary, block long, counts binary"
    profile = materialize(docs.mapInArrow(_profile, schema))
    parts = profile.where("block is not null").select("block", "counts")
    sketch = np.zeros((1 << CELL_BITS - BLOCK_BITS, 1 << BLOCK_BITS), np.int64)
    for row in parts.repartition(8, "block").mapInArrow(_sum_blocks, "block long, counts binary").collect():
        sketch[row.block] = np.frombuffer(row.counts, "<i8")

    rows = profile.where("block is null").select("doc_id", "n", "fp_a", "fp_b", "bins")
    # A copy of the classes is dealt anew for the join, so that Spark can split a class of very many documents.
    classes = materialize(rows.where("n > 0").groupBy("n", "fp_a", "fp_b").agg(F.min("doc_id").alias("rep")))
    members = materialize(rows.join(classes, ["n", "fp_a", "fp_b"], "left"))
    profiles = members.where("doc_id = rep").select("rep", "bins")
    same = members.where("rep is not null").select(F.col("doc_id").alias("doc"), "rep").distinct()

    postings = docs.mapInArrow(_prefixes(spark.sparkContext.broadcast(sketch.ravel()), num, den), "h long, doc long, n int, pos int, hot boolean")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc"), F.lit(SALTS))).otherwise(F.lit(0))
    shared = postings.withColumn("salt", salt).withColumn("of", F.count("*").over(Window.partitionBy("h", "salt"))).where("of > 1 or hot")
    lists = shared.drop("of", "salt").join(same, "doc").select("h", F.col("rep").alias("doc"), "n", "pos", "hot").distinct()
    return docs, members, profiles, same, materialize(lists.withColumn("salt", salt))


def join(docs: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """Link documents whose sets of 5-word shingles have a Jaccard similarity of ``num / den`` or more; one row per document.

    Returns doc_id, n_shingles and component_id, the smallest doc_id that links reach, itself included.

    1. One pass hashes every whole text: set size, fingerprint of the set, histogram, and a count sketch of all shingles
       in a fixed number of cells. Documents of one set are a class, which its smallest doc_id stands for.
    2. A second pass orders each set rare-first, by cell count and then hash, and emits its prefix: two sets that link
       share a shingle in their prefixes. A task emits a set once. Shingles in one prefix only drop out.
    3. Star round: in each list of postings, every document is paired with the list's first. Pairs pass the length,
       positional and suffix filters, and the texts of the rest are compared, once per pair.
    4. Full round: where a list still holds more than one component, each document outside the list's largest component
       is paired with those of other components whose length it admits at its place in the prefix, and compared likewise. No link between different components is
       missed, and a large group of copies, being one component by now, makes no pairs.

    No list is gathered: lists of very frequent shingles are dealt over ``SALTS`` tasks in the star round, and the joins of
    the full round split. Only the sketch goes through the driver; its size is fixed.

    Documents without words, or with null text, have an empty set and are linked with nothing. A null doc_id is linked
    with nothing and has a null component. Rows that share a doc_id are one node. Other columns are ignored.
    """
    docs, members, profiles, same, lists = _index(docs, num, den)
    order = Window.partitionBy("h", "salt").orderBy("doc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stars = lists.select(F.struct("doc", "n", "pos").alias("x"), F.first(F.struct("doc", "n", "pos")).over(order).alias("y"))
    links = _links(_pairs(stars.where(_room(num, den))), profiles, docs, num, den)
    found = components(links.unionByName(same.select(F.col("doc").alias("a"), F.col("rep").alias("b"))))
    found = materialize(found)

    placed = lists.join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    placed = materialize(placed.select("h", "doc", "n", "pos", "component"))
    sizes = placed.groupBy("h", "component").agg(F.count("*").alias("c")).groupBy("h").agg(F.count("*").alias("components"), F.max_by("component", "c").alias("main"))
    mixed = placed.join(sizes.where("components > 1").select("h", "main"), "h")
    outside, main = mixed.where("component <> main"), mixed.where("component = main")
    same_list = (F.col("x.h") == F.col("y.h")) & (F.col("x.level") == F.col("y.level"))
    meets = same_list & _ordered() & (F.col("x.component") != F.col("y.component")) & _room(num, den)
    both = [F.struct(*[f"{side}.{c}" for c in ("doc", "n", "pos")]).alias(side) for side in "xy"]
    crossed = _long(outside).alias("x").join(_short(mixed, num, den).alias("y"), meets).select(*both)
    crossed = crossed.unionByName(_long(main).alias("x").join(_short(outside, num, den).alias("y"), meets).select(*both))
    late = _links(_pairs(crossed), profiles, docs, num, den)
    ends = late
    for side in ("a", "b"):
        named = found.select(F.col("node").alias(side), F.col("component").alias("c"))
        ends = ends.join(named, side, "left").withColumn(side, F.coalesce("c", side)).drop("c")
    merged = components(ends)

    whole = members.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("node"))
    whole = whole.join(found, "node", "left").withColumn("node", F.coalesce("component", "node")).drop("component")
    whole = whole.join(merged, "node", "left").withColumn("node", F.coalesce("component", "node"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("node"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _all_links(docs: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, members, profiles, same, lists = _index(docs, num, den)
    lengths = lists.groupBy("h").agg(F.count("*").alias("of")).where("of > 1")
    dealt = lists.join(lengths, "h").select("h", "doc", "n", "pos", F.ceil(F.col("of") / PAIRED).alias("parts"))
    one = _long(dealt.withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts"))))
    every = _short(dealt, num, den).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    meets = (F.col("x.h") == F.col("y.h")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.level") == F.col("y.level")) & _ordered()
    held = _links(_pairs(one.alias("x").join(every.alias("y"), meets & _room(num, den))), profiles, docs, num, den)
    sizes = materialize(same.where("doc is not null").groupBy("rep").agg(F.count("*").alias("size")))
    for side in ("a", "b"):
        held = held.join(sizes.select(F.col("rep").alias(side), F.col("size").alias(f"size_{side}")), side)
    return members, sizes, materialize(held.select("a", "b", "size_a", "size_b"))


def links(docs: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """Every link between classes: a, b, size_a, size_b, with a < b.

    A class is the documents of one set of shingles, ``size`` distinct doc_ids, which its smallest doc_id stands for. Such
    a row is size_a * size_b links of documents; the documents of a class are linked with each other besides. Unlike
    ``join``, all pairs of a list of postings that pass the length, positional and suffix filters are compared, once per
    pair: their number grows with the square of a group of near copies, as that of the links does. Long lists are dealt
    in parts of about ``PAIRED`` documents, each of which meets the whole list.
    """
    return _all_links(docs, num, den)[2]


def count_links(docs: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """The number of other documents that each is linked with: doc_id, n_shingles, n_links; one row per document.

    Documents without words and those of a null doc_id have none. Rows that share a doc_id are counted as one document;
    if their texts differ, that document counts once for each class it is in.
    """
    members, sizes, held = _all_links(docs, num, den)
    ways = [held.select(F.col(x).alias("rep"), F.col(f"size_{y}").alias("c")) for x, y in ("ab", "ba")]
    others = ways[0].unionByName(ways[1]).groupBy("rep").agg(F.sum("c").alias("others"))
    counts = sizes.join(others, "rep", "left").select("rep", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("count"))
    linked = F.when(F.col("doc_id").isNotNull(), F.col("count"))
    return members.join(counts, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(linked, F.lit(0)).cast("long").alias("n_links"))


def keep_first(docs: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """The documents that are the smallest doc_id of their component, with all their columns.

    Rows that share a doc_id stay or go together; documents with a null doc_id stay. Only documents that a Bloom filter of the
    ids to drop may hold are shuffled.
    """
    found = join(docs, num, den)
    drop = materialize(found.where("component_id <> doc_id").select("doc_id").distinct())
    may = unused(docs, "may")
    probed = may_hold(docs, "doc_id", drop, may)
    rest = probed.where(F.col(may)).join(drop, "doc_id", "left_anti")
    return probed.where(~F.col(may)).unionByName(rest).drop(may)
