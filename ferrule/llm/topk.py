"""Exact top-k inner-product search by the threshold algorithm over sorted lists of each dimension."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.common import materialize

#: Vectors of a block, which a task sorts at a time; blocks of queries that are broadcast together.
BLOCK, GROUP = 4_096, 8
#: Vectors, about, that give each query its first bound.
SEED = 4_096
#: Entries of each list read in the first step; every step reads twice as far as the one before.
DEPTH = 16
#: Scores of at most this size are exact in doubles.
_EXACT = float(1 << 53)

Batches = Iterator[pa.RecordBatch]


def quantize(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double; null if the vector or a component is null or not finite."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, F.transform(numbers, lambda x: F.floor(x * scale).cast("long")))


def _matrix(vectors: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


class Lists:
    """A block of vectors with, for each dimension, its rows from largest to smallest value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")  # so that of equal scores the first row has the smallest id
        self.ids, self.vectors = ids[order], vectors[order]
        self.order = np.argsort(-self.vectors, axis=0, kind="stable").astype(np.int32)
        self.doubles = self.vectors.astype(np.float64)
        self.largest = np.abs(self.doubles).max(initial=0)

    def _scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.largest * float(np.abs(q).max(initial=0)) * max(len(q), 1) < _EXACT:
            return (self.doubles[rows] @ q.astype(np.float64)).astype(np.int64)
        return self.vectors[rows] @ q

    def _best(self, scores: np.ndarray, seen: np.ndarray, query_id: int, k: int) -> np.ndarray:
        rows = np.flatnonzero(seen & (self.ids != query_id))
        if len(rows) > k:
            rows = rows[scores[rows] >= np.partition(scores[rows], len(rows) - k)[len(rows) - k]]
        return rows[np.lexsort((rows, -scores[rows]))[:k]]

    def search(self, query_id: int, q: np.ndarray, k: int, floor: int = -(1 << 62)) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the ``k`` highest scores of at least ``floor``, with their scores, the query's own row left out.

        The lists of the query's dimensions are read from the end that scores higher, all to the same depth. Every row met is
        scored whole. A row that no list has shown scores no more than the sum of what the lists show at that depth; once that
        is below the kth score, or ``floor``, no such row can count, nor tie.
        """
        n, dims = len(self.ids), np.flatnonzero(q)
        up, down = dims[q[dims] > 0], dims[q[dims] < 0]
        scores = np.zeros(n, np.int64)
        seen = np.full(n, not len(dims))
        rows = self._best(scores, seen, query_id, k)
        depth, read = min(DEPTH, n), 0
        while not seen.all():
            met = np.zeros(n, bool)
            met[self.order[read:depth, up]] = True
            met[self.order[n - depth : n - read, down]] = True
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            scores[new] = self._scores(new, q)
            rows = self._best(scores, seen, query_id, k)
            bound = int(self.vectors[self.order[depth - 1, up], up] @ q[up] + self.vectors[self.order[n - depth, down], down] @ q[down])
            if bound < max(floor, int(scores[rows].min()) if len(rows) == k else floor):
                break
            read, depth = depth, min(2 * depth, n)
        rows = rows[scores[rows] >= floor]
        return rows, scores[rows]


def _block_rows(batches: Batches) -> Batches:
    """Pack rows into blocks: ids and components, end to end."""
    ids: list[int] = []
    vectors: list[list[int]] = []

    def flush() -> pa.RecordBatch:
        width = max((len(v) for v in vectors), default=0)
        row = pa.RecordBatch.from_arrays(
            [pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([_matrix(vectors, width).astype("<i8").tobytes()], pa.binary()), pa.array([width], pa.int32())],
            ["ids", "vectors", "width"],
        )
        ids.clear()
        vectors.clear()
        return row

    for batch in batches:
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("q").to_pylist(), strict=True):
            ids.append(i)
            vectors.append(v)
            if len(ids) == BLOCK:
                yield flush()
    if ids:
        yield flush()


class Best:
    """The k best (score, vec_id) of one query so far."""

    def __init__(self, k: int, floor: int) -> None:
        self.k, self.floor = k, floor
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.floor = max(self.floor, int(self.scores[-1]))


def _searcher(k: int, shared) -> Callable[[Batches], Batches]:
    """The best ``k`` of this task's vectors for every query of the group ``shared`` (ids, vectors, floors): what could still be among the best of all.

    Bounds go from block to block: a search starts with the kth score of the blocks before, or the query's floor.
    """

    def run(batches: Batches) -> Batches:
        ids, queries, floors = shared.value
        best = [Best(k, f) for f in floors.tolist()]
        held_ids: list[int] = []
        held: list[list[int]] = []

        def search() -> None:
            lists = Lists(np.array(held_ids, np.int64), _matrix(held, max(map(len, held))))
            width = lists.vectors.shape[1]
            # Components that the other side lacks count as 0.
            asked = np.pad(queries, ((0, 0), (0, max(0, width - queries.shape[1]))))[:, :width]
            for query_id, q, b in zip(ids.tolist(), asked, best, strict=True):
                rows, scores = lists.search(query_id, q, k, b.floor)
                b.add(lists.ids[rows], scores)
            held_ids.clear()
            held.clear()

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("q").to_pylist(), strict=True):
                held_ids.append(i)
                held.append(v)
                if len(held) == BLOCK:
                    search()
        if held:
            search()
        sizes = [len(b.ids) for b in best]
        columns = [np.repeat(ids, sizes), np.concatenate([np.empty(0, np.int64), *[b.ids for b in best]]), np.concatenate([np.empty(0, np.int64), *[b.scores for b in best]])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return run


_HITS = "query_id long, vec_id long, score long"


def _top(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """Each query's ``k`` highest integer inner products over all vectors but its own: query_id, rank, vec_id, score.

    Both tables have vec_id and embedding. Components become floor(scale * x); vectors that are null or hold a null or
    non-finite component, and null ids, take no part; of vectors of unequal length the shorter is filled up with zeros. Equal
    scores go to the smaller vec_id. Fewer than k other vectors give them all. Rows that repeat a vec_id are each candidates.

    Vectors stay where they are: a task sorts its own into the lists of each dimension, ``BLOCK`` vectors at a time, and holds
    every query against them by the threshold algorithm, which stops when what is left cannot beat the kth score. Queries
    are broadcast in groups of ``GROUP`` blocks, some megabytes each, and every group passes over the vectors once. A first
    pass over about ``SEED`` vectors gives each query a score that its kth is at least, to start from; that only saves work,
    since no score of the best is below it. The best k of each task then compete; partial top-k precedes that shuffle.
    """

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), quantize(F.col("embedding"), scale).alias("q"))
        return df.where("vec_id is not null and q is not null")

    spark = vectors.sparkSession
    candidates = clean(vectors)
    n = vectors.count()
    drawn = F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1_000_000)) < SEED * 1_000_000 // max(n, 1)
    # A vec_id asks once, with its least vector.
    asked = clean(queries).groupBy("vec_id").agg(F.min("q").alias("q"))
    blocks = materialize(asked.mapInArrow(_block_rows, "ids binary, vectors binary, width int").withColumn("block", F.monotonically_increasing_id()))
    names = sorted(r.block for r in blocks.select("block").collect())  # one number for each block of queries
    found = spark.createDataFrame([], _HITS)
    for a in range(0, len(names), GROUP):
        rows = blocks.where(F.col("block").isin(names[a : a + GROUP])).collect()
        ids = np.concatenate([np.frombuffer(r.ids, "<i8") for r in rows])
        width = max(r.width for r in rows)
        parts = [np.frombuffer(r.vectors, "<i8").reshape(-1, r.width) for r in rows]
        whole = np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])
        floors = np.full(len(ids), -(1 << 62))
        if n > SEED:
            seeding = spark.sparkContext.broadcast((ids, whole, floors))
            seen = _top(candidates.where(drawn).mapInArrow(_searcher(k, seeding), _HITS), k).where(F.col("rank") == k).select("query_id", "score")
            kth = {r.query_id: r.score for r in seen.collect()}  # a number for each query of the group
            floors = np.array([kth.get(i, -(1 << 62)) for i in ids.tolist()])
        shared = spark.sparkContext.broadcast((ids, whole, floors))
        found = found.unionByName(candidates.mapInArrow(_searcher(k, shared), _HITS))
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
