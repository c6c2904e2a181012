"""Nearest neighbours by cosine in an index of trained cells; probing every cell is exact."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.functions.text import let
from ferrule.operators.search import dot
from ferrule.sources.tables import shared_folder

#: Vectors, about, that the cells are trained on; vectors and queries of a block, which one task takes; scores that it holds at once.
SAMPLE, BLOCK, ASKED, SCORES = 50_000, 65_536, 16_384, 1 << 21

Batches = Iterator[pa.RecordBatch]


@dataclass(frozen=True)
class Index:
    """Unit centres of the cells, and the vectors, as Parquet partitioned by cell: all their columns, ``unit``, ``cell``."""

    centres: np.ndarray
    vectors: DataFrame
    id_: str


def unit(vector: Column) -> Column:
    """A vector at length 1 in doubles; a vector of zeros stays. Null if it is null or holds a null, NaN or infinite component."""
    length = F.sqrt(dot(vector, vector))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, let(F.when(length == 0, 1.0).otherwise(length), lambda n: F.transform(vector, lambda x: x.cast("double") / n)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _cells(centres: np.ndarray, probes: int) -> Callable[[Batches], Batches]:
    """Each row once for each of its ``probes`` nearest cells."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            near = _matrix(batch.column("unit"), centres.shape[1]) @ centres.T
            order = np.argsort(-near, axis=1, kind="stable")[:, :probes]
            rows = pa.array(np.repeat(np.arange(len(batch)), order.shape[1]))
            yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in batch.columns], pa.array(order.ravel().astype(np.int32))], [*batch.schema.names, "cell"])

    return run


def _dealt(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    return rows.mapInArrow(_cells(centres, probes), T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))


def _write(rows: DataFrame, id_: str) -> DataFrame:
    """Rows with their cells as Parquet, one folder a cell; a cell of many rows is dealt over many tasks and files."""
    path = f"{shared_folder(rows.sparkSession)}/cells-{uuid.uuid4().hex}"
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("_parts"))  # a row for each cell
    dealt = rows.join(F.broadcast(sizes), "cell").repartition("cell", F.pmod(F.xxhash64(id_), F.col("_parts"))).drop("_parts")
    dealt.write.partitionBy("cell").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def build(vectors: DataFrame, cells: int = 64, id_: str = "vec_id", vector: str = "embedding", seed: int = 7) -> Index:
    """Train ``cells`` cells on about ``SAMPLE`` vectors, drawn by a hash of the id, and put every vector into its nearest.

    Vectors must be of one length; those that are null or hold a null or non-finite component are in no cell. Fewer distinct
    vectors than cells make fewer cells. The centres, a matrix of cells and dimensions, are all that tasks are sent.
    """
    rows = vectors.withColumn("unit", unit(F.col(vector))).where("unit is not null")
    n = rows.count()
    drawn = F.pmod(F.xxhash64(F.lit(seed), id_), F.lit(1_000_000)) < SAMPLE * 1_000_000 // max(n, 1)
    sample = rows.where(drawn).select(array_to_vector("unit").alias("features"))
    if n == 0:
        return Index(np.zeros((0, 0)), rows.withColumn("cell", F.lit(0)), id_)
    model = KMeans(k=max(2, min(cells, n)), seed=seed, initSteps=2, maxIter=12).fit(sample)
    centres = np.array(model.clusterCenters())
    lengths = np.linalg.norm(centres, axis=1, keepdims=True)
    centres = centres / np.where(lengths == 0, 1, lengths)
    return Index(centres, _write(_dealt(rows, centres, 1), id_), id_)


def replace(index: Index, changed: DataFrame | None = None, removed: DataFrame | None = None, vector: str = "embedding") -> Index:
    """The index with ``changed`` vectors replaced or added and ``removed`` ids gone; the cells stay as trained."""
    rows = index.vectors
    for gone in (changed, removed):
        if gone is not None:
            rows = rows.join(gone.select(index.id_), index.id_, "left_anti")
    if changed is not None:
        new = changed.withColumn("unit", unit(F.col(vector))).where("unit is not null")
        rows = rows.unionByName(_dealt(new, index.centres, 1))
    return Index(index.centres, _write(rows.select(*index.vectors.columns), index.id_), index.id_)


def _best(k: int, width: int, own: bool) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The ``k`` best of a block of vectors for each of a block of queries, by the product of the two."""

    def run(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        ids, asked = vectors.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not len(ids) or not len(asked):
            return schema.empty_table()
        # Vectors by id: a query's own one is found, not looked for among all.
        turn = np.argsort(ids, kind="stable")
        ids, x = ids[turn], _matrix(vectors.column("unit").combine_chunks(), width)[turn]
        y = _matrix(queries.column("unit").combine_chunks(), width)
        first, last = np.searchsorted(ids, asked, "left"), np.searchsorted(ids, asked, "right")
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, SCORES // len(ids))
        for start in range(0, len(asked), step):
            for n, row in enumerate(y[start : start + step] @ x.T, start):
                if not own:
                    row[first[n] : last[n]] = -np.inf
                # Rounding may make equal what was not: all that may round to the least of the best stay.
                least = np.partition(row, len(row) - k)[len(row) - k] - 2e-9 if len(row) > k else -np.inf
                at = np.flatnonzero((row >= least) & np.isfinite(row))
                score = np.round(row[at], 9)
                best = np.lexsort((ids[at], -score))[:k]
                out.append((np.full(len(best), asked[n]), ids[at][best], score[best]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    return run


def search(index: Index, queries: DataFrame, k: int = 10, probes: int = 40, where: Column | None = None, own: bool = False, vector: str = "embedding") -> DataFrame:
    """Each query's ``k`` nearest by cosine among the vectors of its ``probes`` nearest cells: query_id, rank, vec_id, score.

    ``queries`` has query_id and a vector; ids are whole numbers. As many probes as cells make the result exact; fewer cost
    the share of the vectors that they are of the cells. ``where`` is a filter on the indexed rows, applied before ranking;
    a vector of a query's own id is left out unless ``own``. Scores are exact, to 9 digits; equal ones go to the smaller id.

    A cell of many vectors or asked by many queries is cut into blocks of both, so no task holds more than two blocks and
    their product; tasks pass on k rows for each query and block, which compete in one window. Only probed cells are read.
    """
    rows = index.vectors if where is None else index.vectors.where(where)
    spark = rows.sparkSession
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), unit(F.col(vector)).alias("unit")).where("unit is not null and query_id is not null")
    asked = asked.groupBy("query_id").agg(F.min("unit").alias("unit"))
    if not index.centres.size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = _dealt(asked, index.centres, min(probes, len(index.centres)))
    # Both tables of sizes have a row for each cell.
    blocks = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    groups = asked.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("groups"))
    sizes = F.broadcast(blocks.join(groups, "cell"))
    held = rows.select(F.col(index.id_).cast("long").alias("vec_id"), "unit", "cell").join(sizes, "cell")
    held = held.select("vec_id", "unit", "cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    spread = asked.join(sizes, "cell").select("query_id", "unit", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int").alias("group"))
    key = ["cell", "block", "group"]
    hits = held.groupBy(*key).cogroup(spread.groupBy(*key)).applyInArrow(_best(k, index.centres.shape[1], own), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def probes_for(index: Index, queries: DataFrame, share: float = 0.9, k: int = 10, where: Column | None = None, vector: str = "embedding") -> int:
    """The least number of probes that finds ``share`` of the ``k`` nearest of ``queries``, a sample that the caller bounds.

    The sample is searched in all cells; how far down a query's order of cells each neighbour's cell is says what any number of
    probes would have found. The histogram of those places, a row for each cell at most, gives the answer.
    """
    n = len(index.centres)
    exact = search(index, queries, k, n, where, vector=vector).select("query_id", F.col("vec_id").alias(index.id_))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), unit(F.col(vector)).alias("unit")).where("unit is not null").dropDuplicates(["query_id"])
    order = _dealt(asked, index.centres, n).withColumn("near", dot(F.col("unit"), F.element_at(F.lit(index.centres.tolist()), F.col("cell") + 1)))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "cell"))
    turns = order.select("query_id", "cell", turn.alias("turn"))
    places = exact.join(index.vectors.select(index.id_, "cell"), index.id_).join(turns, ["query_id", "cell"]).groupBy("turn").count().collect()
    found, total = 0, sum(r["count"] for r in places)
    for r in sorted(places):
        found += r["count"]
        if found >= share * total:
            return r.turn
    return n


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the ``exact`` neighbours (query_id, vec_id) that are among those ``found``."""
    hit = F.lit(1).alias("hit")
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", hit), ["query_id", "vec_id"], "left")
    n, hits = both.agg(F.count("*"), F.count("hit")).first()
    return hits / n if n else 1.0
