"""Whitening of embeddings by shifted CholeskyQR: Gram passes over the rows, triangular solves within them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.common import checkpoint_dir
from ferrule.llm.topk import quantize

#: Integer steps of a component; components that are returned.
SCALE, COMPONENTS = 256, 4
#: Gram passes at most; how near 1 (or 0, where columns depend on one another) the Gram matrix's eigenvalues are when they end.
PASSES, NEAR = 6, 1e-8
#: A component's deviation, as a share of the largest, that is told from rounding.
LEAST = 1e-12
#: Whole numbers up to this are safe in 64 bits.
_SAFE = 1 << 62

Batches = Iterator[pa.RecordBatch]


@dataclass(frozen=True)
class Centre:
    """Number of vectors fitted on, and their exact sums by dimension."""

    n: int
    sums: tuple[int, ...]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit integers where they hold it, and Python's where not."""
        largest = int(np.abs(x).max(initial=0)) if x.size and x.min() > -(1 << 63) else 1 << 63
        if self.n * largest + max(map(abs, self.sums), default=0) < _SAFE:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over the dimensions of (n * x - S)^2, exact; null beyond 64 bits."""
        apart = self.scaled(x)
        if apart.dtype != object and int(np.abs(apart).max(initial=0)) ** 2 * apart.shape[1] >= _SAFE:
            apart = apart.astype(object)
        return [int(v) if v < 1 << 63 else None for v in (apart * apart).sum(axis=1)]


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows @ inv(factor) for an upper triangular factor, column by column."""
    out = np.array(rows, order="F")
    for j in range(out.shape[1]):
        out[:, j] = (out[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def _sums(width: int) -> Callable[[Batches], Batches]:
    """Sums of this task's vectors by dimension, and, as dimension -1, their number."""

    def run(batches: Batches) -> Batches:
        n, sums = 0, [0] * width
        for batch in batches:
            x = _rows(batch.column("x"), width)
            safe = not x.size or (x.min() > -(1 << 63) and int(np.abs(x).max()) * len(x) < _SAFE)
            sums = [a + int(b) for a, b in zip(sums, (x if safe else x.astype(object)).sum(axis=0), strict=True)]
            n += len(x)
        values = pa.array([Decimal(v) for v in [n, *sums]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), values], ["i", "value"])

    return run


def _gram(rows: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Q'Q, where Q is what ``of`` makes of the vectors: summed within tasks, then by entry; size * size numbers come back."""

    def run(batches: Batches) -> Batches:
        gram, empty = np.zeros((size, size)), True
        for batch in batches:
            q = of(_rows(batch.column("x"), width))
            gram += q.T @ q
            empty = empty and not len(q)
        if not empty:
            i, j = np.triu_indices(size)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(gram[i, j])], ["i", "j", "value"])

    found = rows.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()
    i, j = (found.column(c).to_numpy() for c in "ij")
    gram = np.zeros((size, size))
    gram[i, j] = gram[j, i] = found.column("value").to_numpy()
    return gram


def _factor(gram: np.ndarray) -> np.ndarray:
    """The upper Cholesky factor of the Gram matrix plus a shift just above rounding, so that dependent columns have one, too."""
    d = len(gram)
    shift = 16 * d * d * np.finfo(float).eps * max(np.trace(gram), np.finfo(float).tiny)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 100


@dataclass(frozen=True)
class Whitening:
    """Where vectors are centred, unit components as columns, by falling eigenvalue of the covariance, those values, and their share of its trace."""

    centre: Centre
    width: int
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.components / np.sqrt(self.values)


def components(rows: DataFrame, width: int, most: int = COMPONENTS) -> Whitening:
    """The components of ``rows``, a table that can be read often of distinct vectors ``x`` of ``width`` whole numbers.

    Centred rows A are made orthogonal pass by pass: the Gram matrix of Q = A inv(R1) inv(R2) ..., shifted, gives the next
    triangular factor, and rows go through all solves anew in each pass, so nothing of the size of A is kept. A = QR holds
    whatever the shifts are. At the end Q's Gram matrix is the unit matrix, or, where columns depend on one another, a
    projection; its root times the product of the factors has A's singular values and right vectors. What tasks and driver
    hold is the square of the width.
    """
    found = {r.i: int(r.value) for r in rows.mapInArrow(_sums(width), "i int, value decimal(38,0)").groupBy("i").agg(F.sum("value").alias("value")).collect()}
    n = found.get(-1, 0)
    centre = Centre(n, tuple(found.get(i, 0) for i in range(width)))
    none = Whitening(centre, width, np.zeros((width, 0)), np.zeros(0), np.zeros(0))
    if n < 2 or not width:
        return none
    factors: list[np.ndarray] = []
    product = np.eye(width)
    for _ in range(PASSES):

        def orthogonal(x: np.ndarray, solves=tuple(factors)) -> np.ndarray:
            q = centre.centred(x)
            for factor in solves:
                q = _solved(q, factor)
            return q

        gram = _gram(rows, width, orthogonal, width)
        values, vectors = np.linalg.eigh(gram)
        if not factors and np.trace(gram) <= 0:
            return none
        if factors and np.minimum(np.abs(values - 1), np.abs(values)).max() < NEAR:
            break
        factors.append(_factor(gram))
        product = factors[-1] @ product
    else:
        gram = _gram(rows, width, lambda x: orthogonal(x, tuple(factors)), width)
        values, vectors = np.linalg.eigh(gram)
    root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
    _, deviation, right = np.linalg.svd(root @ product)
    kept = int((deviation > LEAST * deviation[0]).sum())
    share = deviation**2 / (deviation**2).sum()
    top = right[: min(most, kept)].T
    top = top * np.where(np.take_along_axis(top, np.abs(top).argmax(axis=0)[None], axis=0) < 0, -1.0, 1.0)
    return Whitening(centre, width, top, deviation[: top.shape[1]] ** 2 / n, share[: top.shape[1]])


def _identity_error(rows: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened vectors, less the unit matrix."""
    k = len(fitted.values)
    gram = _gram(rows, fitted.width, lambda x: np.column_stack([fitted.project(x), np.ones(len(x))]), k + 1)
    mean = gram[k, :k] / fitted.centre.n
    return float(np.abs(gram[:k, :k] / fitted.centre.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, scale: int = SCALE, most: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of all vectors on the leading components of their covariance.

    ``vectors`` has vec_id and embedding. Rows whose vector is null or holds null or non-finite entries are dropped; entries
    become floor(scale * c), which stops at the ends of 64 bits; shorter vectors are filled up with zeros. The covariance is
    that of the distinct vectors. Returns for each row and component: vec_id, component (from 1), n (vectors fitted on),
    deviation (sum of (n * x - S)^2, exact, null beyond 64 bits), whitened, explained (the component's share of the trace),
    identity_error. Components whose deviation is below ``LEAST`` of the largest cannot be told from 0 and are left out, so
    fewer than two distinct vectors, or none, give no rows. Null and repeated ids are rows like others; other columns are ignored.

    Vectors are shuffled once, to make them distinct, after each task has dropped its own repeats; the distinct ones are
    written to the shared folder, as every pass reads them, and the result comes from one more pass over the table itself.
    """
    rows = vectors.select("vec_id", quantize(F.col("embedding"), scale).alias("x")).where("x is not null")
    widest, narrowest = rows.agg(F.max(F.size("x")), F.min(F.size("x"))).first()
    width = widest or 0
    if width != narrowest:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))))
    path = f"{checkpoint_dir(vectors.sparkSession)}/whitening-{uuid.uuid4().hex}"
    rows.select("x").distinct().write.parquet(path)
    distinct = vectors.sparkSession.read.parquet(path)
    fitted = components(distinct, width, most)
    k = len(fitted.values)
    error = _identity_error(distinct, fitted) if k else 0.0

    def run(batches: Batches) -> Batches:
        for batch in batches:
            x = _rows(batch.column("x"), width)
            numbers = np.repeat(np.arange(len(x)), k)
            columns = [
                batch.column("vec_id").take(pa.array(numbers)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(fitted.centre.deviations(x), pa.int64()).take(pa.array(numbers)),
                pa.array(fitted.project(x).ravel()),
                pa.array(np.tile(fitted.explained, len(x))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "deviation", "whitened", "explained"])

    fields = [vectors.schema["vec_id"], T.StructField("component", T.IntegerType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType())]
    found = (rows if k else rows.where("false")).mapInArrow(run, T.StructType(fields))
    n = F.lit(fitted.centre.n).cast("long").alias("n")
    return found.select("vec_id", "component", n, "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
