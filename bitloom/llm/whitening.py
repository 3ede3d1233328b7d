"""Whitening of embeddings by shifted CholeskyQR.

The centred rows A are never gathered: a pass over them sums the Gram matrix of what is orthogonal so far, its Cholesky factor
is solved against the rows in the next pass, and the factors are composed, A = Q (R_m ... R_1). The first factor is of a Gram
matrix with a small multiple of the identity added, so that ill-conditioned rows have one. The singular value
decomposition of the composed R gives the components, without squaring the condition of A as a covariance would.

Entries become whole numbers (``scale`` steps to one), rows are counted once per distinct vector. Only sums per dimension and
matrices of dimension by dimension reach the driver.

Defined results: a vector that is null, empty or holds a null, a non-finite number or one beyond 2^62 steps is dropped, and so is one whose length is
not the most common one (of equally common ones the longest); null and repeated ids are rows like others; constant and linearly dependent
dimensions give fewer components; without spread, and for an empty table, there are no components and no rows; a deviation beyond 64 bits is null;
columns besides id and vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE = 256
MOST = 4
ROUNDS = 8
CLOSE = 1e-3  # Gram matrix minus the identity; one factor more and the rows are orthogonal up to rounding
DEPENDENT = 1e-24  # a component with less than this share of the first one's spread is none
CHUNK = 1 << 20  # entries of a block of rows
LIMIT = 1 << 63
REACH = 1 << 62  # differences of whole numbers below it fit 64 bits


def _packed(scale: int):
    """x as bytes of the narrowest whole numbers; equal vectors have equal bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, dims = [], []
            for vec in batch.column(1):
                x = None
                if vec.is_valid and len(vec.values) and not vec.values.null_count:
                    steps = np.floor(vec.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                    if np.isfinite(steps).all() and np.abs(steps).max() < REACH:
                        x = steps.astype(np.int64)
                dims.append(None if x is None else len(x))
                if x is not None:
                    width = next(w for w in (1, 2, 4, 8) if np.iinfo(f"i{w}").min <= x.min() and x.max() <= np.iinfo(f"i{w}").max)
                    x = x.astype(f"<i{width}").tobytes()
                out.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["id", "dim", "x"])

    return run


def _blocks(column: pa.Array, dim: int) -> Iterator[np.ndarray]:
    """Rows of whole numbers, some at a time."""
    for at in range(0, len(column), max(1, CHUNK // dim)):
        part = [v.as_py() for v in column.slice(at, max(1, CHUNK // dim))]
        yield np.stack([np.frombuffer(v, f"<i{len(v) // dim}") for v in part]).astype(np.int64)


def _triangle(sums: np.ndarray) -> pa.RecordBatch:
    i, j = np.triu_indices(len(sums))
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums[i, j], pa.float64())], ["i", "j", "v"])


def _gram(dim: int, rows_of):
    """Upper triangle of the sum of row times row over a task, one row per entry."""

    def run(batches):
        sums = None
        for batch in batches:
            for x in _blocks(batch.column(0), dim):
                rows = rows_of(x)
                sums = rows.T @ rows if sums is None else sums + rows.T @ rows
        if sums is not None:
            yield _triangle(sums)

    return run


def _summed(fit: DataFrame, dim: int, size: int, rows_of) -> np.ndarray:
    """The Gram matrix of ``rows_of(x)``: added up by Spark, ``size`` by ``size`` entries reach the driver."""
    parts = fit.select("x").mapInArrow(_gram(dim, rows_of), "i int, j int, v double")
    out = np.zeros((size, size))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def _totals(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Rows and sums per dimension, exactly."""

    def run(batches):
        for batch in batches:
            for x in _blocks(batch.column(0), dim):
                safe = np.abs(x.astype(np.float64)).max() * len(x) < LIMIT / 4
                sums = x.sum(0).tolist() if safe else x.astype(object).sum(0).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([len(x)] * dim, pa.int64()), pa.array(range(dim), pa.int32()), pa.array(list(map(str, sums)))], ["n", "i", "s"])

    parts = fit.select("x").mapInArrow(run, "n bigint, i int, s string")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    rows.sort(key=lambda r: r["i"])
    return (rows[0]["n"], [int(r["s"]) for r in rows]) if rows else (0, [])


def _solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows times the inverse of an upper triangular factor."""
    return np.linalg.solve(factor.T, rows.T).T


class Whitening:
    """Sums, components and eigenvalues of a fit list; what a task needs to transform rows."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, eigenvalues: np.ndarray, trace: float):
        self.n, self.sums, self.components, self.eigenvalues, self.trace = n, sums, components, eigenvalues, trace
        self.whole = [s // n for s in sums]  # the mean in two parts, so that large entries lose nothing
        self.rest = np.array([(s % n) / n for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array(self.whole, np.int64)).astype(np.float64) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2."""
        far = max(abs(self.n * int(v) - s) for m in (x.min(0), x.max(0)) for v, s in zip(m, self.sums))
        if far * far * len(self.sums) < LIMIT and max(map(abs, self.sums)) < LIMIT // 2:
            d = x * self.n - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        d = x.astype(object) * self.n - np.array(self.sums, object)
        return [v if v < LIMIT else None for v in (d * d).sum(1).tolist()]


def shifted_cholesky_qr(fit: DataFrame, n: int, sums: list[int], rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """R of the centred rows, up to rotation of what is orthogonal, and the sum of squares of all entries.

    A Gram pass per round. The first shift is 11 (n d + d (d + 1)) units of rounding times the sum of squares, which bounds the
    norm; later ones are of the dimension alone, and none is needed once the Gram matrix is near the identity."""
    dim, unit = len(sums), np.finfo(np.float64).eps / 2
    base = Whitening(n, sums, np.zeros((dim, 0)), np.zeros(0), 0.0)
    factors: list[np.ndarray] = []
    composed, squares = np.eye(dim), 0.0

    for k in range(rounds):
        done = list(factors)

        def rows_of(x: np.ndarray) -> np.ndarray:
            rows = base.centred(x)
            for f in done:
                rows = _solved(rows, f)
            return rows

        gram = _summed(fit, dim, dim, rows_of)
        off = np.abs(gram - np.eye(dim)).max() if k else math.inf
        if k == 0:
            squares = float(np.trace(gram))
            if not squares > 0:
                return np.zeros((dim, dim)), 0.0
            # for very many rows the bound is beyond use; rounding of sums over tasks grows far slower
            shift = min(11 * (n * dim + dim * (dim + 1)) * unit, 1e-3 / dim) * squares
        else:
            shift = 0.0 if off < 0.5 else dim * unit * max(1.0, float(np.trace(gram)))
        factor = np.linalg.cholesky(gram + shift * np.eye(dim)).T
        factors.append(factor)
        composed = factor @ composed
        if off <= CLOSE:
            break
    return composed, squares


def fit_whitening(fit: DataFrame, most: int = MOST) -> Whitening | None:
    """From distinct packed vectors (x) of one dimension (dim); None without rows or without spread."""
    first = fit.select("dim").first()
    if first is None:
        return None
    n, sums = _totals(fit, first["dim"])
    r, squares = shifted_cholesky_qr(fit, n, sums)
    if not squares > 0:
        return None
    _, sizes, turned = np.linalg.svd(r)
    keep = int((sizes[:most] ** 2 > DEPENDENT * sizes[0] ** 2).sum())
    components = turned[:keep].T
    largest = np.abs(components).argmax(0)
    components = components * np.sign(components[largest, range(keep)])
    return Whitening(n, sums, components, sizes[:keep] ** 2 / n, squares / n)


def _identity_error(fit: DataFrame, w: Whitening) -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity."""
    dim, size = len(w.sums), w.components.shape[1]

    def rows_of(x: np.ndarray) -> np.ndarray:
        return np.hstack([w.whitened(x), np.ones((len(x), 1))])

    sums = _summed(fit, dim, size + 1, rows_of) / w.n
    mean = sums[-1, :-1]
    return float(np.abs(sums[:-1, :-1] - np.outer(mean, mean) - np.eye(size)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = MOST, scale: int = SCALE) -> DataFrame:
    """One row per kept row and component: id, component, n, deviation, whitened, explained, identity_error."""
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vec_col].alias("v"))
    rows = stored(rows.mapInArrow(_packed(scale), f"id {kind}, dim int, x binary").filter("x is not null"), "whole-vectors")
    dims = rows.groupBy("dim").count().agg(F.max(F.struct("count", "dim")).alias("m")).first()["m"]
    if dims is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    rows = rows.filter(F.col("dim") == dims["dim"])
    fit = stored(rows.select("dim", "x").distinct(), "distinct-vectors")
    w = fit_whitening(fit, most)
    if w is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    error, dim, size = _identity_error(fit, w), len(w.sums), w.components.shape[1]
    share = w.eigenvalues / w.trace

    def run(batches):
        for batch in batches:
            at = 0
            for x in _blocks(batch.column(1), dim):
                ids = batch.column(0).slice(at, len(x)).take(pa.array(np.repeat(np.arange(len(x)), size)))
                at += len(x)
                deviation = pa.array(w.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), size)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, size + 1), len(x)), pa.int32()),
                        pa.array(np.full(len(x) * size, w.n), pa.int64()),
                        deviation,
                        pa.array(w.whitened(x).ravel(), pa.float64()),
                        pa.array(np.tile(share, len(x)), pa.float64()),
                        pa.array(np.full(len(x) * size, error), pa.float64()),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("id", "x").mapInArrow(run, schema).withColumnRenamed("id", id_col)
