"""Embedding whitening by shifted CholeskyQR (operator 12).

Vectors become integers, whose sums are exact; rows are centred as exact integers (n * x - S)
before any rounding. A pass over the rows adds up the Gram matrix of the rows times the inverse
of the factor found so far, each task one partial matrix, summed row by row in the order of the
partitions. The driver shifts the first matrix so that it has a Cholesky factor, multiplies the
factor on, and repeats until the rows are orthogonal to rounding error. The singular values and
right vectors of the final factor, a matrix of the vectors' dimension, are the standard
deviations and components. Only sums, Gram matrices and factors, which grow with the square of
the dimension and not with the rows, reach the driver.

Defined cases: a vector that is null or holds a null or non-finite entry is dropped; so is one of
another length than the most frequent (of equally frequent ones the greater); an empty vector too.
Entries are held in 64 bits: those beyond 2**52 / ``scale`` in size are set to that bound. Directions without
variance beyond rounding are no components, so there may be fewer than asked for, none with one
vector or equal ones. A deviation beyond a long is null. Null or repeated ids stay rows of their
own. An empty table gives no rows. Further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.frames import named

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Gram passes at most; three are enough unless the rows lack full rank.
PASSES = 4
#: Rows of doubles worked on at once.
ROWS = 4096

_LIMIT = float(1 << 52)
_EPSILON = np.finfo(float).eps


@dataclass
class Fit:
    """What the rows amount to: count, exact sums per dimension, components as columns, their variances."""

    dimension: int
    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total_variance: float


def usable(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors to use, and their entries as doubles, one row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dimension), False).to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(column.take(pa.array(at))).cast(pa.float64())
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(len(at), dimension)
    good = np.isfinite(values).all(1)
    return at[good], values[good]


def as_integers(values: np.ndarray, scale: int = SCALE, offset: int = OFFSET) -> np.ndarray:
    return np.floor(np.clip(values * scale, -_LIMIT, _LIMIT)).astype(np.int64) + offset


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: in 64 bits where that is enough, as Python integers elsewhere."""
    s = np.array(sums, object)
    most = max(int(np.abs(x).max(initial=0)), 1) * n + max(map(abs, sums), default=0)
    return n * x - s.astype(np.int64) if most < 1 << 62 else n * x.astype(object) - s


def _pieces(batches: Iterable[pa.RecordBatch], dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, places, integers) in runs of ``ROWS`` rows."""
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            part = batch.slice(first, ROWS)
            at, values = usable(part.column(part.num_columns - 1), dimension)
            if len(at):
                yield part, at, as_integers(values)


def common_dimension(vectors: DataFrame) -> int:
    """The most frequent length of a usable vector, 0 if there is none."""

    def lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            sizes = pc.unique(pc.list_value_length(column).drop_null()).to_pylist()
            found = [len(usable(column, size)[0]) if size else 0 for size in sizes]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(found, pa.int64())], ["size", "n"])

    counts = vectors.mapInArrow(lengths, "size bigint, n bigint").filter("size > 0 AND n > 0").groupBy("size").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.desc("n"), F.desc("size")).first()
    return found["size"] if found else 0


def exact_sums(vectors: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """How many vectors are used, and the exact sum of their integers in each dimension."""

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, x in _pieces(batches, dimension):
            # halves of 32 bits, so that no sum of a piece overflows
            low, high = (x & 0xFFFFFFFF).sum(0), (x >> 32).sum(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(dimension)), pa.array(np.full(dimension, len(x))), pa.array(low), pa.array(high)], ["i", "n", "low", "high"]
            )

    parts = vectors.mapInArrow(summed, "i bigint, n bigint, low bigint, high bigint")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high")]
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), *wide).collect()
    sums = [0] * dimension
    for r in rows:
        sums[r["i"]] = int(r["high"]) * (1 << 32) + int(r["low"])
    return (rows[0]["n"] if rows else 0), sums


def gram(
    vectors: DataFrame, dimension: int, n: int, sums: list[int], width: int, turned: Callable[[np.ndarray], np.ndarray]
) -> np.ndarray:
    """The Gram matrix of the centred rows after ``turned``, which gives rows of ``width`` columns."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, _, x in _pieces(batches, dimension):
            rows = turned((_centred(x, n, sums) / n).astype(float))
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "entries"])

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(table["part"].to_numpy())
        entries = pc.list_flatten(table["entries"]).to_numpy().reshape(-1, width)[order]
        return pa.table({"i": table["i"].slice(0, 1), "entries": pa.array([entries.sum(0)], pa.list_(pa.float64()))})

    parts = vectors.mapInArrow(partial, "i bigint, entries array<double>").withColumn("part", F.spark_partition_id())
    out = np.zeros((width, width))
    for r in parts.groupBy("i").applyInArrow(add, "i bigint, entries array<double>").collect():
        out[r["i"]] = r["entries"]
    return (out + out.T) / 2


def _cholesky(matrix: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """The upper factor; with a shift beyond what rounding may have taken off, if asked for or needed."""
    d = len(matrix)
    if not shifted:
        try:
            return np.linalg.cholesky(matrix).T
        except np.linalg.LinAlgError:
            pass
    shift = 11 * (n * d + d * (d + 1)) * _EPSILON * np.linalg.norm(matrix, 2)
    while True:
        try:
            return np.linalg.cholesky(matrix + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = shift * 16 or 1.0


def _solved(factor: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Rows times the inverse of the upper triangular ``factor``."""
    lower = np.ascontiguousarray(factor.T)
    return lambda rows: np.linalg.solve(lower, rows.T).T


def fit(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> Fit:
    """Components of the greatest variance, at most ``components``."""
    column = vectors.select(named(vector))
    dimension = common_dimension(column)
    n, sums = exact_sums(column, dimension) if dimension else (0, [])
    nothing = Fit(dimension, n, sums, np.zeros((dimension, 0)), np.zeros(0), 0.0)
    if not n:
        return nothing
    factor = np.eye(dimension)
    for done in range(PASSES):
        matrix = gram(column, dimension, n, sums, dimension, _solved(factor) if done else lambda rows: rows)
        if not matrix.any():
            return nothing
        if done and np.abs(matrix - np.eye(dimension)).max() < 1e-12:
            break
        factor = _cholesky(matrix, n, shifted=not done) @ factor
    _, deviation, right = np.linalg.svd(factor)
    kept = min(components, int((deviation > dimension * _EPSILON * 8 * deviation[0]).sum()))
    return Fit(dimension, n, sums, right[:kept].T, deviation[:kept] ** 2 / n, float((deviation**2).sum()) / n)


def whiten(
    vectors: DataFrame, found: Fit, vec_id: str = "vec_id", vector: str = "embedding", measure: bool = True
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), one row for each vector and component.

    identity_error comes from one more Gram pass, over the whitened rows themselves.
    """
    scaled = found.components / np.sqrt(found.variances)
    kept, n, sums, dimension = scaled.shape[1], found.n, found.sums, found.dimension
    error = None
    if measure and kept:
        error = float(np.abs(gram(vectors.select(named(vector)), dimension, n, sums, kept, lambda rows: rows @ scaled) / n - np.eye(kept)).max())
    explained = found.variances / found.total_variance if kept else found.variances

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at, x in _pieces(batches, dimension) if kept else ():
            centred = _centred(x, n, sums)
            # a square fits if its root is below 2**31.5; sums are checked in double precision
            about = (centred.astype(float) ** 2).sum(1)
            exact = (centred.astype(object) if about.max() >= 1 << 62 else centred) ** 2
            deviation = [int(v) if v < 1 << 63 else None for v in exact.sum(1)]
            white = (centred / n).astype(float) @ scaled
            each = np.repeat(np.arange(len(at)), kept)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(at[each])), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(at))),
                    pa.array(deviation, pa.int64()).take(pa.array(each)), pa.array(white.ravel()), pa.array(np.tile(explained, len(at))),
                ],
                ["vec_id", "component", "deviation", "whitened", "explained"],
            )

    id_type = vectors.schema[vec_id].dataType.simpleString()
    out = vectors.select(named(vec_id).alias("vec_id"), named(vector)).mapInArrow(
        rows, f"vec_id {id_type}, component int, deviation bigint, whitened double, explained double"
    )
    return out.select(
        "vec_id", "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", "explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
