"""Whitening of vectors by a covariance weighted with multiplicities.

1. Identical vectors are grouped once, with map-side partial counts, so a vector that fills a third of
   the table is one row per task before anything moves.
2. Sums and, after centring, the covariance are weighted by the group sizes (``weights="counts"``) or
   by one (``weights="one"``). Every task adds up one matrix product of its rows; the partial matrices are
   summed row by row in tasks of their own. Only one matrix of dimensions x dimensions reaches the driver.
3. Every distinct vector is whitened once. The same weighted product over the whitened vectors gives
   ``identity_error``. Results are joined back to the rows; groups that are frequent stay out of the shuffle.

Vectors are arrays of whole numbers (see ``quantised``), so sums and deviations are exact. Rows find their
vector by two 64-bit hashes.

Defined results: rows without a vector, or with a null in it, are left out. So are vectors of another
length than the commonest (the longer one on ties). Components whose eigenvalue is below ``RELATIVE_ZERO``
of the largest have no direction and are left out, so equal vectors, a single row or an empty table give
an empty result. A deviation beyond 64 bits is null. Repeated rows and null keys get rows of their own.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadloom.llm.rows import join_counted, prepare
from broadloom.session import materialize

COMPONENTS = 32
#: Entries of a vector are at most this large, so that they are exact as doubles.
LARGEST = 1 << 52
RELATIVE_ZERO = 1e-10
_LOW = 26  # bits of the lower part of an entry when sums are taken

#: Rows of a partial matrix that a task emits.
_PARTIAL = "i int, task int, cells array<double>"


def quantised(vector: str, scale: int = 64, offset: int = 1_000_000) -> Column:
    """``floor(scale * c) + offset`` of every entry as double; null for a vector that is not usable.

    A vector is not usable if it is null or holds a null, an entry that is not finite or one that
    would go beyond ``LARGEST``.
    """
    limit = float((LARGEST - offset) // scale)
    whole = F.transform(F.col(vector), lambda c: c.cast("double"))
    # Compares to false for NaN and infinities.
    usable = F.forall(whole, lambda c: F.coalesce((c < limit) & (c > -limit), F.lit(False)))
    return F.when(usable, F.transform(whole, lambda c: F.floor(c * scale) + offset))


def _vectors(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.int64, copy=False)


def _weights(column: pa.Array, weights: str) -> np.ndarray:
    counts = column.to_numpy(zero_copy_only=False).astype(np.int64)
    return counts if weights == "counts" else np.ones_like(counts)


def _sums(distinct: DataFrame, weights: str) -> tuple[int, list[int]]:
    """Total weight and the exact weighted sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, low, high = 0, 0, 0
        for batch in batches:
            x, w = _vectors(batch.column(0)), _weights(batch.column(1), weights)
            total += int(w.sum())
            low = low + w @ (x & ((1 << _LOW) - 1))
            high = high + w @ (x >> _LOW)
        if total:
            dims = range(-1, len(low))
            columns = [pa.array(dims, pa.int32()), pa.array([total, *low.tolist()]), pa.array([0, *high.tolist()])]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "low", "high"])

    parts = distinct.select("x", "rows").mapInArrow(run, "i int, low long, high long")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high")]
    of = {r["i"]: int(r["low"]) + (int(r["high"]) << _LOW) for r in parts.groupBy("i").agg(*exact).collect()}
    return of.pop(-1), [of[i] for i in range(len(of))]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: whole numbers first, then the fraction that is left."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n*x - S)**2, or null beyond 64 bits."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    gap = x - whole
    largest = (int(np.abs(gap).max(initial=0)) + 1) * n
    if largest**2 * max(len(sums), 1) < 1 << 63:
        scaled = gap * n - np.array(rest, np.int64)
        return (scaled * scaled).sum(1).tolist()
    exact = [sum((n * g - r) ** 2 for g, r in zip(row, rest, strict=True)) for row in gap.tolist()]
    return [value if value < 1 << 63 else None for value in exact]


def _product(rows: DataFrame, size: int, weights: str, vectors: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """The sum over rows of weight * v'v, for rows of (vector, count)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            v = vectors(batch.column(0))
            total += (v * _weights(batch.column(1), weights)[:, None]).T @ v
        task = TaskContext.get().partitionId()
        cells = pa.FixedSizeListArray.from_arrays(pa.array(total.reshape(-1)), size).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.array([task] * size, pa.int32()), cells], names=["i", "task", "cells"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            cells = batch.column(2).flatten().to_numpy().reshape(-1, size)
            for i, row in zip(batch.column(0).to_pylist(), cells, strict=True):
                total[i] = total[i] + row if i in total else row.copy()
        for i, row in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([0], pa.int32()), pa.array([row.tolist()], pa.list_(pa.float64()))],
                names=["i", "task", "cells"],
            )

    parts = rows.mapInArrow(partial, _PARTIAL)
    # In the order of the tasks, so that a repeated task adds up to the same bits.
    summed = parts.repartition("i").sortWithinPartitions("i", "task").mapInArrow(add, _PARTIAL).collect()
    out = np.zeros((size, size))
    for r in summed:
        out[r["i"]] = r["cells"]
    return out


def _components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, each with its largest entry positive."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(most, int((values > RELATIVE_ZERO * max(values[0], 0)).sum())) if values[0] > 0 else 0
    vectors = vectors[:, :kept]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(kept)])
    return values[:kept], vectors * signs


def whiten(rows: DataFrame, vector: str, key: str, components: int = COMPONENTS, weights: str = "counts") -> DataFrame:
    """``key, n, deviation, whitened, explained, identity_error`` for every usable row.

    ``whitened`` and ``explained`` are arrays over the components. ``n`` is the total weight.
    """
    if weights not in ("counts", "one"):
        raise ValueError(f"unknown weights {weights!r}")
    prepare(rows.sparkSession)
    usable = rows.select(F.col(key).alias("_key"), F.col(vector).cast("array<bigint>").alias("x"))
    usable = usable.filter(F.col("x").isNotNull() & ~F.exists("x", lambda c: c.isNull()))
    distinct = materialize(usable.groupBy("x").agg(F.count("*").alias("rows")), "distinct")
    sizes = distinct.groupBy(F.size("x").alias("d")).agg(F.sum("rows").alias("rows")).orderBy(
        F.desc("rows"), F.desc("d")
    )
    size = next((r["d"] for r in sizes.take(1)), 0)
    out = f"`{key}` {dict(rows.dtypes)[key]}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    if size == 0:
        return rows.sparkSession.createDataFrame([], out)
    distinct = distinct.filter(F.size("x") == size)
    n, sums = _sums(distinct, weights)
    covariance = _product(
        distinct.select("x", "rows"), size, weights, lambda column: _centred(_vectors(column), n, sums)
    )
    covariance /= n
    values, directions = _components(covariance, components)
    if not len(values):
        return rows.sparkSession.createDataFrame([], out)
    scaled = directions / np.sqrt(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(0))
            white = _centred(x, n, sums) @ scaled
            cells = pa.FixedSizeListArray.from_arrays(pa.array(white.reshape(-1)), len(values))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[1:],
                    pa.array(_deviations(x, n, sums), pa.int64()),
                    cells.cast(pa.list_(pa.float64())),
                ],
                names=["name", "rows", "deviation", "whitened"],
            )

    name = F.struct(F.xxhash64("x").alias("one"), F.xxhash64(F.lit(17), "x").alias("two")).alias("name")
    white = distinct.select("x", name, "rows").mapInArrow(
        project, "name struct<one:bigint,two:bigint>, rows long, deviation long, whitened array<double>"
    )
    white = materialize(white, "whitened")
    flat = lambda column: column.flatten().to_numpy().reshape(len(column), -1)
    unit = _product(white.select("whitened", "rows"), len(values), weights, flat) / n
    error = float(np.abs(unit - np.eye(len(values))).max())
    named = usable.filter(F.size("x") == size).select("_key", name)
    total = white.agg(F.sum("rows")).first()[0]
    joined = join_counted(named, white, "name", "rows", total)
    explained = values / np.trace(covariance)
    return joined.select(
        F.col("_key").alias(key),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*[F.lit(float(e)) for e in explained]).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
