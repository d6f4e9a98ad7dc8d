"""Parameter arrays for row-local work, whatever their size.

Small arrays are broadcast. The rows of larger ones are written by the executors to files of the
shared folder, and Spark ships these to every node once; no row passes through the driver.
The first worker of a node that needs the array lays it out as one file beside them, row group by row
group, and all workers map it: they share the pages that are in use, so a worker needs memory for
its batch of rows only. Code that uses an array does not see which of both it got.
"""

from __future__ import annotations

import fcntl
import os
import uuid

import numpy as np
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.session import list_files, scratch_path

# Arrays of this many doubles (160 MB) may be held by every Python worker.
MAX_HELD = 20_000_000


class MappedArray:
    """A stored two-dimensional array that opens where it is used."""

    __array_ufunc__ = None  # so that ``block @ mapped`` comes here

    def __init__(self, name: str, files: list[str], shape: tuple[int, int]):
        self.name, self.files, self.shape = name, files, shape
        self._array: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"name": self.name, "files": self.files, "shape": self.shape, "_array": None}

    def open(self) -> np.ndarray:
        if self._array is None:
            path = os.path.join(SparkFiles.getRootDirectory(), self.name)
            with open(f"{path}.lock", "w") as lock:
                fcntl.flock(lock, fcntl.LOCK_EX)
                if not os.path.exists(path):
                    self._lay_out(f"{path}.part")
                    os.replace(f"{path}.part", path)
            self._array = np.load(path, mmap_mode="r")
        return self._array

    def _lay_out(self, path: str) -> None:
        out = np.lib.format.open_memmap(path, mode="w+", dtype=np.float64, shape=self.shape)
        for name in self.files:
            for batch in pq.ParquetFile(SparkFiles.get(name)).iter_batches(batch_size=256):
                rows = batch.column(0).to_numpy()
                out[rows] = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        out.flush()

    def __rmatmul__(self, block: np.ndarray) -> np.ndarray:
        return block @ self.open()


def opened(array: np.ndarray | MappedArray) -> np.ndarray:
    return array.open() if isinstance(array, MappedArray) else array


def hold(rows: DataFrame, index: str, values: str, limit: int = MAX_HELD) -> np.ndarray | MappedArray:
    """The arrays ``values`` of all rows in the order of ``index``, which counts from 0.

    All arrays must have the same length. Up to ``limit`` doubles the result is an array,
    above it a mapped file.
    """
    size = rows.agg(
        F.count("*").alias("n"), F.min(F.size(values)).alias("least"), F.max(F.size(values)).alias("most")
    ).first()
    if size["n"] == 0:
        return np.zeros((0, 0))
    if size["least"] != size["most"]:
        raise ValueError(f"arrays of {size['least']} to {size['most']} values")
    shape = (size["n"], size["most"])
    ordered = rows.select(F.col(index).alias("i"), F.col(values).alias("w")).orderBy("i")
    if shape[0] * shape[1] <= limit:
        return np.array([r["w"] for r in ordered.collect()], float).reshape(shape)
    return _write(rows.sparkSession, rows.select(F.col(index).alias("i"), F.col(values).alias("w")), shape)


def _write(spark: SparkSession, rows: DataFrame, shape: tuple[int, int]) -> MappedArray:
    path = scratch_path(spark, "array")
    # Small row groups, so that a worker lays the array out with little memory.
    rows.write.option("parquet.block.size", str(16 << 20)).parquet(path)
    files = list_files(spark, path, ".parquet")
    for file in files:
        spark.sparkContext.addFile(file)
    return MappedArray(f"array-{uuid.uuid4().hex}.npy", [os.path.basename(f) for f in files], shape)
