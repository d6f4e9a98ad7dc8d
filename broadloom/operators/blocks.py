"""Row-local numpy work on the feature array, one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from broadloom.session import ship_package

# Fixed value: rows handed to a kernel at once.
BATCH_ROWS = 1000


def cells_of(column: pa.Array) -> np.ndarray:
    """A list column as a dense ``[rows, width]`` block; null cells become NaN."""
    lengths = column.value_lengths()
    width = lengths[0].as_py() if len(column) else 0
    if column.null_count or len(set(lengths.to_pylist())) > 1:
        raise ValueError("rows of different widths")
    flat = column.flatten().cast(pa.float64())
    if flat.null_count:
        flat = flat.fill_null(float("nan"))
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), width)


def list_of(block: np.ndarray) -> pa.Array:
    rows, width = block.shape
    offsets = np.arange(0, (rows + 1) * width, width or 1, dtype=np.int32)[: rows + 1]
    return pa.ListArray.from_arrays(offsets, pa.array(block.reshape(-1).astype(np.float64)))


def grouped(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[pa.RecordBatch]]:
    """Runs of sorted rows with equal values in these columns, as slices; one run is held at a time."""
    run: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = list(zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True))
        changes = [i for i, key in enumerate(keys) if key != (keys[i - 1] if i else last)]
        for low, high in zip([0, *changes], [*changes, len(keys)], strict=True):
            if low in changes and run:
                yield run
                run = []
            if high > low:
                run.append(batch.slice(low, high - low))
        if keys:
            last = keys[-1]
    if run:
        yield run


def _message(found: int, width: int) -> str | None:
    if found == width:
        return None
    return "features are null" if found < 0 else f"expected {width} features, found {found}"


def _apply_to_fitting(
    column: pa.Array, kernel: Callable[[np.ndarray], np.ndarray], width: int
) -> tuple[pa.Array, list[str | None]]:
    """Results of the rows of the right width; the others get null and a message."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fits = lengths == width
    messages = [_message(int(n), width) for n in lengths]
    if not fits.any():
        return pa.nulls(len(column), pa.list_(pa.float64())), messages
    result = list_of(kernel(cells_of(column.filter(pa.array(fits)))))
    if not fits.all():
        result = result.take(pa.array(np.cumsum(fits) - 1, mask=~fits))
    return result, messages


def _flagged(cells: pa.Array, kernel: Callable[[np.ndarray], np.ndarray], width: int) -> list[pa.Array]:
    """Results and messages; where the kernel fails, all rows of the block say so."""
    try:
        result, messages = _apply_to_fitting(cells, kernel, width)
    except Exception as failure:  # noqa: BLE001 - reported with the rows
        result = pa.nulls(len(cells), pa.list_(pa.float64()))
        messages = [f"{type(failure).__name__}: {failure}"] * len(cells)
    return [result, pa.array(messages, pa.string())]


def map_features(
    df: DataFrame,
    kernel: Callable[[np.ndarray], np.ndarray],
    output: str,
    *,
    source: str = "features",
    width: int | None = None,
    error: str | None = None,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Append ``output array<double>`` computed by ``kernel`` on blocks of rows.

    All other columns pass through unchanged, so a result always stays with its row.
    With ``error`` a row that is not ``width`` cells wide gets a message in that column
    and a null result, and so do the rows of a block whose kernel fails; without it
    the job fails.
    """
    ship_package(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in (output, error, *drop)]
    fields = [*kept, T.StructField(output, T.ArrayType(T.DoubleType()))]
    if error:
        fields.append(T.StructField(error, T.StringType()))
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(start, BATCH_ROWS)
                columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
                cells = batch.column(batch.schema.get_field_index(source))
                if error is None:
                    columns.append(list_of(kernel(cells_of(cells))))
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, output])
                    continue
                columns += _flagged(cells, kernel, width)
                yield pa.RecordBatch.from_arrays(columns, names=[*names, output, error])

    return df.mapInArrow(run, T.StructType(fields))


def map_features_each(
    df: DataFrame,
    kernels: Callable[[], Sequence[tuple[Callable[[np.ndarray], np.ndarray], int]]],
    output: str,
    error: str,
    number: str,
) -> DataFrame:
    """Every row once for each kernel, told apart by ``number``; ``features`` are dropped.

    ``kernels`` gives the workers pairs of a kernel and its width. Rows are flagged as by
    ``map_features``, for each kernel on its own: the table is read once however many there are.
    """
    ship_package(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in (output, error, "features")]
    names = [f.name for f in kept]
    added = [
        T.StructField(number, T.IntegerType()),
        T.StructField(output, T.ArrayType(T.DoubleType())),
        T.StructField(error, T.StringType()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = list(kernels())
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(start, BATCH_ROWS)
                columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
                cells = batch.column(batch.schema.get_field_index("features"))
                for i, (kernel, width) in enumerate(each):
                    mine = pa.array(np.full(batch.num_rows, i, np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [*columns, mine, *_flagged(cells, kernel, width)], names=[*names, number, output, error]
                    )

    return df.mapInArrow(run, T.StructType([*kept, *added]))


def map_cells(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], width: int) -> DataFrame:
    """Replace ``features`` cell by cell: ``kernel`` gets the first cells of equally long rows.

    Works like a projection of the array: null rows and null cells stay null, shorter rows stay
    short, and cells beyond ``width`` or masked by the kernel become null.
    """
    ship_package(df.sparkSession)
    names = df.columns

    def of_length(column: pa.Array, n: int) -> pa.Array:
        flat = column.flatten().cast(pa.float64())
        block = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(column), n)
        result = np.full(block.shape, np.nan)
        known = min(n, width)
        hidden = flat.is_null().to_numpy(zero_copy_only=False).reshape(block.shape)
        hidden = hidden | (np.arange(n) >= width)
        if known:
            done = kernel(block[:, :known])
            result[:, :known] = np.ma.getdata(done)
            hidden[:, :known] |= np.ma.getmaskarray(done)
        offsets = np.arange(len(column) + 1, dtype=np.int32) * n
        return pa.ListArray.from_arrays(offsets, pa.array(result.reshape(-1), mask=hidden.reshape(-1)))

    def replaced(column: pa.Array) -> pa.Array:
        lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        parts, places = [], []
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            rows = column.take(pa.array(at))
            parts.append(pa.nulls(len(at), pa.list_(pa.float64())) if n < 0 else of_length(rows, n))
            places.append(at)
        if len(parts) == 1:
            return parts[0]
        return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(places))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(start, BATCH_ROWS)
                at = batch.schema.get_field_index("features")
                columns = list(batch.columns)
                columns[at] = replaced(columns[at])
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [
        T.StructField("features", T.ArrayType(T.DoubleType())) if f.name == "features" else f
        for f in df.schema.fields
    ]
    return df.mapInArrow(run, T.StructType(fields))
