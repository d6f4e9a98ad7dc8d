"""The wide labelled matrix.

A matrix is a DataFrame of optional string metadata columns, an optional
``row_id`` and one ``features array<double>`` column. Features are never modelled
as columns: plans stay the same size for ten features and for a hundred thousand.
``feature_index(feature_idx, feature_name, dtype)`` names the array positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The metadata columns of a feature table, in output order.
METADATA = (
    "Assembly",
    "Domain",
    "Phylum",
    "Class",
    "Order",
    "Family",
    "Genus",
    "Species",
    "Genome accessions",
    "Label",
)

FEATURE_INDEX_SCHEMA = "feature_idx int, feature_name string, dtype string"

_Q = "`{}`".format


class MissingColumns(ValueError):
    """A required column is not in the table."""


def present_metadata(columns: Sequence[str], metadata: Sequence[str] = METADATA) -> list[str]:
    """The metadata columns that exist, in the order of the metadata list."""
    have = set(columns)
    return [name for name in metadata if name in have]


def feature_fields(
    schema: T.StructType,
    metadata: Sequence[str] = METADATA,
    mode: str = "all_non_metadata",
    exclude: Sequence[str] = (),
) -> list[T.StructField]:
    """The fields that count as features.

    ``float64_only`` keeps double columns; ``all_non_metadata`` keeps every column
    that is not metadata.
    """
    if mode not in ("float64_only", "all_non_metadata"):
        raise ValueError(f"unknown feature mode {mode!r}")
    skip = set(metadata) | set(exclude)
    fields = [f for f in schema.fields if f.name not in skip]
    if mode == "float64_only":
        fields = [f for f in fields if isinstance(f.dataType, T.DoubleType)]
    return fields


def feature_index(
    spark: SparkSession,
    schema: T.StructType,
    metadata: Sequence[str] = METADATA,
    mode: str = "all_non_metadata",
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Names and types of the features of a columnar table, by position."""
    rows = [
        (i, f.name, f.dataType.simpleString())
        for i, f in enumerate(feature_fields(schema, metadata, mode, exclude))
    ]
    return spark.createDataFrame(rows, FEATURE_INDEX_SCHEMA)


def to_matrix(
    df: DataFrame,
    metadata: Sequence[str] = METADATA,
    *,
    mode: str = "all_non_metadata",
    exclude: Sequence[str] = (),
    null_policy: str = "zero",
    keep: Sequence[str] = (),
    require_metadata: bool = False,
) -> DataFrame:
    """Split a columnar table into metadata columns and one feature array.

    ``keep`` names further columns (a row key) to carry along; they are never features.
    """
    if require_metadata:
        absent = [name for name in metadata if name not in df.columns]
        if absent:
            raise MissingColumns(f"metadata columns not found: {absent}")
    fields = feature_fields(df.schema, metadata, mode, [*exclude, *keep])
    # One SQL text instead of one object per column: tens of thousands are planned in seconds.
    array = F.expr(f"array({', '.join(f'cast({_quoted(f.name)} as double)' for f in fields)})")
    carried = [*keep, *[m for m in present_metadata(df.columns, metadata) if m not in keep]]
    matrix = df.select(*[F.col(_Q(c)) for c in carried], array.alias("features"))
    return fill_nulls(matrix.withColumn("features", F.col("features").cast("array<double>")), null_policy)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fill_nulls(matrix: DataFrame, null_policy: str = "zero") -> DataFrame:
    """``zero`` replaces null cells by 0.0; NaN cells stay. ``propagate`` changes nothing."""
    if null_policy == "propagate":
        return matrix
    if null_policy != "zero":
        raise ValueError(f"unknown null policy {null_policy!r}")
    filled = F.transform("features", lambda x: F.coalesce(x, F.lit(0.0)))
    return matrix.withColumn("features", filled)


def as_float32(matrix: DataFrame) -> DataFrame:
    """Round every cell to single precision."""
    return matrix.withColumn("features", F.col("features").cast("array<float>"))


def as_float64(matrix: DataFrame) -> DataFrame:
    return matrix.withColumn("features", F.col("features").cast("array<double>"))


def clip(matrix: DataFrame, lo: float, hi: float) -> DataFrame:
    from broadloom.functions.numeric import clip as clip_value

    clipped = F.transform("features", lambda x: clip_value(x, lo, hi))
    return matrix.withColumn("features", clipped)


def trim(matrix: DataFrame, width: int, *, strict: bool = False) -> DataFrame:
    """Keep the first ``width`` features by position.

    A narrower row is left as it is, or fails the job when ``strict``.
    """
    trimmed = F.slice("features", 1, width)
    if strict:
        short = F.concat(
            F.lit(f"expected {width} features, found "), F.size("features").cast("string")
        )
        trimmed = F.when(F.size("features") >= width, trimmed).otherwise(F.raise_error(short))
    return matrix.withColumn("features", trimmed)


def align(matrix: DataFrame, names: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """Reorder the feature array of ``names`` to ``wanted`` by name.

    Features absent from the input become 0.0; features not wanted are dropped.
    The position list is one array literal, whatever the width.
    """
    where = {name: i for i, name in enumerate(names)}
    positions = ",".join(str(where.get(name, -1)) for name in wanted)
    lookup = F.split(F.lit(positions), ",").cast("array<int>")
    aligned = F.transform(
        lookup,
        lambda p: F.when(p >= 0, F.get(F.col("features"), p)).otherwise(F.lit(0.0)),
    )
    return matrix.withColumn("features", aligned)


def to_long(matrix: DataFrame, keep: Sequence[str] = (), features: str = "features") -> DataFrame:
    """One row per cell: ``keep..., feature_idx, value``."""
    return matrix.select(*keep, F.posexplode(features).alias("feature_idx", "value"))


def from_long(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Back to one array per row; a group holds one row's cells only."""
    cells = F.array_sort(F.collect_list(F.struct("feature_idx", F.col(value).alias("v"))))
    return long.groupBy(*keys).agg(F.transform(cells, lambda c: c["v"]).alias("features"))


def name_columns(df: DataFrame, array: str, width: int, prefix: str = "encoded_") -> DataFrame:
    """Spread an array over ``width`` named columns."""
    others = [_quoted(c) for c in df.columns if c != array]
    spread = [f"get({_quoted(array)}, {i}) as {_quoted(f'{prefix}{i}')}" for i in range(width)]
    return df.selectExpr(*others, *spread)


def preview(df: DataFrame, array: str, rows: int, width: int = 5) -> DataFrame:
    """The first ``width`` entries of a few rows: a report, hence the limit."""
    return df.withColumn(array, F.slice(array, 1, width)).limit(rows)


def width_of(matrix: DataFrame) -> int:
    """Number of features, read from one row."""
    first = matrix.select(F.size("features").alias("n")).first()
    return 0 if first is None else int(first["n"])


def missing_cells(array: Column) -> Column:
    """How many cells of one row are null or NaN."""
    return F.size(F.filter(array, lambda x: x.isNull() | F.isnan(x)))
