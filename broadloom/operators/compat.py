"""Does a table fit a stored scaler? Schema questions run no job over the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadloom.operators.matrix import (
    METADATA,
    feature_fields,
    missing_cells,
    present_metadata,
    to_matrix,
)


class Incompatible(ValueError):
    """The table cannot be scaled with the stored parameters."""


def expected_features(params: DataFrame, scaler: str) -> int | None:
    """Feature count of a stored scaler; None when it is not stored."""
    n = params.filter(F.col("scaler") == scaler).count()
    return n or None


def feature_count_check(n_features: int, expected: int | None) -> dict[str, int | bool | None]:
    known = expected is not None
    return {
        "n_features": n_features,
        "expected": expected,
        "missing": max(expected - n_features, 0) if known else None,
        "extra": max(n_features - expected, 0) if known else None,
        "count_matches": known and n_features == expected,
    }


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.NumericType, T.BooleanType))


def non_numeric(fields: Sequence[T.StructField]) -> list[str]:
    return [f.name for f in fields if not is_numeric(f.dataType)]


def gate(
    schema: T.StructType,
    expected: int | None,
    metadata: Sequence[str] = METADATA,
    exclude: Sequence[str] = (),
) -> None:
    """Raise before any wide job when the schema alone rules the table out."""
    fields = feature_fields(schema, metadata, exclude=exclude)
    verdict = feature_count_check(len(fields), expected)
    if not verdict["count_matches"]:
        raise Incompatible(f"expected {expected} features, found {len(fields)}")
    text = non_numeric(fields)
    if text:
        raise Incompatible(f"{len(text)} non-numeric feature columns, first: {text[:5]}")


def gate_names(names: Sequence[str], expected: int | None, bad_cells: DataFrame | None = None) -> None:
    """The gate of a table that was read as an array: its feature names, and text cells if counted.

    ``bad_cells`` is the result of ``non_numeric_features``; only its first rows are read.
    """
    verdict = feature_count_check(len(names), expected)
    if not verdict["count_matches"]:
        raise Incompatible(f"expected {expected} features, found {len(names)}")
    if bad_cells is not None:
        n = bad_cells.count()
        first = [names[r["feature_idx"]] for r in bad_cells.orderBy("feature_idx").limit(5).collect()] if n else []
        if n:
            raise Incompatible(f"{n} non-numeric feature columns, first: {first}")


CHECK_SCHEMA = (
    "total_columns int, n_metadata int, metadata_found string, n_features int, expected int, "
    "missing int, extra int, count_matches boolean, n_non_numeric int, "
    "first_non_numeric string, compatible boolean"
)


def check_schema(
    spark: SparkSession,
    schema: T.StructType,
    expected: int | None,
    metadata: Sequence[str] = METADATA,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """The part of the check that needs only names and types: one row."""
    fields = feature_fields(schema, metadata, exclude=exclude)
    verdict = feature_count_check(len(fields), expected)
    found = present_metadata(schema.names, metadata)
    text = non_numeric(fields)
    row = (
        len(schema.names), len(found), ",".join(found), verdict["n_features"], expected,
        verdict["missing"], verdict["extra"], verdict["count_matches"], len(text),
        ",".join(text[:5]), bool(verdict["count_matches"] and not text),
    )
    return spark.createDataFrame([row], CHECK_SCHEMA)


def check_csv(
    spark: SparkSession, path: str, expected: int | None, metadata: Sequence[str] = METADATA
) -> DataFrame:
    """The full check of a very wide CSV, read as one array per row; types come from all rows."""
    from broadloom.sources import tables

    text, names = tables.read_text_matrix(spark, path, metadata)
    index = tables.infer_feature_types(text, names)
    types = {"bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}
    found = {r["feature_name"]: types[r["dtype"]] for r in index.select("feature_name", "dtype").collect()}
    header = tables.read_header(spark, path)
    schema = T.StructType([T.StructField(n, found.get(n, T.StringType())) for n in header])
    counted = missing_count(tables.parse_cells(text))
    return with_counts(check_schema(spark, schema, expected, metadata), counted)


def check(
    df: DataFrame,
    expected: int | None,
    metadata: Sequence[str] = METADATA,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """The full check of a columnar table: the schema part, rows and missing cells.

    Missing cells only warn: they are filled before scaling.
    """
    fields = feature_fields(df.schema, metadata, exclude=exclude)
    numeric = [f for f in fields if is_numeric(f.dataType)]
    others = [f.name for f in fields if not is_numeric(f.dataType)]
    only = to_matrix(df, metadata, exclude=[*exclude, *others], null_policy="propagate") if numeric else df.select(
        F.array().cast("array<double>").alias("features")
    )
    counted = missing_count(only)
    return with_counts(check_schema(df.sparkSession, df.schema, expected, metadata, exclude), counted)


def with_counts(verdict: DataFrame, counted: DataFrame) -> DataFrame:
    """Attach the one-row ``missing_count`` result to a one-row verdict."""
    both = F.struct("rows", "missing_cells")
    return verdict.withColumn("_c", counted.select(both).scalar()).select(
        *verdict.columns, F.col("_c.rows").alias("rows"), F.col("_c.missing_cells").alias("missing_cells")
    )


def missing_count(matrix: DataFrame) -> DataFrame:
    """``rows, missing_cells``: null and NaN cells of the whole matrix."""
    return matrix.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(missing_cells(F.col("features")).cast("bigint")), F.lit(0)).alias(
            "missing_cells"
        ),
    )


def non_numeric_features(text_long: DataFrame) -> DataFrame:
    """Features read as text that hold something other than numbers.

    Takes ``feature_idx, value string``; gives ``feature_idx, bad_cells``.
    """
    v = F.trim("value")
    bad = (v != "") & F.expr("try_cast(trim(value) as double)").isNull()
    return (
        text_long.groupBy("feature_idx")
        .agg(F.count_if(bad).alias("bad_cells"))
        .filter("bad_cells > 0")
    )


# --- profile of the column list -------------------------------------------


def dtype_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("dtype").agg(F.count("*").alias("columns"))


def find_columns(index: DataFrame, part: str) -> DataFrame:
    """Columns whose name contains ``part``."""
    return index.filter(F.col("feature_name").contains(part))


def column_status(index: DataFrame, name: str, kept: DataFrame) -> DataFrame:
    """Presence, position and type of one column, and whether ``kept`` dropped it."""
    mine = F.col("feature_name") == name
    here = index.agg(
        F.count_if(mine).alias("c"),
        F.max(F.when(mine, F.col("feature_idx"))).alias("position"),
        F.max(F.when(mine, F.col("dtype"))).alias("dtype"),
    )
    still = kept.agg(F.count_if(mine).alias("c"))
    return here.withColumn("_kept", still.scalar()).select(
        F.lit(name).alias("feature_name"),
        (F.col("c") > 0).alias("present"),
        "position",
        "dtype",
        ((F.col("c") > 0) & (F.col("_kept") == 0)).alias("excluded"),
    )


def edges(index: DataFrame, n: int = 20) -> DataFrame:
    """The first and last ``n`` entries of a feature index, tagged."""
    width = F.col("_w")
    held = index.withColumn("_w", index.agg(F.count("*")).scalar())
    tag = F.when(F.col("feature_idx") < n, "first").when(F.col("feature_idx") >= width - n, "last")
    both = (F.col("feature_idx") < n) & (F.col("feature_idx") >= width - n)
    where = F.when(both, F.array(F.lit("first"), F.lit("last"))).when(
        tag.isNotNull(), F.array(tag)
    )
    return held.select(F.explode(where).alias("part"), *index.columns)


def alignment(have: DataFrame, want: DataFrame) -> DataFrame:
    """Compare two feature indexes by name: one row per name with its status."""
    left = have.select("feature_name", F.col("feature_idx").alias("input_idx"))
    right = want.select("feature_name", F.col("feature_idx").alias("wanted_idx"))
    status = (
        F.when(F.col("input_idx").isNull(), "missing")
        .when(F.col("wanted_idx").isNull(), "extra")
        .otherwise("matched")
    )
    return left.join(right, "feature_name", "full_outer").withColumn("status", status)
