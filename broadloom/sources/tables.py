"""Reading feature tables and trial tables."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadloom.operators.matrix import METADATA, present_metadata
from broadloom.operators.trials import TRIAL_SCHEMA, prepare


class TableNotFound(FileNotFoundError):
    """A required input table does not exist."""


def _is_csv(path: str) -> bool:
    return path.rstrip("/").lower().endswith((".csv", ".csv.gz"))


def _missing(failure: AnalysisException) -> bool:
    return failure.getCondition() == "PATH_NOT_FOUND"


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """A columnar table: CSV with a header, or Parquet.

    Without a schema the CSV types are inferred from all rows. For more than a few
    thousand columns use ``read_feature_csv``.
    """
    try:
        if not _is_csv(path):
            return spark.read.parquet(path)
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        return reader.csv(path)
    except AnalysisException as failure:
        if _missing(failure):
            raise TableNotFound(path) from failure
        raise


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names only: one line of a CSV, the footer of a Parquet file."""
    if not _is_csv(path):
        return spark.read.parquet(path).columns
    first = spark.read.text(path).first()
    return [] if first is None else next(csv.reader([first["value"]]))


def sample_schema(spark: SparkSession, path: str, rows: int = 5) -> T.StructType:
    """Types inferred from the first rows only.

    A column of whole numbers in this prefix is typed as integer even when later
    rows are not; use ``infer_feature_types`` where that matters.
    """
    if not _is_csv(path):
        return spark.read.parquet(path).schema
    lines = [r["value"] for r in spark.read.text(path).limit(rows + 1).collect()]
    sample = spark.sparkContext.parallelize(lines, 1)
    return spark.read.option("header", True).option("inferSchema", True).csv(sample).schema


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only the named columns, in the order of the file."""
    table = read_table(spark, path)
    wanted = set(columns)
    return table.select(*[F.col(f"`{c}`") for c in table.columns if c in wanted])


# --- very wide CSV --------------------------------------------------------


def _fields(line: Column) -> Column:
    """Split one CSV line; the regular expression runs only on lines with quotes."""
    pattern = r'("(?:[^"]++|"")*+"|[^,]*+)(?:,|$)'
    quoted = F.transform(
        F.regexp_extract_all(line, F.lit(pattern), F.lit(1)),
        lambda f: F.when(
            f.startswith('"'), F.regexp_replace(F.regexp_replace(f, '^"|"$', ""), '""', '"')
        ).otherwise(f),
    )
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, ",", -1))


def read_text_matrix(
    spark: SparkSession, path: str, metadata: Sequence[str] = METADATA, keep: Sequence[str] = ()
) -> tuple[DataFrame, list[str]]:
    """A wide CSV as ``keep..., metadata..., cells array<string>`` and the feature names.

    Lines are split into one array, so the plan does not grow with the width.
    Records must not span lines.
    """
    names = read_header(spark, path)
    header = spark.read.text(path).first()["value"]
    carried = [*keep, *[m for m in present_metadata(names, metadata) if m not in keep]]
    skip = set(metadata) | set(keep)
    features = [i for i, n in enumerate(names) if n not in skip]
    parsed = (
        spark.read.text(path)
        .filter((F.col("value") != F.lit(header)) & (F.col("value") != ""))
        .select(_fields(F.col("value")).alias("f"))
    )
    if features == list(range(features[0], features[0] + len(features))):
        cells = F.slice("f", features[0] + 1, len(features))
    else:
        # Positions as one literal: the expression stays small for any width.
        lookup = F.split(F.lit(",".join(map(str, features))), ",").cast("array<int>")
        cells = F.transform(lookup, lambda p: F.get(F.col("f"), p))
    columns = [F.nullif(F.get("f", F.lit(names.index(c))), F.lit("")).alias(c) for c in carried]
    return parsed.select(*columns, cells.alias("cells")), [names[i] for i in features]


def parse_cells(text_matrix: DataFrame) -> DataFrame:
    """``cells`` to ``features``: empty or unreadable cells become null."""
    numbers = F.transform("cells", lambda c: F.trim(c).try_cast("double"))
    others = [F.col(f"`{c}`") for c in text_matrix.columns if c != "cells"]
    return text_matrix.select(*others, numbers.alias("features"))


def infer_feature_types(text_matrix: DataFrame, names: Sequence[str]) -> DataFrame:
    """Feature index of a wide CSV, with types inferred from all rows.

    A feature is ``bigint`` when every cell is a whole number, ``double`` when every
    cell is a number, else ``string``.
    """
    spark = text_matrix.sparkSession
    long = text_matrix.select(F.posexplode("cells").alias("feature_idx", "cell"))
    cell = F.trim("cell")
    filled = cell != ""
    kinds = long.groupBy("feature_idx").agg(
        F.count_if(filled & cell.try_cast("double").isNull()).alias("text"),
        F.count_if(filled & ~cell.rlike(r"^[+-]?\d+$")).alias("not_whole"),
        F.count_if(filled).alias("filled"),
    )
    dtype = (
        F.when((F.col("text") > 0) | (F.col("filled") == 0), "string")
        .when(F.col("not_whole") > 0, "double")
        .otherwise("bigint")
    )
    listed = spark.createDataFrame(list(enumerate(names)), "feature_idx int, feature_name string")
    return listed.join(kinds, "feature_idx", "left").select("feature_idx", "feature_name", dtype.alias("dtype"))


def read_feature_csv(
    spark: SparkSession,
    path: str,
    metadata: Sequence[str] = METADATA,
    *,
    mode: str = "all_non_metadata",
    exclude: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> tuple[DataFrame, list[str]]:
    """A wide CSV as a matrix and its feature names; cells that are empty are null.

    ``float64_only`` needs one extra pass to see which features hold fractions.
    """
    text, names = read_text_matrix(spark, path, metadata, keep)
    kept = [n for n in names if n not in set(exclude)]
    if mode == "float64_only":
        typed = infer_feature_types(text, names).filter("dtype = 'double'")
        doubles = {r["feature_name"] for r in typed.select("feature_name").collect()}
        kept = [n for n in kept if n in doubles]
    matrix = parse_cells(text)
    if kept != names:
        where = {n: i for i, n in enumerate(names)}
        lookup = F.split(F.lit(",".join(str(where[n]) for n in kept)), ",").cast("array<int>")
        chosen = F.transform(lookup, lambda p: F.get(F.col("features"), p))
        matrix = matrix.withColumn("features", chosen)
    return matrix, kept


# --- trials ---------------------------------------------------------------


def read_trials(spark: SparkSession, path: str, *, required: bool = True) -> DataFrame:
    """A trial table, from Parquet or from CSV with the layer list as text.

    An absent table raises, or is empty with the same schema when not required.
    """
    try:
        if _is_csv(path):
            # Columns are matched by name: older runs lack the newer settings.
            found = spark.read.option("header", True).option("inferSchema", True).csv(path)
            return prepare(found).drop("deepest_layer")
        return spark.read.parquet(path)
    except AnalysisException as failure:
        if not _missing(failure):
            raise
        if required:
            raise TableNotFound(f"{path}: run the tuning first") from failure
        return spark.createDataFrame([], TRIAL_SCHEMA)
