"""Writing trials, histograms, encoded features and reports."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadloom.operators.compat import edges
from broadloom.operators.matrix import name_columns
from broadloom.operators.report import model_summary
from broadloom.session import list_files, path_exists, remove_path, rename_path

# Fixed value: name of the encoded output when none is given.
DEFAULT_OUTPUT = "encoded_output.csv"


def append_trials(trials: DataFrame, path: str, job: str | None = None) -> bool:
    """Create the trial table or add to it; a job commits all its rows or none.

    With the name of a ``job`` its rows, which are few, become one file that bears the name, put in
    place by a single rename: what a job has committed is not added again when it is repeated,
    and jobs that end together all land. Returns whether the rows were added.
    """
    if job is None:
        trials.write.mode("append").parquet(path)
        return True
    spark = trials.sparkSession
    name = f"{path.rstrip('/')}/job-{hashlib.sha256(job.encode()).hexdigest()[:32]}.parquet"
    if path_exists(spark, name):
        return False
    # Names that begin with an underscore are no data for readers of the table.
    staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    trials.coalesce(1).write.parquet(staged)
    added = rename_path(spark, next(iter(list_files(spark, staged, ".parquet"))), name)
    remove_path(spark, staged)
    return added


def write_histograms(histograms: DataFrame, path: str) -> None:
    """``bin, bin_start, bin_end, count`` in one folder per scaler and statistic."""
    histograms.write.mode("overwrite").partitionBy("scaler", "stat").parquet(path)


def write_encoded(
    encoded: DataFrame, path: str = DEFAULT_OUTPUT, *, width: int | None = None, column: str = "encoded"
) -> None:
    """Overwrite the encoded output: CSV or Parquet by the ending of the path.

    With ``width`` the array is spread over ``encoded_0 ...``, however many. Without it a CSV
    gets the array as one text field; Parquet keeps it as an array.
    """
    as_csv = path.rstrip("/").lower().endswith(".csv")
    if width is not None:
        encoded = name_columns(encoded, column, width)
    elif as_csv:
        encoded = encoded.withColumn(column, F.to_json(column))
    writer = encoded.write.mode("overwrite")
    if as_csv:
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def write_model_summary(trials: DataFrame, path: str) -> None:
    model_summary(trials).write.mode("overwrite").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").parquet(path)


def write_schema_profile(index: DataFrame, path: str) -> None:
    """The column list of a table and, apart, its first and last entries."""
    index.write.mode("overwrite").parquet(f"{path}/columns")
    edges(index).write.mode("overwrite").parquet(f"{path}/edges")
