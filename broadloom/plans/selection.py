"""All analyses of a finished tuning run, as DataFrames by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from broadloom.operators import report, stats, trials
from broadloom.sources.tables import TableNotFound, read_trials

# Fixed value: the configuration whose learning-rate curve is drawn.
CURVE_CONFIG = (2048, (4096,))


def _dims(table: DataFrame) -> list[int]:
    """The encoding dimensions in use: hyper-parameter levels, a handful."""
    return [r["level"] for r in trials.levels(table, "encoding_dim").collect()]


def analyse(spark: SparkSession, trials_path: str) -> dict[str, DataFrame]:
    """Summary, plot data and recommendations of one run."""
    table = trials.prepare(read_trials(spark, trials_path))
    by = ["encoding_dim", "num_layers"]
    return {
        "summary": report.tuning_summary(table),
        "mse_boxes": stats.box_stats(table, "mse", by),
        "r2_boxes": stats.box_stats(table, "r2_score", by),
        "time_by_complexity": report.time_by_complexity(table),
        "error_by_convergence": report.error_by_convergence(table),
        "mse_pivot": trials.pivot(table, _dims(table)),
        "improvement": stats.mean_interval(table, "improvement_ratio", by, "trial_id"),
        "recommendations": report.recommendations(table),
    }


def analyse_refined(
    spark: SparkSession, refined_path: str, original_path: str | None = None
) -> dict[str, DataFrame]:
    """The same for a refined run, compared with the original run where there is one."""
    table = trials.prepare(read_trials(spark, refined_path))
    original = None
    if original_path is not None:
        try:
            original = trials.prepare(read_trials(spark, original_path))
        except TableNotFound:
            original = None
    combined = trials.combine(table, original)
    by = ["encoding_dim", "num_layers"]
    curve = trials.select_config(table, *CURVE_CONFIG)
    result = {
        "summary": report.tuning_summary(table, refined=True),
        "mse_boxes": stats.box_stats(table, "mse", by),
        "mse_by_learning_rate": stats.box_stats(table, "mse", ["learning_rate"]),
        "mse_by_batch_size": stats.box_stats(table, "mse", ["batch_size"]),
        "mse_by_dropout_rate": stats.box_stats(table, "mse", ["dropout_rate"]),
        "mse_pivot": trials.pivot(table, _dims(table)),
        "learning_rate_curve": stats.mean_interval(
            curve, "mse", ["learning_rate", "batch_size", "dropout_rate"], "trial_id"
        ),
        "recommendations": report.recommendations(
            table, combined if original is not None else None, refined=True
        ),
    }
    if original is not None:
        result["mse_by_source"] = stats.box_stats(combined, "mse", ["source"])
        result["top_models"] = trials.top_per_source(combined)
    return result
