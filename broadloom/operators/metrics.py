"""Reconstruction metrics on ``(features, pred)`` arrays, optionally per trial.

One scan gives everything: the cells are grouped by trial and feature, then the
short per-feature table is reduced per trial.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadloom.operators.quantiles import quantiles
from broadloom.session import materialize

# Fixed value: keeps the range-normalised error finite on constant features.
RANGE_EPSILON = 1e-8


def paired_cells(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., feature_idx, x, p``: both arrays exploded together."""
    pairs = F.arrays_zip(F.col("features").alias("x"), F.col("pred").alias("p"))
    exploded = df.select(*by, F.posexplode(pairs).alias("feature_idx", "cell"))
    return exploded.select(*by, "feature_idx", F.col("cell.x").alias("x"), F.col("cell.p").alias("p"))


def per_feature(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Errors, spread and range of each feature.

    ``by..., feature_idx, n, sse, sae, range, baseline, mse, range_mse, r2``.
    """
    gap = F.col("x") - F.col("p")
    grouped = paired_cells(df, by).groupBy(*by, "feature_idx").agg(
        F.count("x").alias("n"),
        F.sum(gap * gap).alias("sse"),
        F.sum(F.abs(gap)).alias("sae"),
        (F.max("x") - F.min("x")).alias("range"),
        F.var_pop("x").alias("baseline"),
    )
    return with_scores(grouped)


def with_scores(sums: DataFrame) -> DataFrame:
    """Add ``mse, range_mse, r2`` to rows of ``n, sse, sae, range, baseline``."""
    total = F.col("baseline") * F.col("n")
    perfect = F.when(F.col("sse") == 0, 1.0).otherwise(0.0)
    return (
        sums.withColumn("mse", F.try_divide("sse", "n"))
        .withColumn(
            "range_mse", F.col("mse") / (F.col("range") * F.col("range") + RANGE_EPSILON)
        )
        .withColumn("r2", F.when(total == 0, perfect).otherwise(1 - F.col("sse") / total))
    )


def summary(
    features: DataFrame, by: Sequence[str] = (), *, max_features: int | None = None
) -> DataFrame:
    """Metrics over all cells, from the table of ``per_feature``, which is stored first
    so that the cells are read once.

    The mean range error is the same number as the range error over all cells,
    because every feature has the same number of rows; both names are kept.
    """
    features = materialize(features, "per-feature")
    cells = F.sum("n")
    totals = features.groupBy(*by).agg(
        F.try_divide(F.sum("sse"), cells).alias("mse"),
        F.try_divide(F.sum("sae"), cells).alias("mae"),
        F.avg("r2").alias("r2_score"),
        F.try_divide(F.sum(F.col("range_mse") * F.col("n")), cells).alias("range_mse"),
        F.avg("range_mse").alias("mean_per_feature_range_mse"),
        F.try_divide(F.sum(F.col("baseline") * F.col("n")), cells).alias("baseline_mse"),
    )
    middle = quantiles(features, "range_mse", [0.5], by, max_group=max_features).select(
        *by, F.get("q", F.lit(0)).alias("median_per_feature_range_mse")
    )
    if by:
        joined = totals.join(middle, list(by))
    else:
        joined = totals.withColumn("median_per_feature_range_mse", middle.scalar())
    return joined.select(
        *by,
        "mse",
        F.sqrt("mse").alias("rmse"),
        "mae",
        "r2_score",
        "range_mse",
        "mean_per_feature_range_mse",
        "median_per_feature_range_mse",
        "baseline_mse",
        (1 - F.try_divide("mse", "baseline_mse")).alias("improvement_ratio"),
    )
