"""How each scaling changes the features: statistics and their histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from broadloom.operators.scalers import KINDS, compare, scaled_stats
from broadloom.operators.stats import histogram
from broadloom.session import materialize
from broadloom.sources.sinks import write_histograms

# Fixed value: bins of the per-feature statistics.
BINS = 300


def stat_histograms(stats: DataFrame, bins: int = BINS) -> DataFrame:
    """``scaler, stat, bin, bin_start, bin_end, count``."""
    return histogram(stats, "value", bins, ["scaler", "stat"])


def scaling_histograms(
    matrix: DataFrame, kinds: Sequence[str] = KINDS, bins: int = BINS, **options
) -> DataFrame:
    """Histograms over the features of range, mean and deviation after each scaling.

    The statistics, a few rows per feature, are stored before they are binned: the
    matrix is read for them only.
    """
    stats = materialize(scaled_stats(matrix, kinds, **options), "scaled-stats")
    return stat_histograms(stats, bins)


def analyse_scaling(
    matrix: DataFrame, output: str, kinds: Sequence[str] = KINDS, bins: int = BINS, **options
) -> DataFrame:
    """Write the histograms; returns the status table ``scaler, error``."""
    stats, status = compare(matrix, kinds, **options)
    write_histograms(stat_histograms(stats, bins), output)
    return status
