"""Scale once, train a grid, record one row per trial."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadloom.operators import matrix as m
from broadloom.operators import scalers, trials
from broadloom.operators.stats import histogram
from broadloom.operators.matrix import width_of
from broadloom.operators.network import MAX_PARAMS
from broadloom.operators.training import Config, Fitted, evaluate, fit_grid, trial_errors
from broadloom.operators.wide_training import WideFitted, fit_wide
from broadloom.session import materialize
from broadloom.sources.sinks import append_trials

# Fixed value: bins of the per-feature error histograms.
ERROR_BINS = 200


def grid_configs(
    dims: Sequence[int] = trials.ENCODING_DIMS,
    layers: Sequence[Sequence[int]] = trials.LAYER_CONFIGS,
    **settings: float,
) -> list[Config]:
    """All configurations, encoding dimension outermost, numbered from 1."""
    pairs = [(d, tuple(c)) for d in dims for c in layers]
    return [Config(i + 1, d, c, **settings) for i, (d, c) in enumerate(pairs)]


def scale_for_training(
    matrix: DataFrame, kind: str, *, null_policy: str = "zero"
) -> tuple[DataFrame, DataFrame]:
    """``(scaled matrix, stored parameters)``; the scaler sees all rows."""
    prepared = m.as_float64(m.as_float32(m.fill_nulls(matrix, null_policy)))
    params = materialize(scalers.fit(prepared, kind), "params")
    return scalers.transform(prepared, params, kind), params


def fit(
    scaled: DataFrame, configs: Sequence[Config], *, max_params: int = MAX_PARAMS, **training
) -> Fitted | WideFitted:
    """Train the grid: together in every worker up to ``max_params`` weights, else in feature blocks."""
    n_features = width_of(scaled)
    if sum(c.params(n_features) for c in configs) <= max_params:
        return fit_grid(scaled, configs, max_params=max_params, **training)
    return fit_wide(scaled, configs, **training)


def tune(
    matrix: DataFrame,
    kind: str,
    configs: Sequence[Config],
    trials_path: str,
    *,
    metrics_on: str = "all",
    job: str | None = None,
    **training,
) -> tuple[Fitted | WideFitted, DataFrame]:
    """Train the grid and append its trial rows; returns the models and the scaler.

    With a name for the ``job`` its rows are appended once, however often it is repeated.
    """
    scaled, params = scale_for_training(matrix, kind)
    # Scaled rows are read by every epoch's evaluation: written once.
    scaled = materialize(scaled, "scaled")
    fitted = fit(scaled, configs, **training)
    append_trials(evaluate(scaled, fitted, metrics_on=metrics_on), trials_path, job)
    return fitted, params


def error_histograms(scaled: DataFrame, fitted: Fitted, bins: int = ERROR_BINS) -> DataFrame:
    """Histograms of the per-feature errors of every trial."""
    return error_histograms_of(trial_errors(scaled, fitted.models()), bins)


def error_histograms_of(per_feature: DataFrame, bins: int = ERROR_BINS) -> DataFrame:
    """``trial_id, stat, bin, bin_start, bin_end, count`` from per-feature metrics."""
    tidy = F.inline(
        F.array(
            *[
                F.struct(F.lit(s).alias("stat"), F.col(s).alias("value"))
                for s in ("mse", "range_mse")
            ]
        )
    )
    stored = materialize(per_feature.select("trial_id", tidy), "errors")
    return histogram(stored, "value", bins, ["trial_id", "stat"])
