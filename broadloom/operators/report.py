"""Reports as long tables: ``section, key, metric, value, text``.

The text column carries the number formatted the way a reader expects it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadloom.functions.text import fixed, grouped, percent, show_int_list
from broadloom.operators import trials as t

REPORT_SCHEMA = "section string, key string, metric string, value double, text string"

SIX, SHARE, COUNT, PLAIN, SECONDS = "six", "share", "count", "plain", "seconds"


def _text(value: Column, style: str) -> Column:
    return {
        SIX: lambda: fixed(value.cast("double"), 6),
        SHARE: lambda: percent(value.cast("double")),
        COUNT: lambda: grouped(value),
        PLAIN: lambda: value.cast("string"),
        SECONDS: lambda: F.concat(fixed(value.cast("double"), 2), F.lit(" seconds")),
    }[style]()


def entries(
    df: DataFrame, section: Column | str, key: Column, items: Sequence[tuple[str, str, str]]
) -> DataFrame:
    """Unpivot ``items (metric, column, style)`` of each row into report rows."""
    section = F.lit(section) if isinstance(section, str) else section
    rows = []
    for metric, column, style in items:
        value = F.col(column)
        if style == "list":
            number, text = F.lit(None).cast("double"), show_int_list(value)
        elif style == "text":
            number, text = F.lit(None).cast("double"), value.cast("string")
        else:
            number, text = value.cast("double"), _text(value, style)
        rows.append(
            F.struct(
                F.lit(metric).alias("metric"), number.alias("value"), text.alias("text")
            )
        )
    return df.select(section.alias("section"), key.cast("string").alias("key"), F.inline(F.array(*rows)))


# The metrics of a model summary, by section, with their formats.
MODEL_SUMMARY = (
    ("model_configuration", (
        ("encoding_dim", "encoding_dim", PLAIN),
        ("layer_config", "layer_config", "list"),
        ("total_params", "total_params", COUNT),
    )),
    ("performance", (
        ("mse", "mse", SIX),
        ("rmse", "rmse", SIX),
        ("mae", "mae", SIX),
        ("r2_score", "r2_score", SIX),
        ("range_mse", "range_mse", SIX),
        ("mean_per_feature_range_mse", "mean_per_feature_range_mse", SIX),
        ("median_per_feature_range_mse", "median_per_feature_range_mse", SIX),
        ("baseline_mse", "baseline_mse", SIX),
        ("improvement_ratio", "improvement_ratio", SHARE),
    )),
    ("training", (
        ("final_train_loss", "final_train_loss", SIX),
        ("final_val_loss", "final_val_loss", SIX),
        ("best_epoch", "best_epoch", PLAIN),
        ("total_epochs", "total_epochs", PLAIN),
        ("best_val_loss", "best_val_loss", SIX),
    )),
    ("timing", (
        ("total_training_time", "total_training_time", SECONDS),
        ("avg_epoch_time", "avg_epoch_time", SECONDS),
        ("convergence_speed", "convergence_speed", SHARE),
    )),
)


def model_summary(trials: DataFrame) -> DataFrame:
    """The full summary of every trial."""
    flat = [(section, item) for section, items in MODEL_SUMMARY for item in items]
    # One unpivot for all sections: the section rides along with its metric.
    rows = []
    for section, (metric, column, style) in flat:
        value = F.col(column)
        if style == "list":
            number, text = F.lit(None).cast("double"), show_int_list(value)
        else:
            number, text = value.cast("double"), _text(value, style)
        rows.append(
            F.struct(
                F.lit(section).alias("section"), F.lit(metric).alias("metric"),
                number.alias("value"), text.alias("text"),
            )
        )
    return trials.select(
        F.col("trial_id").cast("string").alias("key"), F.inline(F.array(*rows))
    ).select("section", "key", "metric", "value", "text")


_SETTINGS = (
    ("learning_rate", "learning_rate", PLAIN),
    ("batch_size", "batch_size", PLAIN),
    ("dropout_rate", "dropout_rate", PLAIN),
)


def _row_items(refined: bool, *tail: tuple[str, str, str]) -> list[tuple[str, str, str]]:
    head = [("encoding_dim", "encoding_dim", PLAIN), ("layer_config", "layer_config", "list")]
    return [*head, *(_SETTINGS if refined else ()), *tail]


def tuning_summary(trials: DataFrame, *, refined: bool = False) -> DataFrame:
    """Overall statistics, best trials and the analysis by hyper-parameter."""
    overall = entries(
        t.overall(trials),
        "overall",
        F.lit("all"),
        [
            ("models", "models", PLAIN),
            ("mse_min", "mse_min", SIX), ("mse_max", "mse_max", SIX),
            ("r2_min", "r2_min", SIX), ("r2_max", "r2_max", SIX),
            ("improvement_min", "improvement_min", SHARE),
            ("improvement_max", "improvement_max", SHARE),
        ],
    )
    winners = t.best_by_each(trials)
    if refined:
        winners = winners.filter("criterion != 'best_improvement'")
    quality = [("mse", "mse", SIX), ("r2", "r2_score", SIX), ("improvement", "improvement_ratio", SHARE)]
    speed = [
        ("best_epoch", "best_epoch", PLAIN), ("total_epochs", "total_epochs", PLAIN),
        ("mse", "mse", SIX), ("training_time", "total_training_time", SECONDS),
    ]
    fastest = F.col("criterion") == "fastest_convergence"
    best = entries(winners.filter(~fastest), F.col("criterion"), F.col("trial_id"), _row_items(refined, *quality))
    quick = entries(winners.filter(fastest), F.col("criterion"), F.col("trial_id"), _row_items(refined, *speed))
    parameters = t.HYPER_PARAMETERS if refined else ("encoding_dim", "num_layers")
    by_level = entries(
        t.group_summary(trials, parameters),
        F.concat(F.lit("by_"), F.col("parameter")),
        F.col("level"),
        [
            ("count", "count", PLAIN), ("avg_mse", "avg_mse", SIX),
            ("avg_r2", "avg_r2", SIX), ("best_mse", "best_mse", SIX),
        ],
    )
    return overall.unionByName(best).unionByName(quick).unionByName(by_level)


def recommendations(
    trials: DataFrame, combined: DataFrame | None = None, *, refined: bool = False
) -> DataFrame:
    """Which configuration to use: overall, balanced, fast, and what drives the error.

    A section without a candidate has one row saying so.
    """
    on = ("encoding_dim", "layer_config") if refined else ("encoding_dim", "num_layers")
    same = F.when(F.col("same_config"), "optimal for both mse and r2").otherwise("lowest mse")
    verdict = entries(
        t.consensus(trials, on).withColumn("verdict", same),
        "overall", F.col("best_mse_trial"), [("verdict", "verdict", "text")],
    )
    mse, time = ("mse", "mse", SIX), ("training_time", "total_training_time", SECONDS)
    r2 = ("r2", "r2_score", SIX)
    parts = [
        entries(t.best(trials, "mse"), "overall", F.col("trial_id"), _row_items(refined, mse, r2)),
        verdict,
        _or_none(t.balanced(trials), "balanced", _row_items(refined, mse, time)),
        _or_none(t.fastest_usable(trials), "fastest_usable", _row_items(refined, mse, time)),
    ]
    parameters = t.HYPER_PARAMETERS if refined else ("encoding_dim", "num_layers")
    parts.append(
        entries(
            t.level_impact(trials, parameters), "impact", F.col("parameter"),
            [("best_level", "best_level", PLAIN), ("worst_level", "worst_level", PLAIN)],
        )
    )
    if not refined:
        parts.append(
            entries(
                t.time_correlations(trials), "training_time", F.lit("all"),
                [("grows_with_layers", "grows_with_layers", "text"),
                 ("grows_with_dim", "grows_with_dim", "text")],
            )
        )
    if combined is not None:
        gain = F.when(F.col("improved"), F.concat(fixed(F.col("improvement_pct"), 2), F.lit("%")))
        runs = t.compare_runs(combined).withColumn(
            "gain", F.coalesce(gain, F.lit("no improvement"))
        )
        parts.append(
            entries(
                runs, "comparison", F.lit("runs"),
                [("original_mse", "original_mse", SIX), ("refined_mse", "refined_mse", SIX),
                 ("improvement", "gain", "text")],
            )
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _or_none(rows: DataFrame, section: str, items: list[tuple[str, str, str]]) -> DataFrame:
    listed = entries(rows, section, F.col("trial_id"), items)
    empty = rows.agg(F.count("*").alias("n")).filter("n = 0").select(
        F.lit(section).alias("section"),
        F.lit(None).cast("string").alias("key"),
        F.lit("none").alias("metric"),
        F.lit(None).cast("double").alias("value"),
        F.lit("no configuration found").alias("text"),
    )
    return listed.unionByName(empty)


# --- data behind the plots ------------------------------------------------


def time_by_complexity(trials: DataFrame) -> DataFrame:
    return trials.select("total_params", "total_training_time", "encoding_dim", "num_layers")


def error_by_convergence(trials: DataFrame) -> DataFrame:
    return trials.select("convergence_speed", "mse", "encoding_dim", "num_layers")


def loss_series(history: DataFrame) -> DataFrame:
    return history.select("trial_id", "epoch", "loss", "val_loss")


def epoch_time_series(history: DataFrame) -> DataFrame:
    return history.select("trial_id", "epoch", "epoch_seconds")
