"""Analytics on the table of tuning trials (one row per trained configuration)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadloom.functions.numeric import finite_or_null
from broadloom.functions.text import parse_int_list
from broadloom.operators.quantiles import median

# The search grid.
ENCODING_DIMS = (64, 128, 256, 1024, 2048)
LAYER_CONFIGS = (
    (4096,),
    (4096, 1024),
    (4096, 2048, 1024),
    (4096, 2048, 1024, 512),
    (4096, 2048, 1024, 512, 256),
)

# Settings of a run that did not record them.
DEFAULT_SETTINGS = {"learning_rate": 0.001, "batch_size": 16, "dropout_rate": 0.2}

TRIAL_SCHEMA = (
    "trial_id int, encoding_dim int, num_layers int, layer_config array<int>, "
    "total_params bigint, mse double, rmse double, mae double, r2_score double, "
    "range_mse double, mean_per_feature_range_mse double, "
    "median_per_feature_range_mse double, baseline_mse double, improvement_ratio double, "
    "final_train_loss double, final_val_loss double, best_epoch int, best_val_loss double, "
    "total_epochs int, total_training_time double, avg_epoch_time double, "
    "convergence_speed double, learning_rate double, batch_size int, dropout_rate double"
)

HYPER_PARAMETERS = ("encoding_dim", "num_layers", "learning_rate", "batch_size", "dropout_rate")

# --- grid -----------------------------------------------------------------


def grid(
    spark: SparkSession,
    dims: Sequence[int] = ENCODING_DIMS,
    layers: Sequence[Sequence[int]] = LAYER_CONFIGS,
) -> DataFrame:
    """``trial_id, encoding_dim, num_layers, layer_config``, dims outermost, 1-based."""
    start = spark.range(1).select(
        F.array(*[F.lit(int(d)) for d in dims]).alias("dims"),
        F.array(*[F.array(*[F.lit(int(u)) for u in c]).cast("array<int>") for c in layers]).alias(
            "configs"
        ),
    )
    return grid_of(start)


def grid_of(levels: DataFrame) -> DataFrame:
    """The product of the arrays ``dims`` and ``configs`` of each row."""
    outer = levels.select("*", F.posexplode("dims").alias("i", "encoding_dim"))
    both = outer.select("*", F.posexplode("configs").alias("j", "layer_config"))
    return both.select(
        (F.col("i") * F.size("configs") + F.col("j") + 1).alias("trial_id"),
        "encoding_dim",
        F.size("layer_config").alias("num_layers"),
        "layer_config",
    )


def pick(trials: DataFrame, trial_id: int = 1) -> DataFrame:
    return trials.filter(F.col("trial_id") == trial_id)


def param_count(layer_config: Column, encoding_dim: Column, n_features: Column) -> Column:
    """Weights of the mirrored autoencoder: dense layers plus four per normalised unit."""
    units = F.concat(
        layer_config, F.array(encoding_dim.cast("int")), F.reverse(layer_config)
    ).cast("array<bigint>")
    start = F.struct(
        F.lit(0).cast("bigint").alias("total"), n_features.cast("bigint").alias("width")
    )
    step = lambda acc, u: F.struct(
        (acc["total"] + acc["width"] * u + u * 5).alias("total"), u.alias("width")
    )
    # 5u: a bias and four normalisation values per unit; the output has a bias only.
    return F.aggregate(
        units,
        start,
        step,
        lambda acc: acc["total"] + (acc["width"] + 1) * n_features.cast("bigint"),
    )


# --- preparation ----------------------------------------------------------


def prepare(trials: DataFrame) -> DataFrame:
    """Parse the layer list where it is text and add ``deepest_layer``."""
    if "layer_config" not in trials.columns:
        return trials
    if dict(trials.dtypes)["layer_config"] == "string":
        trials = trials.withColumn("layer_config", parse_int_list(F.col("layer_config")))
    return trials.withColumn("deepest_layer", deepest_layer())


def deepest_layer() -> Column:
    return F.coalesce(F.array_min("layer_config"), F.lit(0))


def with_defaults(trials: DataFrame) -> DataFrame:
    """Add the settings a run did not record."""
    for name, value in DEFAULT_SETTINGS.items():
        if name not in trials.columns:
            trials = trials.withColumn(name, F.lit(value))
    return trials


def combine(refined: DataFrame, original: DataFrame | None) -> DataFrame:
    """Both runs in one table, tagged by ``source``; without an original only one."""
    tagged = refined.withColumn("source", F.lit("refined"))
    if original is None:
        return tagged
    first = with_defaults(original).withColumn("source", F.lit("original"))
    return first.unionByName(tagged, allowMissingColumns=True)


def model_size() -> Column:
    return F.col("encoding_dim") * F.col("num_layers")


def select_config(trials: DataFrame, encoding_dim: int, layers: Sequence[int]) -> DataFrame:
    config = F.array(*[F.lit(int(u)) for u in layers])
    return trials.filter((F.col("encoding_dim") == encoding_dim) & (F.col("layer_config") == config))


def acceptable(trials: DataFrame, max_dim: int, min_r2: float) -> DataFrame:
    """Compressed enough and good enough, smallest first."""
    kept = trials.filter((F.col("encoding_dim") <= max_dim) & (F.col("r2_score") > min_r2))
    return kept.orderBy("encoding_dim", "trial_id")


# --- best rows ------------------------------------------------------------


def _rank_key(metric: str, largest: bool) -> Column:
    value = finite_or_null(F.col(metric).cast("double"))
    signed = -value if largest else value
    return F.when(signed.isNotNull(), F.struct(signed.alias("m"), F.col("trial_id")))


def best(
    trials: DataFrame, metric: str, *, largest: bool = False, by: Sequence[str] = ()
) -> DataFrame:
    """The row with the best value; the lowest trial_id wins ties, NaN never wins."""
    row = F.struct(*[F.col(c) for c in trials.columns])
    found = trials.groupBy(*by).agg(
        F.min_by(row, _rank_key(metric, largest)).alias("row")
    ).filter("row is not null")
    return found.select("row.*")


CRITERIA = (
    ("best_mse", "mse", False),
    ("best_r2", "r2_score", True),
    ("best_improvement", "improvement_ratio", True),
    ("fastest_convergence", "convergence_speed", False),
)


def best_by_each(trials: DataFrame) -> DataFrame:
    """One row per criterion, all found in a single pass: ``criterion, <trial>...``."""
    row = F.struct(*[F.col(c) for c in trials.columns])
    winners = trials.agg(
        *[F.min_by(row, _rank_key(m, big)).alias(name) for name, m, big in CRITERIA]
    )
    listed = F.inline(
        F.array(*[F.struct(F.lit(n).alias("criterion"), F.col(n).alias("row")) for n, _, _ in CRITERIA])
    )
    return winners.select(listed).filter("row is not null").select("criterion", "row.*")


def top_per_source(trials: DataFrame, n: int = 5, metric: str = "mse") -> DataFrame:
    """The ``n`` lowest rows of each source; every task keeps at most n per source."""
    order = Window.partitionBy("source").orderBy(F.col(metric), F.col("trial_id"))
    ranked = trials.filter(finite_or_null(F.col(metric)).isNotNull()).withColumn(
        "rank", F.row_number().over(order)
    )
    return ranked.filter(F.col("rank") <= n)


def top(trials: DataFrame, n: int, max_dim: int | None = None) -> DataFrame:
    """The ``n`` best by r2, optionally among small encodings."""
    kept = trials if max_dim is None else trials.filter(F.col("encoding_dim") <= max_dim)
    return kept.orderBy(F.desc_nulls_last(finite_or_null(F.col("r2_score"))), "trial_id").limit(n)


def ranked(trials: DataFrame) -> DataFrame:
    return trials.orderBy(F.desc_nulls_last(finite_or_null(F.col("r2_score"))), "trial_id")


def below_medians(trials: DataFrame) -> DataFrame:
    """Trials strictly below the median error and the median training time."""
    middle_mse = median(trials, "mse").scalar()
    middle_time = median(trials, "total_training_time").scalar()
    return trials.filter(
        (finite_or_null(F.col("mse")) < middle_mse) & (F.col("total_training_time") < middle_time)
    )


def balanced(trials: DataFrame) -> DataFrame:
    return best(below_medians(trials), "mse")


def fastest_usable(trials: DataFrame, tolerance: float = 1.1) -> DataFrame:
    """Shortest training among trials with at most 10 % more than the median error."""
    limit = median(trials, "mse").scalar() * F.lit(tolerance)
    return best(trials.filter(finite_or_null(F.col("mse")) < limit), "total_training_time")


def consensus(trials: DataFrame, on: Sequence[str] = ("encoding_dim", "num_layers")) -> DataFrame:
    """Whether the lowest error and the highest r2 are the same configuration."""
    row = F.struct("trial_id", *on)
    pair = trials.agg(
        F.min_by(row, _rank_key("mse", False)).alias("a"),
        F.min_by(row, _rank_key("r2_score", True)).alias("b"),
    )
    same = F.lit(True)
    for c in on:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return pair.select(
        F.col("a.trial_id").alias("best_mse_trial"),
        F.col("b.trial_id").alias("best_r2_trial"),
        same.alias("same_config"),
    )


# --- summaries ------------------------------------------------------------


def overall(trials: DataFrame) -> DataFrame:
    """Count and ranges of the main metrics."""
    aggregates = [F.count("*").alias("models")]
    for metric, short in (("mse", "mse"), ("r2_score", "r2"), ("improvement_ratio", "improvement")):
        value = finite_or_null(F.col(metric))
        aggregates += [F.min(value).alias(f"{short}_min"), F.max(value).alias(f"{short}_max")]
    return trials.agg(*aggregates)


def group_summary(
    trials: DataFrame, parameters: Sequence[str] = HYPER_PARAMETERS
) -> DataFrame:
    """``parameter, level, count, avg_mse, avg_r2, best_mse`` for every level of each
    hyper-parameter, in one grouping-sets pass."""
    present = [p for p in parameters if p in trials.columns]
    grouped = trials.groupingSets([[F.col(p)] for p in present], *[F.col(p) for p in present]).agg(
        F.grouping_id().alias("gid"),
        F.count("*").alias("count"),
        F.avg(finite_or_null(F.col("mse"))).alias("avg_mse"),
        F.avg(finite_or_null(F.col("r2_score"))).alias("avg_r2"),
        F.min(finite_or_null(F.col("mse"))).alias("best_mse"),
    )
    # In the grouping id the bit of the kept column is 0 and all others are 1.
    full = (1 << len(present)) - 1
    parameter = F.lit(None).cast("string")
    level = F.lit(None).cast("double")
    for i, p in enumerate(present):
        mine = F.col("gid") == (full ^ (1 << (len(present) - 1 - i)))
        parameter = F.when(mine, F.lit(p)).otherwise(parameter)
        level = F.when(mine, F.col(p).cast("double")).otherwise(level)
    return grouped.select(
        parameter.alias("parameter"), level.alias("level"), "count", "avg_mse", "avg_r2", "best_mse"
    ).filter("level is not null")


def level_impact(trials: DataFrame, parameters: Sequence[str] = HYPER_PARAMETERS) -> DataFrame:
    """Best and worst level of each hyper-parameter by mean error.

    A level without a finite mean ranks last: never the best while another one has a mean.
    """
    levels = group_summary(trials, parameters)
    rank = F.struct(F.col("avg_mse").isNull(), "avg_mse", "level")
    return levels.groupBy("parameter").agg(
        F.min_by("level", rank).alias("best_level"), F.max_by("level", rank).alias("worst_level")
    )


def pivot(
    trials: DataFrame, dims: Sequence[int], metric: str = "mse"
) -> DataFrame:
    """Mean metric by layer count (rows) and encoding dimension (columns)."""
    return trials.groupBy("num_layers").pivot("encoding_dim", list(dims)).agg(
        F.avg(finite_or_null(F.col(metric)))
    )


def time_correlations(trials: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Does the training time follow the depth or the encoding dimension?"""
    def with_time(parameter: str) -> Column:
        # A parameter with a single level has no correlation rather than an error.
        time, level = F.col("total_training_time"), F.col(parameter).cast("double")
        both = time.isNotNull() & level.isNotNull()
        time, level = F.when(both, time), F.when(both, level)
        return F.try_divide(
            F.covar_pop(time, level), F.stddev_pop(time) * F.stddev_pop(level)
        )

    return trials.agg(
        with_time("num_layers").alias("corr_layers"), with_time("encoding_dim").alias("corr_dim")
    ).select(
        "corr_layers",
        "corr_dim",
        F.coalesce(F.col("corr_layers") > threshold, F.lit(False)).alias("grows_with_layers"),
        F.coalesce(F.col("corr_dim") > threshold, F.lit(False)).alias("grows_with_dim"),
    )


def levels(trials: DataFrame, parameter: str) -> DataFrame:
    return trials.select(F.col(parameter).alias("level")).distinct().orderBy("level")


def compare_runs(combined: DataFrame) -> DataFrame:
    """Best error of both runs and the relative gain; no row without an original."""
    mse = finite_or_null(F.col("mse"))
    pair = combined.agg(
        F.min(F.when(F.col("source") == "original", mse)).alias("original_mse"),
        F.min(F.when(F.col("source") == "refined", mse)).alias("refined_mse"),
    ).filter("original_mse is not null")
    gain = F.try_divide(F.col("original_mse") - F.col("refined_mse"), F.col("original_mse")) * 100
    return pair.withColumn("improvement_pct", gain).withColumn(
        "improved", F.coalesce(F.col("improvement_pct") > 0, F.lit(False))
    )
