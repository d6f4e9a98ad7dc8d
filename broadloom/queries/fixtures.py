"""Inputs of the queries, derived from the given tables, with their SQL twins.

* the matrix: ``embeddings`` as features, ``label`` as metadata;
* trials: the matrix reconstructed from its first k features rounded to L places, all
  others by their mean, for 25 pairs (k, L), with measured errors;
* history: ``events`` grouped to trials and epochs;
* a small network whose first kernel holds the class means of the features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadloom.functions.numeric import floor_round
from broadloom.operators import history as h
from broadloom.operators import matrix as m
from broadloom.operators import metrics, trials
from broadloom.operators.network import LAYERS_SCHEMA
from broadloom.session import materialize

# K and L of the reconstruction trials and the hidden layers they stand for.
TRIAL_K = (4, 8, 16, 32, 64)
TRIAL_L = (1, 2, 3, 4, 5)
HIDDEN = (4096, 2048, 1024, 512, 256)
REFINED_RATES = (0.001, 0.0005, 0.0001)
REFINED_BATCHES = (16, 32)
REFINED_DROPOUTS = (0.1, 0.2, 0.3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Tables derived once per session and input folder.
_DERIVED: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _DERIVED:
        _DERIVED[key] = materialize(make(), name)
    return _DERIVED[key]


def forget_derived() -> None:
    """Make the next query derive its tables again."""
    _DERIVED.clear()


# --- matrix ---------------------------------------------------------------

CELLS = """cells AS (
  SELECT vec_id AS row_id, label, generate_subscripts(embedding, 1) - 1 AS feature_idx,
         CAST(unnest(embedding) AS DOUBLE) AS x
  FROM embeddings)"""


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.col("label").cast("string").alias("Label"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


NULL_CELLS = (
    CELLS
    + """, nulled AS (
  SELECT row_id, label, feature_idx,
         CASE WHEN (row_id * 64 + feature_idx) % 17 = 0 THEN NULL ELSE x END AS x
  FROM cells)"""
)


def matrix_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = F.transform(
        "features",
        lambda x, i: F.when((F.col("row_id") * 64 + i) % 17 != 0, x),
    )
    return matrix(spark, sf_dir).withColumn("features", holes)


CONST_CELLS = (
    CELLS
    + """, with_const AS (
  SELECT row_id, feature_idx, x FROM cells
  UNION ALL SELECT vec_id, len(embedding), 5.0 FROM embeddings)"""
)


def matrix_with_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir).withColumn("features", F.concat("features", F.array(F.lit(5.0))))


# The metadata columns of the lineitem matrix.
LINE_META = ("l_returnflag", "l_linestatus")
LINE_SKIP = ("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")

LINE_CELLS = """line_cells AS (
  SELECT l_returnflag, l_linestatus, 0 AS feature_idx, l_quantity AS x FROM lineitem
  UNION ALL SELECT l_returnflag, l_linestatus, 1, l_extendedprice FROM lineitem
  UNION ALL SELECT l_returnflag, l_linestatus, 2, l_discount FROM lineitem
  UNION ALL SELECT l_returnflag, l_linestatus, 3, l_tax FROM lineitem)"""


def line_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four double features; the integer line number is left out by the type rule."""
    return m.to_matrix(
        table(spark, sf_dir, "lineitem"), LINE_META, mode="float64_only", exclude=LINE_SKIP
    )


# --- reconstruction and trials --------------------------------------------

RECON = (
    CELLS
    + """, means AS (SELECT feature_idx, avg(x) AS mean FROM cells GROUP BY feature_idx),
kk AS (SELECT * FROM (VALUES (0, 4), (1, 8), (2, 16), (3, 32), (4, 64)) v(i, k)),
ll AS (SELECT * FROM (VALUES (1), (2), (3), (4), (5)) v(l)),
recon AS (
  SELECT i * 5 + l AS trial_id, k, l, row_id, feature_idx, x,
         CASE WHEN feature_idx < k THEN floor(x * pow(10.0, l) + 0.5) / pow(10.0, l)
              ELSE mean END AS p
  FROM cells JOIN means USING (feature_idx) CROSS JOIN kk CROSS JOIN ll)"""
)


def reconstructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``trial_id, k, l, row_id, features, pred``: every row under every trial."""
    base = matrix(spark, sf_dir)
    per_feature = m.to_long(base).groupBy("feature_idx").agg(F.avg("value").alias("mean"))
    ordered = F.array_sort(F.collect_list(F.struct("feature_idx", "mean")))
    means = per_feature.agg(ordered.alias("s")).select(F.col("s.mean").alias("means"))
    pairs = F.array(
        *[
            F.struct(F.lit(i * 5 + n).alias("trial_id"), F.lit(k).alias("k"), F.lit(n).alias("l"))
            for i, k in enumerate(TRIAL_K)
            for n in TRIAL_L
        ]
    )
    crossed = base.withColumn("means", means.scalar()).select("*", F.inline(pairs))
    pred = F.transform(
        "features",
        lambda x, i: F.when(
            i < F.col("k"), floor_round(x, F.col("l"))
        ).otherwise(F.get("means", i)),
    )
    return crossed.select("trial_id", "k", "l", "row_id", "features", pred.alias("pred"))


PER_FEATURE = (
    RECON
    + """, pf AS (
  SELECT trial_id, k, l, feature_idx, count(*) AS n, sum((x - p) * (x - p)) AS sse,
         sum(abs(x - p)) AS sae, max(x) - min(x) AS rng, var_pop(x) AS base
  FROM recon GROUP BY trial_id, k, l, feature_idx),
pfm AS (
  SELECT *, sse / n AS f_mse, sse / n / (rng * rng + 1e-8) AS f_range_mse,
         CASE WHEN base * n = 0 THEN CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END
              ELSE 1 - sse / (base * n) END AS f_r2
  FROM pf)"""
)

HISTORY = """raw_history AS (
  SELECT user_id % 25 + 1 AS trial_id, event_id % 10 + 1 AS raw_epoch,
         avg(value) FILTER (WHERE event_id % 7 <> 0) AS loss,
         avg(value) FILTER (WHERE event_id % 7 = 0) AS val_loss, count(*) * 0.01 AS seconds
  FROM events GROUP BY 1, 2),
history AS (
  SELECT CAST(trial_id AS INTEGER) AS trial_id,
         CAST(row_number() OVER (PARTITION BY trial_id ORDER BY raw_epoch) AS INTEGER) AS epoch,
         round(loss, 10) AS loss, round(val_loss, 10) AS val_loss,
         CAST(seconds AS DOUBLE) AS epoch_seconds
  FROM raw_history WHERE loss IS NOT NULL AND val_loss IS NOT NULL)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ten epochs for each of 25 trials, as mean event values."""
    held_out = F.col("event_id") % 7 == 0
    grouped = (
        table(spark, sf_dir, "events")
        .groupBy(
            (F.col("user_id") % 25 + 1).cast("int").alias("trial_id"),
            (F.col("event_id") % 10 + 1).alias("raw_epoch"),
        )
        .agg(
            F.avg(F.when(~held_out, F.col("value"))).alias("loss"),
            F.avg(F.when(held_out, F.col("value"))).alias("val_loss"),
            (F.count("*") * 0.01).alias("epoch_seconds"),
        )
        .filter("loss is not null and val_loss is not null")
    )
    order = Window.partitionBy("trial_id").orderBy("raw_epoch")
    return grouped.select(
        "trial_id",
        F.row_number().over(order).alias("epoch"),
        F.round("loss", 10).alias("loss"),
        F.round("val_loss", 10).alias("val_loss"),
        "epoch_seconds",
    )


CONVERGENCE = (
    HISTORY
    + """, conv AS (
  SELECT trial_id, arg_min(epoch, {'v': val_loss, 'e': epoch}) AS best_epoch,
         min(val_loss) AS best_val_loss, arg_max(loss, epoch) AS final_train_loss,
         arg_max(val_loss, epoch) AS final_val_loss, max(epoch) AS total_epochs,
         sum(epoch_seconds) AS total_training_time, avg(epoch_seconds) AS avg_epoch_time
  FROM history GROUP BY trial_id)"""
)

# Metrics and the places they are rounded to: errors go down to 1e-11.
_METRICS = (
    ("mse", 14),
    ("rmse", 14),
    ("mae", 14),
    ("r2_score", 10),
    ("range_mse", 14),
    ("mean_per_feature_range_mse", 14),
    ("median_per_feature_range_mse", 14),
    ("baseline_mse", 14),
    ("improvement_ratio", 10),
)

TRIALS = (
    PER_FEATURE
    + ", "
    + CONVERGENCE
    + """, scored AS (
  SELECT trial_id, k, l, count(*) AS n_features, sum(sse) / sum(n) AS mse,
         sum(sae) / sum(n) AS mae, avg(f_r2) AS r2_score,
         sum(f_range_mse * n) / sum(n) AS range_mse,
         avg(f_range_mse) AS mean_per_feature_range_mse,
         quantile_cont(f_range_mse, 0.5) AS median_per_feature_range_mse,
         sum(base * n) / sum(n) AS baseline_mse
  FROM pfm GROUP BY trial_id, k, l),
sized AS (
  SELECT *, [4096, 2048, 1024, 512, 256][1:l] AS cfg,
         list_concat(list_concat([4096, 2048, 1024, 512, 256][1:l], [k]),
                     list_reverse([4096, 2048, 1024, 512, 256][1:l])) AS hidden
  FROM scored),
chained AS (
  SELECT *, list_concat(list_concat([n_features], hidden), [n_features]) AS chain FROM sized),
trials AS (
  SELECT CAST(s.trial_id AS INTEGER) AS trial_id, CAST(k AS INTEGER) AS encoding_dim,
         CAST(l AS INTEGER) AS num_layers, cfg AS layer_config,
         CAST(list_sum(list_transform(range(1, len(chain)),
              lambda i: chain[i] * chain[i + 1] + chain[i + 1])) + 4 * list_sum(hidden)
              AS BIGINT) AS total_params,
         round(mse, 14) AS mse, round(sqrt(mse), 14) AS rmse, round(mae, 14) AS mae,
         round(r2_score, 10) AS r2_score, round(range_mse, 14) AS range_mse,
         round(mean_per_feature_range_mse, 14) AS mean_per_feature_range_mse,
         round(median_per_feature_range_mse, 14) AS median_per_feature_range_mse,
         round(baseline_mse, 14) AS baseline_mse,
         round(1 - mse / baseline_mse, 10) AS improvement_ratio,
         final_train_loss, final_val_loss, best_epoch, best_val_loss, total_epochs,
         avg_epoch_time, best_epoch / total_epochs AS convergence_speed
  FROM chained s LEFT JOIN conv c ON s.trial_id = c.trial_id),
timed AS (SELECT *, total_params * 1e-6 AS total_training_time FROM trials)"""
)


def _make_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = metrics.per_feature(reconstructions(spark, sf_dir), ["trial_id", "k", "l"])
    scores = metrics.summary(features, ["trial_id", "k", "l"])
    widths = features.groupBy("trial_id").agg(F.count("*").alias("n_features"))
    configs = F.array(*[F.lit(u) for u in HIDDEN])
    sized = (
        scores.join(widths, "trial_id")
        .withColumn("layer_config", F.slice(configs, F.lit(1), F.col("l")))
        .withColumn(
            "total_params", trials.param_count(F.col("layer_config"), F.col("k"), F.col("n_features"))
        )
    )
    converged = h.convergence(history(spark, sf_dir)).drop("total_training_time")
    return sized.join(converged, "trial_id", "left").select(
        "trial_id",
        F.col("k").alias("encoding_dim"),
        F.col("l").alias("num_layers"),
        "layer_config",
        "total_params",
        *[F.round(c, places).alias(c) for c, places in _METRICS],
        "final_train_loss",
        "final_val_loss",
        "best_epoch",
        "best_val_loss",
        "total_epochs",
        (F.col("total_params") * F.lit(1e-6)).alias("total_training_time"),
        "avg_epoch_time",
        "convergence_speed",
    )


def trial_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 trials of the original run."""
    return _once(spark, sf_dir, "trials", lambda: _make_trials(spark, sf_dir))


REFINED = (
    TRIALS
    + """, refined AS (
  SELECT * REPLACE (round(mse * 0.95, 14) AS mse),
         [0.001, 0.0005, 0.0001][trial_id % 3 + 1]::DOUBLE AS learning_rate,
         [16, 32][trial_id % 2 + 1]::INTEGER AS batch_size,
         [0.1, 0.2, 0.3][trial_id % 3 + 1]::DOUBLE AS dropout_rate
  FROM timed),
combined AS (
  SELECT * FROM (SELECT *, 'refined' AS source FROM refined)
  UNION ALL BY NAME
  SELECT * FROM (SELECT *, 0.001::DOUBLE AS learning_rate, 16::INTEGER AS batch_size,
                        0.2::DOUBLE AS dropout_rate, 'original' AS source FROM timed))"""
)


def _pick(values: tuple, key) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


def refined_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trials with recorded settings and a slightly lower error."""
    key = F.col("trial_id")
    return (
        trial_table(spark, sf_dir)
        .withColumn("mse", F.round(F.col("mse") * 0.95, 14))
        .withColumn("learning_rate", _pick(REFINED_RATES, key))
        .withColumn("batch_size", _pick(REFINED_BATCHES, key))
        .withColumn("dropout_rate", _pick(REFINED_DROPOUTS, key))
    )


def combined_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.combine(refined_table(spark, sf_dir), trial_table(spark, sf_dir))


# --- models ---------------------------------------------------------------

CLASS_MODEL = "class_means"

# Layer 1 maps the features to one unit per label, layer 4 is the bottleneck of 4 units.
CLASS_WEIGHTS = (
    CELLS
    + """, w1 AS (SELECT feature_idx AS i, label AS j, avg(x) * 4 AS w FROM cells GROUP BY 1, 2),
b1 AS (SELECT label AS j, (label % 3) / 10.0 AS b FROM embeddings GROUP BY label),
w2 AS (SELECT l.label AS i, u.j, ((l.label * 7 + u.j * 13) % 11 - 5) / 10.0 AS w
       FROM (SELECT DISTINCT label FROM embeddings) l
       CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3)) v(j)) u),
hidden AS (
  SELECT row_id, j, greatest(sum(x * w) + any_value(b), 0.0) AS a
  FROM cells JOIN w1 ON w1.i = cells.feature_idx JOIN b1 USING (j) GROUP BY row_id, j),
normed AS (
  SELECT row_id, j, (a - 0.05) / sqrt(0.5 + 0.001) * (1 + j / 10.0) + 0.01 AS h FROM hidden),
coded AS (
  SELECT row_id, w2.j, greatest(sum(h * w) + any_value((w2.j % 3) / 10.0), 0.0) AS e
  FROM normed JOIN w2 ON w2.i = normed.j GROUP BY row_id, w2.j)"""
)


def _vector(values: DataFrame, layer: int, part: str) -> DataFrame:
    """``j, w`` rows to one weight row."""
    ordered = F.array_sort(F.collect_list(F.struct("j", F.col("w").cast("double").alias("w"))))
    return values.agg(ordered.alias("s")).select(
        F.lit(CLASS_MODEL).alias("model"),
        F.lit(layer).alias("layer_idx"),
        F.lit(part).alias("part"),
        F.lit(0).alias("row_idx"),
        F.col("s.w").alias("w"),
    )


def _kernel(values: DataFrame, layer: int) -> DataFrame:
    """``i, j, w`` rows to one weight row per input."""
    ordered = F.array_sort(F.collect_list(F.struct("j", F.col("w").cast("double").alias("w"))))
    return values.groupBy("i").agg(ordered.alias("s")).select(
        F.lit(CLASS_MODEL).alias("model"),
        F.lit(layer).alias("layer_idx"),
        F.lit("kernel").alias("part"),
        F.col("i").cast("int").alias("row_idx"),
        F.col("s.w").alias("w"),
    )


def class_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(model_layers, model_weights)`` of a network built from class means."""

    def weights() -> DataFrame:
        base = table(spark, sf_dir, "embeddings").select(
            "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")
        )
        w1 = base.groupBy("i", F.col("label").alias("j")).agg((F.avg("x") * 4).alias("w"))
        labels = table(spark, sf_dir, "embeddings").select(F.col("label").alias("j")).distinct()
        units = F.explode(F.sequence(F.lit(0), F.lit(3)))
        w2 = labels.select(F.col("j").alias("i"), units.alias("j")).withColumn(
            "w", ((F.col("i") * 7 + F.col("j") * 13) % 11 - 5) / 10
        )
        j = F.col("j")
        narrow = labels.agg(F.lit(1)).select(units.alias("j"))
        parts = [
            _kernel(w1, 1),
            _vector(labels.withColumn("w", (j % 3) / 10), 1, "bias"),
            _vector(labels.withColumn("w", 1 + j / 10), 1, "gamma"),
            _vector(labels.withColumn("w", F.lit(0.01)), 1, "beta"),
            _vector(labels.withColumn("w", F.lit(0.05)), 1, "moving_mean"),
            _vector(labels.withColumn("w", F.lit(0.5)), 1, "moving_var"),
            _kernel(w2, 4),
            _vector(narrow.withColumn("w", (j % 3) / 10), 4, "bias"),
        ]
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return result

    stored = _once(spark, sf_dir, "class-weights", weights)
    widths = stored.filter("part = 'bias'").select("layer_idx", F.size("w").alias("u"))
    sizes = {r["layer_idx"]: r["u"] for r in widths.collect()}
    n_features = stored.filter("layer_idx = 1 and part = 'kernel'").count()
    rows = [
        (CLASS_MODEL, 0, "input_layer", "input", n_features, None, False),
        (CLASS_MODEL, 1, "dense", "dense", sizes[1], "relu", False),
        (CLASS_MODEL, 2, "batch_normalization", "batch_normalization", sizes[1], None, False),
        (CLASS_MODEL, 3, "dropout", "dropout", sizes[1], None, False),
        (CLASS_MODEL, 4, "dense_1", "dense", sizes[4], "relu", True),
    ]
    return spark.createDataFrame(rows, LAYERS_SCHEMA), stored


# Models read from the part table: forty consecutive parts are the layers of a model.
PART_LAYERS = """layers AS (
  SELECT 'model_' || (p_partkey // 40) AS model, CAST(p_partkey % 40 AS INTEGER) AS layer_idx,
         CASE WHEN p_partkey // 40 % 7 = 3 OR p_type = 'PROMO' THEN 'norm_' ELSE 'Dense_' END
           || p_partkey AS name,
         CASE WHEN p_partkey // 40 % 7 = 3 OR p_type = 'PROMO' THEN 'batch_normalization'
              ELSE 'dense' END AS kind,
         p_size AS units
  FROM part)"""


def part_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer tables with repeated widths; some models have no dense layer."""
    number = F.floor(F.col("p_partkey") / 40)
    other = (number % 7 == 3) | (F.col("p_type") == "PROMO")
    prefix = F.when(other, "norm_").otherwise("Dense_")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("model_"), number.cast("string")).alias("model"),
        (F.col("p_partkey") % 40).cast("int").alias("layer_idx"),
        F.concat(prefix, F.col("p_partkey").cast("string")).alias("name"),
        F.when(other, "batch_normalization").otherwise("dense").alias("kind"),
        F.col("p_size").alias("units"),
    )
