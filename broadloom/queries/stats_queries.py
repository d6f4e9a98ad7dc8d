"""Per-feature statistics, histograms, reconstruction metrics, boxes and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadloom.operators import matrix as m
from broadloom.operators import metrics, scalers, stats
from broadloom.operators.quantiles import quantiles, references
from broadloom.plans.scaling import analyse_scaling, stat_histograms
from broadloom.plans.tuning import error_histograms_of
from broadloom.queries import fixtures as fx
from broadloom.queries.registry import query
from broadloom.queries.scaler_queries import exponents_sql, probit_sql, scores_sql, yj_sql
from broadloom.session import materialize, scratch_path


def _rounded(df, places, *columns):
    return df.withColumns({c: F.round(c, places) + 0.0 for c in columns})


@query(
    "d01_feature_range",
    f"WITH {fx.LINE_CELLS} SELECT CAST(feature_idx AS INTEGER) AS feature_idx, "
    "round(max(x) - min(x), 6) AS range FROM line_cells GROUP BY feature_idx",
)
def d01(spark, sf_dir):
    return _rounded(stats.feature_stats(fx.line_matrix(spark, sf_dir)).select("feature_idx", "range"), 6, "range")


@query(
    "d02_feature_mean",
    f"WITH {fx.NULL_CELLS} SELECT CAST(feature_idx AS INTEGER) AS feature_idx, "
    "round(avg(x), 9) + 0.0 AS mean FROM nulled GROUP BY feature_idx",
)
def d02(spark, sf_dir):
    found = stats.feature_stats(fx.matrix_with_nulls(spark, sf_dir)).select("feature_idx", "mean")
    return _rounded(found, 9, "mean")


@query(
    "d03_feature_std",
    f"WITH {fx.CONST_CELLS} SELECT CAST(feature_idx AS INTEGER) AS feature_idx, "
    "round(stddev_pop(x), 9) + 0.0 AS std FROM with_const GROUP BY feature_idx",
)
def d03(spark, sf_dir):
    found = stats.feature_stats(fx.matrix_with_constant(spark, sf_dir)).select("feature_idx", "std")
    return _rounded(found, 9, "std")


def histogram_sql(source: str, by: str, bins: int, places: int) -> str:
    """Bins of ``v`` in ``source`` per ``by``; the last bin closed, empty bins kept."""
    return f"""edges AS (
  SELECT {by}, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
         CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi
  FROM {source} GROUP BY {by}),
frame AS (
  SELECT e.*, b.bin, CASE WHEN b.bin = {bins} THEN hi ELSE lo + b.bin * ((hi - lo) / {bins}) END AS bin_start,
         CASE WHEN b.bin + 1 = {bins} THEN hi ELSE lo + (b.bin + 1) * ((hi - lo) / {bins}) END AS bin_end
  FROM edges e CROSS JOIN (SELECT unnest(range(0, {bins})) AS bin) b),
guessed AS (
  SELECT {', '.join('s.' + c for c in by.split(', '))}, v, lo, (hi - lo) / {bins} AS w,
         least(greatest(CAST(floor((v - lo) / ((hi - lo) / {bins})) AS BIGINT), 0), {bins - 1}) AS g
  FROM {source} s JOIN edges e ON {' AND '.join(f's.{c} = e.{c}' for c in by.split(', '))}
  WHERE v IS NOT NULL),
counted AS (
  SELECT {by}, CASE WHEN g > 0 AND v < lo + g * w THEN g - 1
                    WHEN g < {bins - 1} AND v >= lo + (g + 1) * w THEN g + 1 ELSE g END AS bin, count(*) AS c
  FROM guessed GROUP BY ALL)
SELECT {by}, CAST(bin AS INTEGER) AS bin, round(bin_start, {places}) + 0.0 AS bin_start,
       round(bin_end, {places}) + 0.0 AS bin_end, coalesce(c, 0) AS count
FROM frame LEFT JOIN counted USING ({by}, bin)"""


@query(
    "d04_histogram",
    f"WITH {fx.LINE_CELLS}, named AS (SELECT feature_idx, x AS v FROM line_cells), "
    + histogram_sql("named", "feature_idx", 37, 6),
)
def d04(spark, sf_dir):
    cells = m.to_long(fx.line_matrix(spark, sf_dir))
    found = stats.histogram(cells, "value", 37, ["feature_idx"])
    return _rounded(found, 6, "bin_start", "bin_end").withColumn("feature_idx", F.col("feature_idx"))


def _recon_features(spark, sf_dir):
    return metrics.per_feature(fx.reconstructions(spark, sf_dir), ["trial_id"])


@query(
    "d05_reconstruction_error",
    f"""WITH {fx.RECON} SELECT CAST(trial_id AS INTEGER) AS trial_id,
       round(avg((x - p) * (x - p)), 10) AS mse, round(sqrt(avg((x - p) * (x - p))), 10) AS rmse,
       round(avg(abs(x - p)), 10) AS mae FROM recon GROUP BY trial_id""",
)
def d05(spark, sf_dir):
    found = metrics.summary(_recon_features(spark, sf_dir), ["trial_id"])
    return _rounded(found.select("trial_id", "mse", "rmse", "mae"), 10, "mse", "rmse", "mae")


@query(
    "d06_r2_score",
    f"WITH {fx.PER_FEATURE} SELECT CAST(trial_id AS INTEGER) AS trial_id, round(avg(f_r2), 9) AS r2_score "
    "FROM pfm GROUP BY trial_id",
)
def d06(spark, sf_dir):
    found = metrics.summary(_recon_features(spark, sf_dir), ["trial_id"])
    return _rounded(found.select("trial_id", "r2_score"), 9, "r2_score")


@query(
    "d07_range_error",
    f"""WITH {fx.RECON}, ranges AS (SELECT feature_idx, max(x) - min(x) AS rng FROM cells GROUP BY feature_idx)
SELECT CAST(trial_id AS INTEGER) AS trial_id,
       round(avg((x - p) * (x - p) / (rng * rng + 1e-8)), 10) AS range_mse
FROM recon JOIN ranges USING (feature_idx) GROUP BY trial_id""",
)
def d07(spark, sf_dir):
    found = metrics.summary(_recon_features(spark, sf_dir), ["trial_id"])
    return _rounded(found.select("trial_id", "range_mse"), 10, "range_mse")


@query(
    "d08_per_feature_error",
    f"""WITH {fx.PER_FEATURE} SELECT CAST(trial_id AS INTEGER) AS trial_id,
       CAST(feature_idx AS INTEGER) AS feature_idx, round(f_mse, 10) AS mse, round(f_range_mse, 10) AS range_mse
FROM pfm""",
)
def d08(spark, sf_dir):
    found = _recon_features(spark, sf_dir).select("trial_id", "feature_idx", "mse", "range_mse")
    return _rounded(found, 10, "mse", "range_mse")


@query(
    "d08_range_error_center",
    f"""WITH {fx.PER_FEATURE} SELECT CAST(trial_id AS INTEGER) AS trial_id,
       round(avg(f_range_mse), 10) AS mean_per_feature_range_mse,
       round(quantile_cont(f_range_mse, 0.5), 10) AS median_per_feature_range_mse FROM pfm GROUP BY trial_id""",
)
def d08_center(spark, sf_dir):
    wanted = ("mean_per_feature_range_mse", "median_per_feature_range_mse")
    found = metrics.summary(_recon_features(spark, sf_dir), ["trial_id"])
    return _rounded(found.select("trial_id", *wanted), 10, *wanted)


@query(
    "d09_baseline_improvement",
    f"""WITH {fx.RECON}, base AS (
  SELECT avg((x - mean) * (x - mean)) AS b FROM cells JOIN means USING (feature_idx))
SELECT CAST(trial_id AS INTEGER) AS trial_id, round(any_value(b), 10) AS baseline_mse,
       round(1 - avg((x - p) * (x - p)) / any_value(b), 9) AS improvement_ratio
FROM recon CROSS JOIN base GROUP BY trial_id""",
)
def d09(spark, sf_dir):
    found = metrics.summary(_recon_features(spark, sf_dir), ["trial_id"])
    return found.select(
        "trial_id", F.round("baseline_mse", 10).alias("baseline_mse"),
        F.round("improvement_ratio", 9).alias("improvement_ratio"),
    )


@query(
    "d04_error_histograms",
    f"""WITH {fx.PER_FEATURE.replace("pfm AS (", "pfm AS MATERIALIZED (")}, tidy AS MATERIALIZED (
  SELECT CAST(trial_id AS INTEGER) AS trial_id, 'mse' AS stat, round(f_mse, 10) AS v FROM pfm
  UNION ALL SELECT trial_id, 'range_mse', round(f_range_mse, 10) FROM pfm), """
    + histogram_sql("tidy", "trial_id, stat", 200, 13),
)
def d04_errors(spark, sf_dir):
    errors = _recon_features(spark, sf_dir).withColumns(
        {c: F.round(c, 10) for c in ("mse", "range_mse")}
    )
    return _rounded(error_histograms_of(errors), 13, "bin_start", "bin_end")


# Statistics that a long text column and a value table need exactly.


@query(
    "d19_box_stats_trials",
    f"""WITH {fx.REFINED}, q AS (
  SELECT source, quantile_cont(mse, 0.25) AS q1, quantile_cont(mse, 0.5) AS median,
         quantile_cont(mse, 0.75) AS q3 FROM combined GROUP BY source)
SELECT source, count(*) AS n, round(any_value(q1), 9) AS q1, round(any_value(median), 9) AS median,
       round(any_value(q3), 9) AS q3,
       round(min(mse) FILTER (WHERE mse BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 9) AS whisker_low,
       round(max(mse) FILTER (WHERE mse BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 9) AS whisker_high,
       count(*) FILTER (WHERE NOT mse BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
FROM combined JOIN q USING (source) GROUP BY source""",
)
def d19_trials(spark, sf_dir):
    return _box(stats.box_stats(fx.combined_table(spark, sf_dir), "mse", ["source"]))


def _box(found):
    return _rounded(found, 9, "q1", "median", "q3", "whisker_low", "whisker_high")


def _box_sql(table: str, value: str, by: str) -> str:
    inside = f"{value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
    return f"""q AS (
  SELECT {by}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
         quantile_cont({value}, 0.75) AS q3 FROM {table} GROUP BY {by})
SELECT {by}, count(*) AS n, round(any_value(q1), 9) AS q1, round(any_value(median), 9) AS median,
       round(any_value(q3), 9) AS q3, round(min({value}) FILTER (WHERE {inside}), 9) AS whisker_low,
       round(max({value}) FILTER (WHERE {inside}), 9) AS whisker_high,
       count(*) FILTER (WHERE NOT ({inside})) AS outliers
FROM {table} JOIN q USING ({by}) GROUP BY {by}"""


@query("d19_box_stats", "WITH " + _box_sql("orders", "o_totalprice", "o_orderpriority"))
def d19(spark, sf_dir):
    return _box(stats.box_stats(fx.table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"]))


@query("d19_box_stats_narrowed", "WITH " + _box_sql("events", "value", "event_type"))
def d19_narrowed(spark, sf_dir):
    """The way taken by groups too large for one task, forced here."""
    events = fx.table(spark, sf_dir, "events")
    return _box(stats.box_stats(events, "value", ["event_type"], group_limit=100, bins=64))


@query(
    "d19_box_r2_by_config",
    f"WITH {fx.TRIALS}, " + _box_sql("timed", "r2_score", "encoding_dim, num_layers"),
)
def d19_r2(spark, sf_dir):
    return _box(stats.box_stats(fx.trial_table(spark, sf_dir), "r2_score", ["encoding_dim", "num_layers"]))


@query(
    "d20_group_mean",
    f"""WITH {fx.TRIALS} SELECT encoding_dim, num_layers, count(*) AS n,
       round(avg(improvement_ratio), 9) AS mean FROM timed GROUP BY encoding_dim, num_layers""",
)
def d20(spark, sf_dir):
    found = stats.group_mean(fx.trial_table(spark, sf_dir), "improvement_ratio", ["encoding_dim", "num_layers"])
    return _rounded(found, 9, "mean")


@query(
    "d20_mean_interval",
    f"""WITH {fx.REFINED} SELECT learning_rate, batch_size, dropout_rate, count(*) AS n,
       round(avg(mse), 9) AS mean, true AS holds_mean, min(mse) < max(mse) AS is_open
FROM combined WHERE source = 'refined' GROUP BY learning_rate, batch_size, dropout_rate""",
)
def d20_interval(spark, sf_dir):
    """The draws are the library's own; what must hold of every interval."""
    by = ["learning_rate", "batch_size", "dropout_rate"]
    found = stats.mean_interval(fx.refined_table(spark, sf_dir), "mse", by, "trial_id")
    inside = (F.col("low") <= F.col("mean") + 1e-12) & (F.col("mean") <= F.col("high") + 1e-12)
    return found.select(
        *by, "n", F.round("mean", 9).alias("mean"), inside.alias("holds_mean"),
        (F.col("low") + 1e-15 < F.col("high")).alias("is_open"),
    )


_NARROW = f"""WITH {fx.LINE_CELLS}
SELECT CAST(feature_idx AS INTEGER) AS feature_idx, round(quantile_cont(x, 0.1), 6) AS p10,
       round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.999), 6) AS p999
FROM line_cells GROUP BY feature_idx"""


@query("d08_exact_quantiles_narrowed", _NARROW)
def exact_quantiles(spark, sf_dir):
    """Exact quantiles of features too long for one task."""
    found = quantiles(
        m.to_long(fx.line_matrix(spark, sf_dir)), "value", [0.1, 0.5, 0.999], ["feature_idx"], group_limit=500
    )
    at = lambda i: F.round(F.get("q", F.lit(i)), 6)
    return found.select("feature_idx", at(0).alias("p10"), at(1).alias("p50"), at(2).alias("p999"))


@query(
    "d08_thousand_levels_narrowed",
    f"""WITH {fx.LINE_CELLS}, sorted AS (
  SELECT feature_idx, list_sort(list(x)) AS xs, count(*) AS n FROM line_cells GROUP BY feature_idx),
placed AS (SELECT feature_idx, xs, s, s * (n - 1) / 999.0 AS pos FROM sorted CROSS JOIN (SELECT unnest(range(0, 1000)) AS s))
SELECT feature_idx::INTEGER AS feature_idx, s::INTEGER AS level,
       round(xs[floor(pos)::BIGINT + 1] + (xs[ceil(pos)::BIGINT + 1] - xs[floor(pos)::BIGINT + 1]) * (pos - floor(pos)), 5) + 0.0 AS value
FROM placed""",
)
def thousand_levels(spark, sf_dir):
    """As many levels as the quantile scaler fits, for features too long for one task."""
    cells = m.to_long(fx.line_matrix(spark, sf_dir))
    found = quantiles(cells, "value", references(1000), ["feature_idx"], group_limit=500)
    levels = found.select("feature_idx", F.posexplode("q").alias("level", "value"))
    return levels.withColumn("value", F.round("value", 5) + 0.0)


# --- the flagship ---------------------------------------------------------

# Scaling cell by cell and then measuring; values are rounded before they are binned
# so that both engines see the same edges.
_SCALED_STATS = f"""{fx.CELLS}, params AS (
  SELECT feature_idx, avg(x) AS m, stddev_pop(x) AS sd, min(x) AS lo, max(x) AS hi, max(abs(x)) AS ma,
         quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr
  FROM cells GROUP BY feature_idx),
scaled AS (
  SELECT s.scaler, feature_idx, CASE s.scaler WHEN 'standard' THEN (x - m) / sd
         WHEN 'robust' THEN (x - q2) / iqr WHEN 'maxabs' THEN x / ma ELSE (x - lo) / (hi - lo) END AS z
  FROM cells JOIN params USING (feature_idx) CROSS JOIN (
    SELECT unnest(['standard', 'robust', 'maxabs', 'minmax', 'minmax_scale']) AS scaler) s),
stats AS (
  SELECT scaler, feature_idx, max(z) - min(z) AS range, avg(z) AS mean, stddev_pop(z) AS std
  FROM scaled GROUP BY scaler, feature_idx),
tidy AS (
  SELECT scaler, 'range' AS stat, round(range, 8) + 0.0 AS v FROM stats
  UNION ALL SELECT scaler, 'mean', round(mean, 8) + 0.0 FROM stats
  UNION ALL SELECT scaler, 'std', round(std, 8) + 0.0 FROM stats)"""


def _linear_stats(spark, sf_dir):
    found = scalers.scaled_stats(fx.matrix(spark, sf_dir), scalers.LINEAR)
    return _rounded(found, 8, "value")


@query(
    "d22_scaling_histograms",
    f"WITH {_SCALED_STATS}, " + histogram_sql("tidy", "scaler, stat", 300, 10),
)
def d22(spark, sf_dir):
    """Histograms of every feature statistic after each linear scaling."""
    stats_table = materialize(_linear_stats(spark, sf_dir), "scaled-stats")
    return _rounded(stat_histograms(stats_table), 10, "bin_start", "bin_end")


_ALL_STATS = f"""{_SCALED_STATS},
{exponents_sql('SELECT feature_idx, x FROM cells')},
bent AS (SELECT feature_idx, {yj_sql('x', 'lam')} AS y FROM cells JOIN lambdas USING (feature_idx)),
power_stats AS (
  SELECT 'power' AS scaler, feature_idx, (max(y) - min(y)) / stddev_pop(y) AS range, 0.0 AS mean, 1.0 AS std
  FROM bent GROUP BY feature_idx),
{scores_sql('cells')},
normal AS (SELECT feature_idx, {probit_sql('u')} AS z FROM scores),
quantile_stats AS (
  SELECT 'quantile' AS scaler, feature_idx, max(z) - min(z) AS range, avg(z) AS mean, stddev_pop(z) AS std
  FROM normal GROUP BY feature_idx),
every AS (
  SELECT * FROM stats UNION ALL SELECT * FROM power_stats UNION ALL SELECT * FROM quantile_stats),
tidy_all AS (
  SELECT scaler, 'range' AS stat, round(range, 5) + 0.0 AS v FROM every
  UNION ALL SELECT scaler, 'mean', round(mean, 5) + 0.0 FROM every
  UNION ALL SELECT scaler, 'std', round(std, 5) + 0.0 FROM every)"""


@query(
    "d22_scaling_histograms_all",
    f"WITH {_ALL_STATS}, " + histogram_sql("tidy_all", "scaler, stat", 300, 7),
)
def d22_all(spark, sf_dir):
    """The same for all seven scalings."""
    found = _rounded(scalers.scaled_stats(fx.matrix(spark, sf_dir)), 5, "value")
    stored = materialize(found, "scaled-stats")
    return _rounded(stat_histograms(stored), 7, "bin_start", "bin_end")


@query(
    "a10_histogram_sink",
    f"""WITH {_SCALED_STATS}
SELECT scaler, stat, count(*) AS features FROM tidy GROUP BY scaler, stat""",
)
def a10(spark, sf_dir):
    """Written per scaler and statistic, read back; every feature is in one bin."""
    path = scratch_path(spark, "histograms")
    analyse_scaling(fx.matrix(spark, sf_dir), path, scalers.LINEAR)
    stored = spark.read.parquet(path)
    return stored.groupBy("scaler", "stat").agg(F.sum("count").alias("features"))
