"""Trial analytics: best rows, summaries, histories, run comparison, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadloom.functions.text import fixed, grouped, percent
from broadloom.operators import history, report, trials
from broadloom.queries import fixtures as fx
from broadloom.queries.registry import query
from broadloom.session import scratch_path
from broadloom.sources import sinks

_KEY_COLUMNS = ("trial_id", "encoding_dim", "num_layers", "mse", "r2_score", "improvement_ratio")
_KEYS = ", ".join(_KEY_COLUMNS)


def _rounded(df, places, *columns):
    return df.withColumns({c: F.round(c, places) + 0.0 for c in columns})


@query(
    "d14_overall_stats",
    f"""WITH {fx.TRIALS} SELECT count(*) AS models, min(mse) AS mse_min, max(mse) AS mse_max,
       min(r2_score) AS r2_min, max(r2_score) AS r2_max, min(improvement_ratio) AS improvement_min,
       max(improvement_ratio) AS improvement_max FROM timed""",
)
def d14(spark, sf_dir):
    return trials.overall(fx.trial_table(spark, sf_dir))


def _group_sql(table: str, parameters: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{p}' AS parameter, CAST({p} AS DOUBLE) AS level, count(*) AS count,
       round(avg(mse), 12) AS avg_mse, round(avg(r2_score), 8) AS avg_r2, min(mse) AS best_mse
FROM {table} GROUP BY {p}"""
        for p in parameters
    )


@query("d15_group_summary", f"WITH {fx.REFINED} {_group_sql('combined', trials.HYPER_PARAMETERS)}")
def d15(spark, sf_dir):
    found = _rounded(trials.group_summary(fx.combined_table(spark, sf_dir)), 12, "avg_mse")
    return _rounded(found, 8, "avg_r2")


@query(
    "d15_group_summary_orders",
    """SELECT 'o_orderpriority' AS parameter, count(*) AS count, round(avg(o_totalprice), 4) AS avg_mse
FROM orders GROUP BY o_orderpriority""",
)
def d15_orders(spark, sf_dir):
    """The same pass over a large table: order prices stand for the errors."""
    orders = fx.table(spark, sf_dir, "orders").select(
        F.substring("o_orderpriority", 1, 1).cast("int").alias("o_orderpriority"),
        F.col("o_totalprice").alias("mse"),
        F.col("o_totalprice").alias("r2_score"),
    )
    found = trials.group_summary(orders, ["o_orderpriority"])
    return _rounded(found.select("parameter", "count", "avg_mse"), 4, "avg_mse")


@query(
    "d16_level_impact",
    f"""WITH {fx.REFINED}, g AS ({_group_sql('refined', trials.HYPER_PARAMETERS)})
SELECT parameter, arg_min(level, {{'a': avg_mse, 'l': level}}) AS best_level,
       arg_max(level, {{'a': avg_mse, 'l': level}}) AS worst_level FROM g GROUP BY parameter""",
)
def d16(spark, sf_dir):
    return trials.level_impact(fx.refined_table(spark, sf_dir))


@query(
    "d17_mse_pivot",
    f"""WITH {fx.TRIALS} SELECT num_layers, """
    + ", ".join(f'round(avg(mse) FILTER (WHERE encoding_dim = {k}), 12) AS "{k}"' for k in fx.TRIAL_K)
    + " FROM timed GROUP BY num_layers",
)
def d17(spark, sf_dir):
    pivoted = trials.pivot(fx.trial_table(spark, sf_dir), fx.TRIAL_K)
    return _rounded(pivoted, 12, *[str(k) for k in fx.TRIAL_K])


@query(
    "d18_time_correlations",
    f"""WITH {fx.TRIALS}, c AS (SELECT corr(total_training_time, num_layers) AS cl,
  corr(total_training_time, encoding_dim) AS cd FROM timed)
SELECT round(cl, 9) AS corr_layers, round(cd, 9) AS corr_dim, cl > 0.5 AS grows_with_layers,
       cd > 0.5 AS grows_with_dim FROM c""",
)
def d18(spark, sf_dir):
    return _rounded(trials.time_correlations(fx.trial_table(spark, sf_dir)), 9, "corr_layers", "corr_dim")


@query(
    "d21_distinct_levels",
    f"WITH {fx.REFINED} SELECT DISTINCT learning_rate AS level FROM combined ORDER BY level",
)
def d21(spark, sf_dir):
    return trials.levels(fx.combined_table(spark, sf_dir), "learning_rate")


_BEST = " UNION ALL ".join(
    f"""(SELECT '{name}' AS criterion, {_KEYS} FROM timed WHERE {metric} IS NOT NULL
 ORDER BY {metric} {'DESC' if big else ''}, trial_id LIMIT 1)"""
    for name, metric, big in trials.CRITERIA
)


@query("e01_best_trials", f"WITH {fx.TRIALS} {_BEST}")
def e01(spark, sf_dir):
    return trials.best_by_each(fx.trial_table(spark, sf_dir)).select("criterion", *_KEY_COLUMNS)


@query(
    "e01_best_per_group",
    """SELECT o_orderpriority, arg_min(o_orderkey, {'p': o_totalprice, 'k': o_orderkey}) AS trial_id,
       min(o_totalprice) AS mse FROM orders GROUP BY o_orderpriority""",
)
def e01_group(spark, sf_dir):
    """Lowest row of every group of a large table."""
    orders = fx.table(spark, sf_dir, "orders").select(
        "o_orderpriority", F.col("o_orderkey").alias("trial_id"), F.col("o_totalprice").alias("mse")
    )
    return trials.best(orders, "mse", by=["o_orderpriority"])


@query(
    "e02_top_per_source",
    f"""WITH {fx.REFINED} SELECT source, trial_id, mse, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY mse, trial_id) AS INTEGER) AS rank
  FROM combined) WHERE rank <= 5""",
)
def e02(spark, sf_dir):
    top = trials.top_per_source(fx.combined_table(spark, sf_dir))
    return top.select("source", "trial_id", "mse", "rank")


@query(
    "e03_top_small",
    f"""WITH {fx.TRIALS} SELECT trial_id, encoding_dim, r2_score FROM timed WHERE encoding_dim <= 32
ORDER BY r2_score DESC, trial_id LIMIT 5""",
)
def e03(spark, sf_dir):
    return trials.top(fx.trial_table(spark, sf_dir), 5, 32).select("trial_id", "encoding_dim", "r2_score")


@query(
    "e03_ranked",
    f"WITH {fx.TRIALS} SELECT trial_id, r2_score FROM timed ORDER BY r2_score DESC, trial_id",
)
def e03_ranked(spark, sf_dir):
    return trials.ranked(fx.trial_table(spark, sf_dir)).select("trial_id", "r2_score")


_BALANCED = """(SELECT * FROM {t} WHERE mse < (SELECT quantile_cont(mse, 0.5) FROM {t})
  AND total_training_time < (SELECT quantile_cont(total_training_time, 0.5) FROM {t})
  ORDER BY mse, trial_id LIMIT 1)"""
_FASTEST = """(SELECT * FROM {t} WHERE mse < (SELECT quantile_cont(mse, 0.5) FROM {t}) * 1.1
  ORDER BY total_training_time, trial_id LIMIT 1)"""


@query(
    "e04_balanced_best",
    f"WITH {fx.TRIALS} SELECT {_KEYS}, round(total_training_time, 6) AS total_training_time "
    f"FROM {_BALANCED.format(t='timed')}",
)
def e04(spark, sf_dir):
    found = trials.balanced(fx.trial_table(spark, sf_dir)).select(*_KEY_COLUMNS, "total_training_time")
    return _rounded(found, 6, "total_training_time")


@query(
    "e05_fastest_usable",
    f"WITH {fx.TRIALS} SELECT {_KEYS}, round(total_training_time, 6) AS total_training_time "
    f"FROM {_FASTEST.format(t='timed')}",
)
def e05(spark, sf_dir):
    found = trials.fastest_usable(fx.trial_table(spark, sf_dir)).select(*_KEY_COLUMNS, "total_training_time")
    return _rounded(found, 6, "total_training_time")


@query(
    "e06_consensus",
    f"""WITH {fx.TRIALS}, a AS (SELECT * FROM timed ORDER BY mse, trial_id LIMIT 1),
b AS (SELECT * FROM timed ORDER BY r2_score DESC, trial_id LIMIT 1)
SELECT a.trial_id AS best_mse_trial, b.trial_id AS best_r2_trial,
       a.encoding_dim = b.encoding_dim AND a.num_layers = b.num_layers AS same_config FROM a, b""",
)
def e06(spark, sf_dir):
    return trials.consensus(fx.trial_table(spark, sf_dir))


@query(
    "e07_best_epochs",
    f"""WITH {fx.CONVERGENCE} SELECT trial_id, best_epoch, best_val_loss, final_train_loss, final_val_loss,
       total_epochs FROM conv""",
)
def e07(spark, sf_dir):
    return history.convergence(fx.history(spark, sf_dir)).select(
        "trial_id", "best_epoch", "best_val_loss", "final_train_loss", "final_val_loss", "total_epochs"
    )


@query(
    "e08_convergence",
    f"""WITH {fx.CONVERGENCE} SELECT trial_id, round(best_epoch / total_epochs, 9) AS convergence_speed,
       round(avg_epoch_time, 9) AS avg_epoch_time, round(total_training_time, 6) AS total_training_time FROM conv""",
)
def e08(spark, sf_dir):
    found = history.convergence(fx.history(spark, sf_dir)).select(
        "trial_id", "convergence_speed", "avg_epoch_time", "total_training_time"
    )
    found = _rounded(found, 6, "total_training_time")
    return _rounded(found, 9, "convergence_speed", "avg_epoch_time")


def _early_stop_sql(patience: int) -> str:
    return f"""WITH {fx.HISTORY}, floor AS (
  SELECT *, min(val_loss) OVER (PARTITION BY trial_id ORDER BY epoch
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM history),
marked AS (SELECT *, f IS NULL OR val_loss < f AS improved FROM floor),
waited AS (
  SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY trial_id ORDER BY epoch) AS w
  FROM marked),
stops AS (SELECT trial_id, min(epoch) FILTER (WHERE w >= {patience}) AS stop_epoch FROM waited GROUP BY trial_id)
SELECT trial_id, stop_epoch, max(epoch) FILTER (WHERE improved) AS best_epoch, max(epoch) AS epochs_run
FROM waited JOIN stops USING (trial_id)
WHERE stop_epoch IS NULL OR epoch <= stop_epoch GROUP BY trial_id, stop_epoch"""


@query("e09_early_stop", _early_stop_sql(5))
def e09(spark, sf_dir):
    return history.early_stop(fx.history(spark, sf_dir))


@query("e09_early_stop_patience_2", _early_stop_sql(2))
def e09_short(spark, sf_dir):
    return history.early_stop(fx.history(spark, sf_dir), 2)


@query(
    "e10_run_comparison",
    f"""WITH {fx.REFINED}, p AS (SELECT min(mse) FILTER (WHERE source = 'original') AS original_mse,
  min(mse) FILTER (WHERE source = 'refined') AS refined_mse FROM combined)
SELECT original_mse, refined_mse,
       round((original_mse - refined_mse) / original_mse * 100, 6) AS improvement_pct,
       (original_mse - refined_mse) / original_mse * 100 > 0 AS improved FROM p""",
)
def e10(spark, sf_dir):
    return _rounded(trials.compare_runs(fx.combined_table(spark, sf_dir)), 6, "improvement_pct")


# --- grid -----------------------------------------------------------------

_GRID = """grid AS (
  SELECT CAST(d.i * 5 + l.l AS INTEGER) AS trial_id, CAST(d.d AS INTEGER) AS encoding_dim,
         CAST(l.l AS INTEGER) AS num_layers, [4096, 2048, 1024, 512, 256] AS deep, d.i, l.l
  FROM (SELECT * FROM (VALUES (0, 64), (1, 128), (2, 256), (3, 1024), (4, 2048)) v(i, d)) d
  CROSS JOIN (SELECT * FROM (VALUES (1), (2), (3), (4), (5)) v(l)) l)"""
_CONFIG_TEXT = """CASE num_layers WHEN 1 THEN '[4096]' WHEN 2 THEN '[4096, 1024]'
  WHEN 3 THEN '[4096, 2048, 1024]' WHEN 4 THEN '[4096, 2048, 1024, 512]'
  ELSE '[4096, 2048, 1024, 512, 256]' END"""


def _measured_grid(spark, sf_dir):
    """The search grid with the width measured on the matrix."""
    width = fx.matrix(spark, sf_dir).agg(F.max(F.size("features")))
    return trials.grid(spark).withColumn("n_features", width.scalar())


@query(
    "f01_union_runs",
    f"""WITH {fx.REFINED} SELECT source, count(*) AS trials, count(batch_size) AS with_batch,
       round(avg(learning_rate), 9) AS avg_rate FROM combined GROUP BY source""",
)
def f01(spark, sf_dir):
    found = fx.combined_table(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("trials"), F.count("batch_size").alias("with_batch"),
        F.avg("learning_rate").alias("avg_rate"),
    )
    return _rounded(found, 9, "avg_rate")


@query(
    "f02_search_grid",
    f"""WITH {_GRID} SELECT trial_id, encoding_dim, num_layers, {_CONFIG_TEXT} AS layers,
       (SELECT CAST(max(len(embedding)) AS INTEGER) FROM embeddings) AS n_features FROM grid""",
)
def f02(spark, sf_dir):
    from broadloom.functions.text import show_int_list

    return _measured_grid(spark, sf_dir).select(
        "trial_id", "encoding_dim", "num_layers", show_int_list(F.col("layer_config")).alias("layers"), "n_features"
    )


@query(
    "f03_pick_config",
    f"WITH {fx.REFINED} SELECT source, trial_id, encoding_dim, num_layers, mse FROM combined WHERE trial_id = 17",
)
def f03(spark, sf_dir):
    picked = trials.pick(fx.combined_table(spark, sf_dir), 17)
    return picked.select("source", "trial_id", "encoding_dim", "num_layers", "mse")


@query(
    "f04_config_summary",
    f"WITH {fx.REFINED} SELECT source, trial_id, CAST(len(layer_config) AS INTEGER) AS num_layers FROM combined",
)
def f04(spark, sf_dir):
    return fx.combined_table(spark, sf_dir).select("source", "trial_id", F.size("layer_config").alias("num_layers"))


def _params_sql(table: str, n: str) -> str:
    """Layer by layer: every dense layer and the normalisation after all but the last."""
    return f"""units AS (
  SELECT trial_id, {n} AS n, list_concat(list_concat(cfg, [encoding_dim]), list_reverse(cfg)) AS h FROM {table}),
steps AS (SELECT trial_id, n, unnest(list_concat(h, [n])) AS u, unnest(list_concat([n], h)) AS prev,
                 unnest(list_concat(list_transform(h, lambda x: 4 * x), [0])) AS norm FROM units)
SELECT trial_id, CAST(sum(prev * u + u + norm) AS BIGINT) AS total_params FROM steps GROUP BY trial_id"""


@query(
    "g03_param_count",
    f"""WITH {_GRID}, cfgs AS (SELECT trial_id, encoding_dim,
  CASE num_layers WHEN 1 THEN [4096] WHEN 2 THEN [4096, 1024] WHEN 3 THEN [4096, 2048, 1024]
  WHEN 4 THEN [4096, 2048, 1024, 512] ELSE [4096, 2048, 1024, 512, 256] END AS cfg FROM grid), """
    + _params_sql("cfgs", "(SELECT max(len(embedding)) FROM embeddings)"),
)
def g03(spark, sf_dir):
    count = trials.param_count(F.col("layer_config"), F.col("encoding_dim"), F.col("n_features"))
    return _measured_grid(spark, sf_dir).select("trial_id", count.alias("total_params"))


# --- reports and plot data ------------------------------------------------


@query(
    "a12_model_summary",
    f"""WITH {fx.TRIALS} SELECT CAST(trial_id AS VARCHAR) AS key, 'performance' AS section, m.metric,
       CASE m.metric WHEN 'mse' THEN mse WHEN 'rmse' THEN rmse WHEN 'mae' THEN mae
         WHEN 'r2_score' THEN r2_score WHEN 'range_mse' THEN range_mse
         WHEN 'mean_per_feature_range_mse' THEN mean_per_feature_range_mse
         WHEN 'median_per_feature_range_mse' THEN median_per_feature_range_mse
         WHEN 'baseline_mse' THEN baseline_mse ELSE improvement_ratio END AS value
FROM timed CROSS JOIN (SELECT unnest(['mse', 'rmse', 'mae', 'r2_score', 'range_mse',
  'mean_per_feature_range_mse', 'median_per_feature_range_mse', 'baseline_mse', 'improvement_ratio']) AS metric) m
UNION ALL SELECT CAST(trial_id AS VARCHAR), 'model_configuration', 'encoding_dim', encoding_dim FROM timed
UNION ALL SELECT CAST(trial_id AS VARCHAR), 'model_configuration', 'layer_config', NULL FROM timed
UNION ALL SELECT CAST(trial_id AS VARCHAR), 'model_configuration', 'total_params', total_params FROM timed
UNION ALL SELECT CAST(trial_id AS VARCHAR), 'training', 'final_train_loss', final_train_loss FROM timed
UNION ALL SELECT CAST(trial_id AS VARCHAR), 'training', 'final_val_loss', final_val_loss FROM timed
UNION ALL SELECT CAST(trial_id AS VARCHAR), 'training', 'best_epoch', best_epoch FROM timed
UNION ALL SELECT CAST(trial_id AS VARCHAR), 'training', 'total_epochs', total_epochs FROM timed
UNION ALL SELECT CAST(trial_id AS VARCHAR), 'training', 'best_val_loss', best_val_loss FROM timed
UNION ALL SELECT CAST(trial_id AS VARCHAR), 'timing', 'total_training_time', round(total_training_time, 6) FROM timed
UNION ALL SELECT CAST(trial_id AS VARCHAR), 'timing', 'avg_epoch_time', round(avg_epoch_time, 6) FROM timed
UNION ALL SELECT CAST(trial_id AS VARCHAR), 'timing', 'convergence_speed', round(convergence_speed, 6) FROM timed""",
)
def a12_model(spark, sf_dir):
    path = scratch_path(spark, "summary")
    sinks.write_model_summary(fx.trial_table(spark, sf_dir), path)
    timing = F.when(F.col("section") == "timing", F.round("value", 6)).otherwise(F.col("value"))
    return spark.read.parquet(path).select("key", "section", "metric", timing.alias("value"))


def _summary_sql(table: str, refined: bool) -> str:
    """The tuning summary as SQL: overall, best trials, levels."""
    parameters = trials.HYPER_PARAMETERS if refined else ("encoding_dim", "num_layers")
    criteria = [c for c in trials.CRITERIA if not refined or c[0] != "best_improvement"]
    settings = ("learning_rate", "batch_size", "dropout_rate") if refined else ()
    parts = [
        f"SELECT 'overall' AS section, 'all' AS key, '{name}' AS metric, CAST({value} AS DOUBLE) AS value FROM {table}"
        for name, value in (
            ("models", "count(*)"), ("mse_min", "min(mse)"), ("mse_max", "max(mse)"),
            ("r2_min", "min(r2_score)"), ("r2_max", "max(r2_score)"),
            ("improvement_min", "min(improvement_ratio)"), ("improvement_max", "max(improvement_ratio)"),
        )
    ]
    quality = (("mse", "mse"), ("r2", "r2_score"), ("improvement", "improvement_ratio"))
    speed = (
        ("best_epoch", "best_epoch"), ("total_epochs", "total_epochs"), ("mse", "mse"),
        ("training_time", "total_training_time"),
    )
    for name, metric, largest in criteria:
        row = f"""(SELECT * FROM {table} WHERE {metric} IS NOT NULL
          ORDER BY {metric} {'DESC' if largest else ''}, trial_id LIMIT 1)"""
        columns = [("encoding_dim", "encoding_dim"), ("layer_config", "NULL"), *((c, c) for c in settings)]
        columns += speed if name == "fastest_convergence" else quality
        parts += [
            f"SELECT '{name}', CAST(trial_id AS VARCHAR), '{m}', CAST({c} AS DOUBLE) FROM {row}"
            for m, c in columns
        ]
    for p in parameters:
        parts += [
            f"SELECT 'by_{p}', CAST(CAST({p} AS DOUBLE) AS VARCHAR), '{m}', CAST({c} AS DOUBLE) FROM {table} GROUP BY {p}"
            for m, c in (
                ("count", "count(*)"), ("avg_mse", "round(avg(mse), 12)"),
                ("avg_r2", "round(avg(r2_score), 8)"), ("best_mse", "min(mse)"),
            )
        ]
    return " UNION ALL ".join(parts)


def _keyed(found):
    """Level keys as plain numbers, values rounded."""
    level = F.col("section").startswith("by_")
    key = F.when(level, F.col("key").cast("double").cast("decimal(18,6)").cast("string")).otherwise(F.col("key"))
    return found.select("section", key.alias("key"), "metric", (F.round("value", 8) + 0.0).alias("value"))


def _keyed_sql(body: str) -> str:
    return f"""SELECT section, CASE WHEN section LIKE 'by\\_%' ESCAPE '\\'
       THEN CAST(CAST(key AS DECIMAL(18, 6)) AS VARCHAR) ELSE key END AS key,
       metric, round(value, 8) + 0.0 AS value FROM ({body}) t"""


@query("a12_tuning_summary", f"WITH {fx.TRIALS} {_keyed_sql(_summary_sql('timed', False))}")
def a12_tuning(spark, sf_dir):
    return _keyed(report.tuning_summary(fx.trial_table(spark, sf_dir)))


@query("a12_refined_summary", f"WITH {fx.REFINED} {_keyed_sql(_summary_sql('refined', True))}")
def a12_refined(spark, sf_dir):
    return _keyed(report.tuning_summary(fx.refined_table(spark, sf_dir), refined=True))


@query(
    "a12_number_formats",
    """SELECT l_returnflag AS key, format('{:.6f}', round(avg(l_discount), 6)) AS six,
       format('{:.2f}%', round(sum(l_tax) / sum(l_quantity) * 100, 2)) AS share,
       format('{:,}', count(*)) AS grouped FROM lineitem GROUP BY l_returnflag""",
)
def a12_formats(spark, sf_dir):
    line = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("key")).agg(
        F.avg("l_discount").alias("d"), (F.sum("l_tax") / F.sum("l_quantity")).alias("t"), F.count("*").alias("n")
    )
    return line.select(
        "key", fixed(F.col("d")).alias("six"), percent(F.col("t")).alias("share"), grouped(F.col("n")).alias("grouped")
    )


@query(
    "e11_recommendations",
    f"""WITH {fx.REFINED}, bal AS {_BALANCED.format(t='refined')}, fast AS {_FASTEST.format(t='refined')},
top AS (SELECT * FROM refined ORDER BY mse, trial_id LIMIT 1),
g AS ({_group_sql('refined', trials.HYPER_PARAMETERS)}),
impact AS (SELECT parameter, arg_min(level, {{'a': avg_mse, 'l': level}}) AS b,
  arg_max(level, {{'a': avg_mse, 'l': level}}) AS w FROM g GROUP BY parameter),
runs AS (SELECT min(mse) FILTER (WHERE source = 'original') AS o, min(mse) FILTER (WHERE source = 'refined') AS r FROM combined),
picked AS (SELECT 'overall' AS section, * FROM top UNION ALL SELECT 'balanced', * FROM bal
  UNION ALL SELECT 'fastest_usable', * FROM fast)
SELECT section, CAST(trial_id AS VARCHAR) AS key, m.metric,
       CASE m.metric WHEN 'encoding_dim' THEN encoding_dim WHEN 'learning_rate' THEN learning_rate
         WHEN 'batch_size' THEN batch_size WHEN 'dropout_rate' THEN dropout_rate WHEN 'mse' THEN mse
         ELSE NULL END AS value
FROM picked CROSS JOIN (SELECT unnest(['encoding_dim', 'layer_config', 'learning_rate', 'batch_size',
  'dropout_rate', 'mse']) AS metric) m
UNION ALL SELECT 'overall', CAST(trial_id AS VARCHAR), 'r2', r2_score FROM top
UNION ALL SELECT 'overall', CAST(trial_id AS VARCHAR), 'verdict', NULL FROM top
UNION ALL SELECT section, CAST(trial_id AS VARCHAR), 'training_time', round(total_training_time, 9) FROM picked
  WHERE section <> 'overall'
UNION ALL SELECT 'impact', parameter, 'best_level', b FROM impact
UNION ALL SELECT 'impact', parameter, 'worst_level', w FROM impact
UNION ALL SELECT 'comparison', 'runs', 'original_mse', o FROM runs
UNION ALL SELECT 'comparison', 'runs', 'refined_mse', r FROM runs
UNION ALL SELECT 'comparison', 'runs', 'improvement', NULL FROM runs""",
)
def e11(spark, sf_dir):
    found = report.recommendations(
        fx.refined_table(spark, sf_dir), fx.combined_table(spark, sf_dir), refined=True
    )
    rounded = F.when(F.col("metric") == "training_time", F.round("value", 9)).otherwise(F.col("value"))
    return found.select("section", "key", "metric", rounded.alias("value"))


@query(
    "e11_recommendations_original",
    f"""WITH {fx.TRIALS}, bal AS {_BALANCED.format(t='timed')}, fast AS {_FASTEST.format(t='timed')},
top AS (SELECT * FROM timed ORDER BY mse, trial_id LIMIT 1),
good AS (SELECT * FROM timed ORDER BY r2_score DESC, trial_id LIMIT 1),
g AS ({_group_sql('timed', ('encoding_dim', 'num_layers'))}),
impact AS (SELECT parameter, arg_min(level, {{'a': avg_mse, 'l': level}}) AS b,
  arg_max(level, {{'a': avg_mse, 'l': level}}) AS w FROM g GROUP BY parameter),
c AS (SELECT corr(total_training_time, num_layers) > 0.5 AS l, corr(total_training_time, encoding_dim) > 0.5 AS d FROM timed),
picked AS (SELECT 'overall' AS section, * FROM top UNION ALL SELECT 'balanced', * FROM bal
  UNION ALL SELECT 'fastest_usable', * FROM fast)
SELECT section, CAST(trial_id AS VARCHAR) AS key, 'encoding_dim' AS metric, CAST(encoding_dim AS VARCHAR) AS text FROM picked
UNION ALL SELECT section, CAST(trial_id AS VARCHAR), 'layer_config',
  '[' || array_to_string(layer_config, ', ') || ']' FROM picked
UNION ALL SELECT section, CAST(trial_id AS VARCHAR), 'mse', printf('%.6f', mse) FROM picked
UNION ALL SELECT 'overall', CAST(trial_id AS VARCHAR), 'r2', printf('%.6f', r2_score) FROM top
UNION ALL SELECT 'overall', CAST(t.trial_id AS VARCHAR), 'verdict', CASE WHEN t.encoding_dim = s.encoding_dim
  AND t.num_layers = s.num_layers THEN 'optimal for both mse and r2' ELSE 'lowest mse' END FROM top t, good s
UNION ALL SELECT section, CAST(trial_id AS VARCHAR), 'training_time', printf('%.2f seconds', total_training_time)
  FROM picked WHERE section <> 'overall'
UNION ALL SELECT 'balanced', NULL, 'none', 'no configuration found' WHERE (SELECT count(*) FROM bal) = 0
UNION ALL SELECT 'fastest_usable', NULL, 'none', 'no configuration found' WHERE (SELECT count(*) FROM fast) = 0
UNION ALL SELECT 'impact', parameter, 'best_level', CAST(b AS VARCHAR) FROM impact
UNION ALL SELECT 'impact', parameter, 'worst_level', CAST(w AS VARCHAR) FROM impact
UNION ALL SELECT 'training_time', 'all', 'grows_with_layers', CAST(l AS VARCHAR) FROM c
UNION ALL SELECT 'training_time', 'all', 'grows_with_dim', CAST(d AS VARCHAR) FROM c""",
)
def e11_original(spark, sf_dir):
    """The texts of the report, number formats included."""
    found = report.recommendations(fx.trial_table(spark, sf_dir))
    return found.select("section", "key", "metric", "text")


@query(
    "b18_time_by_complexity",
    f"WITH {fx.TRIALS} SELECT total_params, round(total_training_time, 6) AS total_training_time, "
    "encoding_dim, num_layers FROM timed",
)
def b18_time(spark, sf_dir):
    return _rounded(report.time_by_complexity(fx.trial_table(spark, sf_dir)), 6, "total_training_time")


@query(
    "b18_error_by_convergence",
    f"WITH {fx.TRIALS} SELECT round(convergence_speed, 9) AS convergence_speed, mse, encoding_dim, num_layers FROM timed",
)
def b18_error(spark, sf_dir):
    return _rounded(report.error_by_convergence(fx.trial_table(spark, sf_dir)), 9, "convergence_speed")


@query("b18_loss_series", f"WITH {fx.HISTORY} SELECT trial_id, epoch, loss, val_loss FROM history")
def b18_loss(spark, sf_dir):
    return report.loss_series(fx.history(spark, sf_dir))


@query(
    "b18_epoch_time_series",
    f"WITH {fx.HISTORY} SELECT trial_id, epoch, round(epoch_seconds, 9) AS epoch_seconds FROM history",
)
def b18_epochs(spark, sf_dir):
    return _rounded(report.epoch_time_series(fx.history(spark, sf_dir)), 9, "epoch_seconds")
