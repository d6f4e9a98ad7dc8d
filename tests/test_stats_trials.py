"""Histograms, metrics, trial selection and histories on hand-made cases."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from broadloom.operators import history, metrics, report, stats, trials
from broadloom.queries import fixtures as fx


def bins_of(spark, values, bins):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    rows = stats.histogram(df, "v", bins).orderBy("bin").collect()
    return [r["count"] for r in rows], [r["bin_start"] for r in rows] + [rows[-1]["bin_end"]]


def test_last_bin_is_closed(spark):
    assert bins_of(spark, [1, 2, 10], 3)[0] == [2, 0, 1]


def test_single_value_is_widened(spark):
    counts, edges = bins_of(spark, [5, 5], 3)
    assert counts == [0, 2, 0]
    np.testing.assert_allclose(edges, [4.5, 4.8333333333, 5.1666666667, 5.5])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.floats(-1e6, 1e6, allow_subnormal=False), min_size=1, max_size=60),
    st.integers(1, 40),
)
def test_histogram_like_numpy(spark, values, bins):
    values = [round(v, 3) for v in values]
    want, edges = np.histogram(values, bins)
    got, got_edges = bins_of(spark, values, bins)
    np.testing.assert_allclose(got_edges, edges, rtol=1e-12, atol=1e-9)
    assert sum(got) == len(values)
    # Counts may move only where a value lies on an edge up to rounding.
    on_edge = sum(bool(np.isclose(edges[1:-1], v, rtol=1e-12, atol=1e-9).any()) for v in values)
    assert np.abs(np.array(got) - want).sum() <= 2 * on_edge


def test_nan_is_not_counted(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "v double")
    assert sum(r["count"] for r in stats.histogram(df, "v", 4).collect()) == 2


def test_box_whiskers_are_data(spark):
    values = [1, 2, 3, 4, 5, 6, 7, 8, 50, -40]
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    row = stats.box_stats(df, "v", ["g"]).first()
    q1, q3 = np.quantile(values, [0.25, 0.75])
    inside = [v for v in values if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    assert (row["q1"], row["q3"]) == (q1, q3)
    assert (row["whisker_low"], row["whisker_high"], row["outliers"]) == (min(inside), max(inside), 2)


def test_interval_holds_the_mean(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "ab"[i % 2], float(v)) for i, v in enumerate(rng.normal(10, 2, 200))]
    df = spark.createDataFrame(rows, "trial_id int, g string, v double")
    first = stats.mean_interval(df, "v", ["g"], "trial_id", seed=4).orderBy("g").collect()
    again = stats.mean_interval(df.repartition(5), "v", ["g"], "trial_id", seed=4).orderBy("g").collect()
    for r, s in zip(first, again):
        assert r["low"] < r["mean"] < r["high"]
        # A bootstrap interval of 100 normal values: about 4 standard errors wide.
        assert 0.5 < (r["high"] - r["low"]) / (4 * 2 / math.sqrt(100)) < 1.6
        assert (s["low"], s["high"]) == pytest.approx((r["low"], r["high"]), rel=1e-12)


# --- metrics --------------------------------------------------------------


def recon(spark, x, p):
    rows = [(a, b) for a, b in zip(np.asarray(x, float).tolist(), np.asarray(p, float).tolist())]
    return spark.createDataFrame(rows, "features array<double>, pred array<double>")


def test_metrics_like_numpy(spark):
    rng = np.random.default_rng(8)
    x, noise = rng.normal(size=(60, 7)) * np.arange(1, 8), rng.normal(size=(60, 7)) / 3
    p = x + noise
    row = metrics.summary(metrics.per_feature(recon(spark, x, p))).first()
    per = (noise**2).mean(axis=0) / (np.ptp(x, axis=0) ** 2 + 1e-8)
    base = x.var(axis=0).mean()
    want = {
        "mse": (noise**2).mean(), "rmse": math.sqrt((noise**2).mean()), "mae": np.abs(noise).mean(),
        "r2_score": (1 - (noise**2).sum(axis=0) / (x.var(axis=0) * 60)).mean(),
        "range_mse": per.mean(), "mean_per_feature_range_mse": per.mean(),
        "median_per_feature_range_mse": np.median(per), "baseline_mse": base,
        "improvement_ratio": 1 - (noise**2).mean() / base,
    }
    for name, value in want.items():
        assert row[name] == pytest.approx(value, rel=1e-10), name


@pytest.mark.parametrize("p, r2", [(5.0, 1.0), (4.0, 0.0)])
def test_r2_of_a_constant_feature(spark, p, r2):
    assert metrics.per_feature(recon(spark, [[5], [5]], [[p], [p]])).first()["r2"] == r2


# --- trials ---------------------------------------------------------------

NAN = float("nan")
COLUMNS = (
    "trial_id int, encoding_dim int, num_layers int, layer_config array<int>, mse double, "
    "r2_score double, improvement_ratio double, convergence_speed double, total_training_time double"
)


@pytest.fixture
def table(spark):
    return spark.createDataFrame(
        [
            (1, 64, 1, [4096], 0.5, 0.5, 0.1, 0.9, 10.0),
            (2, 64, 2, [4096, 1024], 0.2, 0.8, NAN, 0.5, 20.0),
            (3, 128, 1, [4096], 0.2, 0.9, 0.7, NAN, 30.0),
            (4, 128, 2, [], NAN, NAN, 0.7, 0.5, 1.0),
        ],
        COLUMNS,
    )


def test_ties_and_nan(table):
    best = {r["criterion"]: r["trial_id"] for r in trials.best_by_each(table).collect()}
    assert best == {"best_mse": 2, "best_r2": 3, "best_improvement": 3, "fastest_convergence": 2}
    assert trials.best(table, "mse").first()["trial_id"] == 2
    assert trials.best(table.filter("trial_id = 4"), "mse").count() == 0
    assert [r["trial_id"] for r in trials.top(table, 3).collect()] == [3, 2, 1]


def test_deepest_layer_of_an_empty_list(table):
    assert trials.prepare(table).filter("trial_id = 4").first()["deepest_layer"] == 0


def test_no_balanced_trial(table):
    assert trials.balanced(table).count() == 0
    rows = report.recommendations(table).filter("section = 'balanced'").collect()
    assert [(r["metric"], r["text"]) for r in rows] == [("none", "no configuration found")]


def test_fastest_usable_uses_the_median(table):
    assert trials.fastest_usable(table).first()["trial_id"] == 2


def test_consensus(table):
    assert not trials.consensus(table).first()["same_config"]


def test_group_summary_counts_add_up(spark, sf_dir):
    table = fx.refined_table(spark, sf_dir)
    sums = trials.group_summary(table).groupBy("parameter").agg(F.sum("count").alias("n")).collect()
    assert {r["parameter"] for r in sums} == set(trials.HYPER_PARAMETERS)
    assert {r["n"] for r in sums} == {25}


def test_comparison_needs_an_original(spark, table):
    assert trials.compare_runs(trials.combine(table, None)).count() == 0
    worse = trials.combine(table.withColumn("mse", F.col("mse") * 2), table)
    assert not trials.compare_runs(worse).first()["improved"]
    zero = trials.combine(table, table.withColumn("mse", F.lit(0.0)))
    row = trials.compare_runs(zero).first()
    assert row["improvement_pct"] is None and row["improved"] is False


def test_grid_and_parameter_count(spark):
    grid = trials.grid(spark).collect()
    assert [r["trial_id"] for r in grid] == list(range(1, 26))
    assert (grid[5]["encoding_dim"], grid[5]["layer_config"]) == (128, [4096])
    one = spark.createDataFrame([([4096], 1024, 97614)], "l array<int>, e int, n int")
    assert one.select(trials.param_count(F.col("l"), F.col("e"), F.col("n"))).first()[0] == 808_186_190


def test_report_formats(table):
    with_epochs = table.withColumns({"best_epoch": F.lit(3), "total_epochs": F.lit(6)})
    rows = {(r["section"], r["metric"]): r["text"] for r in report.tuning_summary(with_epochs).collect()}
    assert rows["overall", "improvement_max"] == "70.00%"
    assert rows["overall", "mse_min"] == "0.200000"
    assert rows["best_mse", "layer_config"] == "[4096, 1024]"
    assert rows["fastest_convergence", "training_time"] == "20.00 seconds"
    assert ("fastest_convergence", "r2") not in rows


def test_single_level_has_no_correlation(table):
    row = trials.time_correlations(table.withColumn("num_layers", F.lit(1))).first()
    assert row["corr_layers"] is None and row["grows_with_layers"] is False


# --- histories ------------------------------------------------------------


def epochs(spark, *series):
    rows = [(t, e + 1, 1.0, float(v), 0.5) for t, vs in enumerate(series) for e, v in enumerate(vs)]
    return spark.createDataFrame(rows, "trial_id int, epoch int, loss double, val_loss double, epoch_seconds double")


def test_early_stop(spark):
    found = history.early_stop(
        epochs(spark, [5, 4, 4.5, 4.2, 4.1, 4.3, 4.4, 1.0], [3.0, 2, 1], [2.0, 2, 2, 2, 2, 2])
    ).orderBy("trial_id").collect()
    assert [(r["stop_epoch"], r["best_epoch"], r["epochs_run"]) for r in found] == [(7, 2, 7), (None, 3, 3), (6, 1, 6)]


def test_best_epoch_is_the_first_minimum(spark):
    row = history.convergence(epochs(spark, [3.0, 1, 2, 1])).first()
    assert (row["best_epoch"], row["total_epochs"], row["convergence_speed"]) == (2, 4, 0.5)
    assert (row["total_training_time"], row["avg_epoch_time"]) == (2.0, 0.5)


def test_level_without_a_mean_is_never_the_best(spark):
    rows = [(1, 16, 0.001, 0.1, 4, 1, 0.5, 0.9), (2, 32, 0.001, 0.1, 4, 1, float("nan"), 0.9), (3, 64, 0.001, 0.1, 4, 1, 0.1, 0.9)]
    frame = spark.createDataFrame(
        rows,
        "trial_id int, batch_size int, learning_rate double, dropout_rate double, encoding_dim int, num_layers int, "
        "mse double, r2_score double",
    )
    impact = {r["parameter"]: r for r in trials.level_impact(frame, ["batch_size"]).collect()}
    assert impact["batch_size"]["best_level"] == 64 and impact["batch_size"]["worst_level"] == 32
