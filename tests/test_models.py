"""Inference, training and the plans built on them."""

import numpy as np
import pytest
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from broadloom.operators import layers, network, scalers, training
from broadloom.operators import matrix as m
from broadloom.plans import encoding, scaling, selection, tuning
from broadloom.queries import fixtures as fx
from broadloom.session import materialize, scratch_path
from broadloom.sources import artifacts, tables
from broadloom.streaming.encode import encode_stream, write_stream


@pytest.fixture(scope="module")
def scaled(spark, sf_dir):
    matrix, _ = tuning.scale_for_training(fx.matrix(spark, sf_dir), "standard")
    return materialize(matrix, "scaled")


@pytest.fixture(scope="module")
def fitted(scaled):
    configs = [
        training.Config(1, 8, (32,), learning_rate=0.005, dropout_rate=0.0),
        training.Config(2, 4, (16, 8), learning_rate=0.005, dropout_rate=0.1),
    ]
    return training.fit_grid(scaled, configs, epochs=6, seed=3, workers=4)


# --- layer tables ---------------------------------------------------------


def layer_table(spark, rows):
    return spark.createDataFrame(rows, "model string, layer_idx int, name string, kind string, units int")


def test_bottleneck_rules(spark):
    table = layer_table(
        spark,
        [
            ("a", 0, "input", "input", 9), ("a", 1, "Dense", "dense", 8), ("a", 2, "dense_1", "dense", 3),
            ("a", 3, "dense_2", "dense", 3), ("a", 4, "bn", "norm", 1),
            ("b", 0, "input", "input", 9), ("b", 1, "bn", "norm", 5), ("b", 2, "out", "other", 7),
            # A hidden layer narrower than the encoding is taken for it.
            ("c", 0, "dense", "dense", 4096), ("c", 1, "dense_1", "dense", 256), ("c", 2, "dense_2", "dense", 2048),
        ],
    )
    found = {r["model"]: (r["layer_idx"], r["units"]) for r in layers.detect_bottleneck(table).collect()}
    assert found == {"a": (2, 3), "b": (None, None), "c": (1, 256)}
    found = {r["model"]: (r["layer_idx"], r["fallback"]) for r in layers.bottleneck_or_middle(table).collect()}
    assert found == {"a": (2, False), "b": (1, True), "c": (1, False)}
    last = {r["model"]: r["layer_idx"] for r in layers.layer_with_units(table, 3).collect()}
    assert last == {"a": 3, "b": None, "c": None}


def test_own_models_mark_their_bottleneck(spark):
    table = network.layers_table(spark, [("m", 64, (32, 8), 16)])
    assert encoding.bottleneck_layer(table, "m") == (7, 16)
    assert layers.detect_bottleneck(table).first()["units"] == 8


def test_empty_catalog(spark):
    empty = spark.createDataFrame([], network.LAYERS_SCHEMA)
    assert layers.catalog(empty, empty.select("model")).count() == 0


# --- training -------------------------------------------------------------


def test_gradients():
    """Backpropagation against finite differences of the batch loss."""
    config = training.Config(1, 2, (3,), learning_rate=1e-9, dropout_rate=0.0)
    x = np.random.default_rng(0).normal(size=(6, 4))
    stages = training.initial_stages(config, 4, seed=1)

    def loss(s):
        return training.train_batch(training._copy(s), x, config, 1, np.random.default_rng(0))

    after = training._copy(stages)
    training.train_batch(after, x, config, 1, np.random.default_rng(0))
    for before, moved in zip(stages, after):
        for part in training.TRAINED:
            if part not in before:
                continue
            grad = moved[f"m_{part}"] / (1 - training.ADAM[0])
            for at in list(np.ndindex(before[part].shape))[:4]:
                h, keep = 1e-6, before[part][at]
                before[part][at] = keep + h
                up = loss(stages)
                before[part][at] = keep - h
                down = loss(stages)
                before[part][at] = keep
                assert grad[at] == pytest.approx((up - down) / (2 * h), rel=1e-3, abs=1e-6)


def test_loss_falls(fitted):
    for p in fitted.progress:
        losses = [h[1] for h in p.history]
        assert losses[-1] < losses[0]
        assert len(losses) == 6


def test_training_repeats_itself(scaled):
    config = [training.Config(1, 4, (8,))]
    runs = [training.fit_grid(scaled, config, epochs=1, seed=9, workers=3) for _ in range(2)]
    a, b = (r.progress[0].stages[0]["kernel"] for r in runs)
    np.testing.assert_allclose(a, b, rtol=1e-12)


def test_trial_rows(scaled, fitted):
    rows = {r["trial_id"]: r for r in training.evaluate(scaled, fitted).collect()}
    assert sorted(rows) == [1, 2]
    for r in rows.values():
        assert r["rmse"] == pytest.approx(r["mse"] ** 0.5)
        assert r["improvement_ratio"] == pytest.approx(1 - r["mse"] / r["baseline_mse"])
        assert 1 <= r["best_epoch"] <= r["total_epochs"] == 6
        assert r["total_params"] == training.Config(1, r["encoding_dim"], tuple(r["layer_config"])).params(64)
    held = training.evaluate(scaled, fitted, metrics_on="validation").first()
    assert held["mse"] > 0


def test_no_better_than_the_linear_bound(scaled, fitted):
    """No network with 8 units beats the best rank-8 reconstruction of all rows by much."""
    vectors = scaled.select("row_id", "features", array_to_vector("features").alias("v"))
    model = PCA(k=8, inputCol="v", outputCol="z").fit(vectors)
    basis = model.pc.toArray()
    x = np.array([r["features"] for r in scaled.orderBy("row_id").collect()])
    bound = ((x - x @ basis @ basis.T) ** 2).mean()
    trained = training.evaluate(scaled, fitted).filter("trial_id = 1").first()["mse"]
    assert trained > bound * 0.9


def test_patience(scaled):
    stuck = training.Config(1, 2, (4,), learning_rate=0.0)
    run = training.fit_grid(scaled, [stuck], epochs=9, patience=2, workers=2)
    # With a zero rate only the normalisation statistics move.
    assert len(run.progress[0].history) <= 9
    assert run.progress[0].best is not None


def test_size_guard(scaled):
    with pytest.raises(network.ModelTooLarge):
        training.fit_grid(scaled, [training.Config(1, 64, (4096,))], max_params=1000)


@pytest.mark.parametrize("keys", [[2**60 + 3 * i for i in range(10)], [f"k{i:02}" for i in range(10)], [None, *range(9)]])
def test_split_by_order_in_the_type_of_the_key(spark, keys):
    kind = "string" if isinstance(keys[-1], str) else "long"
    rows = [(k, [float(i)]) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows[::-1], f"row_id {kind}, features array<double>")
    later = training.split_by_order(df, "row_id").filter("is_validation").collect()
    assert sorted(r["row_id"] for r in later) == keys[8:]


def test_split_by_order_with_equal_keys(spark):
    df = spark.createDataFrame([(i // 7, [float(i)]) for i in range(100)], "row_id long, features array<double>")
    split = training.split_by_order(df, "row_id")
    later = [r["row_id"] for r in split.filter("is_validation").collect()]
    assert len(later) == 20 and min(later) == 80 // 7


def test_larger_networks_report_more_time(scaled):
    sizes = [training.Config(1, 2, (4,)), training.Config(2, 64, (512, 256))]
    run = training.fit_grid(scaled, sizes, epochs=2, workers=2)
    small, large = (sum(h[3] for h in p.history) for p in run.progress)
    assert 0 < small < large


def test_no_validation_rows(scaled):
    with pytest.raises(ValueError, match="no validation rows"):
        training.fit_grid(scaled.limit(3), [training.Config(1, 2, (4,))], epochs=1, workers=1, share=0.00011)
    run = training.fit_grid(scaled, [training.Config(1, 2, (4,))], epochs=2, workers=2, share=0.0)
    assert [h[2] for h in run.progress[0].history] == [None, None]


def test_a_first_loss_that_is_no_number_is_not_kept(scaled, monkeypatch):
    losses = iter([{1: (float("nan"), 0.1)}, {1: (0.5, 0.1)}, {1: (0.4, 0.1)}])
    monkeypatch.setattr(training, "_losses", lambda rows, models: next(losses))
    run = training.fit_grid(scaled, [training.Config(1, 2, (4,))], epochs=3, workers=2)
    assert run.progress[0].best[0] == 0.4


def test_large_parameters_need_no_key_and_no_exchange(spark, scaled, fitted):
    model = "trial_1"
    same_key = scaled.withColumn("row_id", F.lit(1))
    args = (scalers.empty_params(spark), None, fitted.layers(spark), fitted.weights(spark), model)
    encoded = encoding.encode_matrix(same_key, *args, max_params=50)
    assert "Exchange" not in encoded._jdf.queryExecution().executedPlan().toString()
    params = materialize(scalers.fit(scaled, "quantile"), "params")
    ranked = scalers.transform(same_key, params, "quantile", inline_limit=0)
    assert "Exchange" not in ranked._jdf.queryExecution().executedPlan().toString()
    want = encoding.encode_matrix(scaled, *args).orderBy(F.col("encoded")).collect()
    got = encoded.orderBy(F.col("encoded")).collect()
    np.testing.assert_allclose([r["encoded"] for r in got], [r["encoded"] for r in want], rtol=1e-9, atol=1e-12)


# --- storage and encoding -------------------------------------------------


def test_stored_model_encodes_as_in_memory(spark, scaled, fitted):
    path = scratch_path(spark, "model")
    artifacts.save_model(fitted.layers(spark), fitted.weights(spark), path)
    stored_layers, stored_weights = artifacts.load_model(spark, path)
    for p in fitted.progress:
        model = f"trial_{p.config.trial_id}"
        layer, units = encoding.bottleneck_layer(stored_layers, model)
        assert units == p.config.encoding_dim
        params = scalers.empty_params(spark)
        matrix = scaled.withColumn("features", F.col("features").cast("array<float>").cast("array<double>"))
        encoded = encoding.encode_matrix(matrix, params, None, stored_layers, stored_weights, model)
        blocked = encoding.encode_matrix(
            matrix, params, None, stored_layers, stored_weights, model, max_params=50
        )
        x = np.array([r["features"] for r in matrix.orderBy("row_id").collect()])
        stages = p.stages[: len(p.config.layer_config) + 1]
        want = network.run_stages(x, stages, encode=True)
        for df in (encoded, blocked):
            got = np.array([r["encoded"] for r in df.orderBy("row_id").collect()])
            np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)
        assert want.min() >= 0  # the activation, before its normalisation


def test_gate_stops_before_any_work(spark, scaled, fitted, tmp_path):
    params = scalers.fit(scaled, "standard")
    table = m.name_columns(scaled.select("Label", "features"), "features", 64, "f")
    args = (materialize(params, "params"), "standard", fitted.layers(spark), fitted.weights(spark), "trial_1")
    out = str(tmp_path / "enc")
    encoded = encoding.encode_table(table, *args, output=out)
    assert encoded.columns == ["Label", "encoded", "encode_error"]
    assert [c for c in spark.read.parquet(out).columns if c.startswith("encoded_")] == [f"encoded_{i}" for i in range(8)]
    with pytest.raises(ValueError, match="expected 64 features, found 63"):
        encoding.encode_table(table.drop("f0"), *args)


def test_bad_rows_are_flagged(spark, matrix_of):
    matrix = spark.createDataFrame(
        [(0, [1.0, 2.0]), (1, [1.0]), (2, None), (3, [3.0, -4.0])], "row_id long, features array<double>"
    )
    stages = [{"kernel": np.eye(2), "bias": np.zeros(2), "relu": True}]
    rows = {r["row_id"]: r for r in network.encode(matrix, stages).collect()}
    assert rows[0]["encoded"] == [1.0, 2.0] and rows[0]["encode_error"] is None
    assert rows[3]["encoded"] == [3.0, 0.0]
    assert rows[1]["encoded"] is None and "expected 2 features, found 1" in rows[1]["encode_error"]
    assert rows[2]["encoded"] is None and "null" in rows[2]["encode_error"]


def test_whole_run(spark, sf_dir):
    """Tune two scalers into one table, then select."""
    path, other = scratch_path(spark, "original"), scratch_path(spark, "refined")
    matrix = fx.matrix(spark, sf_dir)
    configs = tuning.grid_configs((2, 4), ((8,),))
    run, _ = tuning.tune(matrix, "minmax", configs, path, epochs=1)
    tuning.tune(matrix, "minmax", tuning.grid_configs((2, 4), ((8,),), learning_rate=0.01), other, epochs=1)
    assert tables.read_trials(spark, path).count() == 2
    for df in selection.analyse(spark, path).values():
        df.collect()
    refined = selection.analyse_refined(spark, other, path)
    assert refined["top_models"].count() == 4
    assert refined["recommendations"].filter("section = 'comparison'").count() == 3
    alone = selection.analyse_refined(spark, other, scratch_path(spark, "absent"))
    assert "top_models" not in alone
    scaled, _ = tuning.scale_for_training(matrix, "minmax")
    bins = tuning.error_histograms(scaled, run)
    assert bins.groupBy("trial_id", "stat").agg(F.sum("count").alias("n")).filter("n = 64").count() == 4


def test_scaling_analysis_isolates_failures(spark, sf_dir, tmp_path):
    out = str(tmp_path / "bins")
    status = scaling.analyse_scaling(fx.matrix(spark, sf_dir), out, ["standard", "broken", "maxabs"], bins=10)
    errors = {r["scaler"]: r["error"] for r in status.collect()}
    assert errors["standard"] is None and errors["maxabs"] is None and "broken" in errors["broken"]
    stored = spark.read.parquet(out)
    assert {(r["scaler"], r["n"]) for r in stored.groupBy("scaler").agg(F.sum("count").alias("n")).collect()} == {
        ("standard", 192), ("maxabs", 192)
    }


def test_histograms_of_every_feature(spark, sf_dir):
    bins = scaling.scaling_histograms(fx.matrix(spark, sf_dir), ["standard", "maxabs"], bins=7)
    sums = bins.groupBy("scaler", "stat").agg(F.sum("count").alias("n"), F.count("*").alias("b")).collect()
    assert len(sums) == 6 and {(r["n"], r["b"]) for r in sums} == {(64, 7)}


# --- streaming ------------------------------------------------------------


def test_stream_equals_batch(spark, sf_dir):
    source = scratch_path(spark, "stream-in")
    fx.matrix(spark, sf_dir).repartition(3).write.parquet(source)
    model_layers, weights = fx.class_model(spark, sf_dir)
    params = materialize(scalers.fit(fx.matrix(spark, sf_dir), "robust"), "params")
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    out = scratch_path(spark, "stream-out")
    query = write_stream(
        encode_stream(stream, params, "robust", model_layers, weights, fx.CLASS_MODEL), out,
        scratch_path(spark, "stream-state"),
    )
    query.awaitTermination(120)
    batch = encoding.encode_matrix(
        fx.matrix(spark, sf_dir), params, "robust", model_layers, weights, fx.CLASS_MODEL
    )
    streamed = spark.read.parquet(out).orderBy("row_id").collect()
    direct = batch.orderBy("row_id").collect()
    assert [r["row_id"] for r in streamed] == [r["row_id"] for r in direct]
    # The last bit of a product depends on how many rows were multiplied at once.
    np.testing.assert_allclose(
        [r["encoded"] for r in streamed], [r["encoded"] for r in direct], rtol=1e-12, atol=1e-12
    )
    with pytest.raises(ValueError):
        encode_stream(batch, params, "robust", model_layers, weights, fx.CLASS_MODEL)
