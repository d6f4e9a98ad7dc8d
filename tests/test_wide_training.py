import numpy as np
import pytest

from broadloom.operators import blocks, training, wide_training
from broadloom.plans import tuning
from broadloom.sources import tables

CONFIGS = [
    training.Config(1, 3, (8,), learning_rate=0.01, batch_size=10_000, dropout_rate=0.0),
    training.Config(2, 2, (8, 5), learning_rate=0.01, batch_size=10_000, dropout_rate=0.0),
]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 3)) @ rng.normal(size=(3, 17)) + 0.1 * rng.normal(size=(90, 17))
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, features array<double>")


def losses(fitted):
    return {(p.config.trial_id, h[0]): (h[1], h[2]) for p in fitted.progress for h in p.history}


def same(one, two):
    assert set(one) == set(two)
    for key, values in one.items():
        assert values == pytest.approx(two[key], rel=1e-9), key


@pytest.fixture(scope="module")
def wide(rows):
    return wide_training.fit_wide(rows, CONFIGS, epochs=3, block_features=5)


def test_same_losses_as_in_memory(rows, wide):
    """One batch of all rows, so that both take the same steps."""
    held = training.fit_grid(rows, CONFIGS, epochs=3, workers=1)
    same(losses(held), losses(wide))
    assert losses(wide)[1, 3][0] < losses(wide)[1, 1][0]


def test_weights_as_in_memory(spark, rows, wide):
    held = training.fit_grid(rows, CONFIGS, epochs=3, workers=1)
    key = lambda r: (r["model"], r["layer_idx"], r["part"], r["row_idx"])
    want = {key(r): r["w"] for r in held.weights(spark).collect()}
    got = {key(r): r["w"] for r in wide.weights(spark).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        np.testing.assert_allclose(got[k], w, rtol=1e-7, atol=1e-9, err_msg=str(k))
    assert wide.layers(spark).collect() == held.layers(spark).collect()


def test_interrupted_run_goes_on(rows, spark, tmp_path):
    config = [training.Config(1, 3, (8,), learning_rate=0.01, batch_size=30, dropout_rate=0.2)]
    options = dict(block_features=6, patience=2)
    whole = wide_training.fit_wide(rows, config, epochs=3, **options)
    run = str(tmp_path / "run")
    wide_training.fit_wide(rows, config, epochs=1, run_dir=run, **options)
    # A table of the next step that no commit names, as a lost driver leaves it behind.
    (tmp_path / "run" / "first-4" / "kind=state").mkdir(parents=True)
    resumed = wide_training.fit_wide(rows, config, epochs=3, run_dir=run, **options)
    same(losses(whole), losses(resumed))
    assert whole.progress[0].steps == resumed.progress[0].steps > 3
    kept = {p.name for p in (tmp_path / "run").iterdir()}
    named = {path.rsplit("/", 1)[1] for path in wide_training._named(resumed.trials)}
    assert kept == named | {"cells", "commits"}


def test_tuning_above_the_limit(rows, spark, tmp_path):
    configs = [training.Config(1, 3, (8,), batch_size=10_000, dropout_rate=0.0)]
    found = []
    for limit in (10, 1 << 30):
        path = str(tmp_path / f"trials-{limit}")
        tuning.tune(rows, "standard", configs, path, epochs=2, max_params=limit, **({} if limit == 10 else {"workers": 1}))
        found.append(tables.read_trials(spark, path).collect()[0].asDict())
    timed = {"total_training_time", "avg_epoch_time"}
    for name, value in found[1].items():
        if name not in timed:
            assert found[0][name] == (pytest.approx(value, rel=1e-6) if isinstance(value, float) else value), name


def test_no_rows(rows, spark):
    empty = rows.filter("row_id < 0")
    with pytest.raises((ValueError, IndexError, TypeError)):
        wide_training.fit_wide(empty, CONFIGS, epochs=1)


def test_grouped_over_batch_borders():
    import pyarrow as pa

    keys = [1, 1, 1, 2, 3, 3, 5, 5, 5, 5]
    for cut in ([3, 7], [1, 2, 3, 4], [5, 5, 6], []):
        edges = [0, *cut, len(keys)]
        batches = [pa.RecordBatch.from_pydict({"k": pa.array(keys[a:b], pa.int64())}) for a, b in zip(edges, edges[1:])]
        got = [[k for part in run for k in part.column(0).to_pylist()] for run in blocks.grouped(iter(batches), "k")]
        assert got == [[1] * 3, [2], [3] * 2, [5] * 4]


def test_interrupted_grid_in_memory_goes_on(rows, tmp_path):
    configs = [training.Config(i, 3, (8,), learning_rate=rate, batch_size=16) for i, rate in ((1, 0.01), (2, 3.0))]
    options = dict(patience=1, workers=2)
    whole = training.fit_grid(rows, configs, epochs=5, **options)
    run = str(tmp_path / "grid")
    training.fit_grid(rows, configs, epochs=2, run_dir=run, **options)
    resumed = training.fit_grid(rows, configs, epochs=5, run_dir=run, **options)
    same(losses(whole), losses(resumed))
    for one, two in zip(whole.progress, resumed.progress):
        assert (one.stopped, one.waited, one.best[0]) == (two.stopped, two.waited, pytest.approx(two.best[0]))
        np.testing.assert_allclose(one.stages[0]["kernel"], two.stages[0]["kernel"], rtol=1e-9)


def test_error_sums_equal_the_exploded_errors(rows):
    from broadloom.operators import metrics

    fitted = training.fit_grid(rows, CONFIGS, epochs=1, workers=1)
    key = lambda r: (r["trial_id"], r["feature_idx"])
    want = metrics.per_feature(training.predictions(rows, fitted.models()), ["trial_id"])
    got = training.trial_errors(rows.repartition(5), fitted.models())
    assert got.columns == want.columns
    found = {key(r): r for r in got.collect()}
    for r in want.collect():
        assert tuple(found[key(r)]) == pytest.approx(tuple(r), rel=1e-9)


def test_jobs_append_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from broadloom.sources import sinks

    path = str(tmp_path / "trials")
    given = lambda k: spark.createDataFrame([(k, 0.5), (k, 0.25)], "trial_id int, mse double")
    with ThreadPoolExecutor(4) as pool:
        added = list(pool.map(lambda k: sinks.append_trials(given(k), path, job=f"job {k}"), [1, 2, 3, 4]))
    assert added == [True] * 4
    assert sinks.append_trials(given(2), path, job="job 2") is False
    sinks.append_trials(given(9), path)
    assert sorted(r["trial_id"] for r in spark.read.parquet(path).collect()) == [1, 1, 2, 2, 3, 3, 4, 4, 9, 9]
    assert not [p for p in (tmp_path / "trials").iterdir() if p.name.startswith("_staged")]


def test_large_arrays_do_not_pass_the_driver(spark, monkeypatch):
    from pyspark.sql import functions as F

    from broadloom.operators import held

    rows = spark.range(1000).select("id", F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.col("id") * 7.0 + k).alias("w"))
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toLocalIterator", None)
    mapped = held.hold(rows.repartition(5), "id", "w", limit=10)
    assert isinstance(mapped, held.MappedArray) and len(mapped.files) == 5
    want = np.arange(7000.0).reshape(1000, 7)
    np.testing.assert_array_equal(mapped.open(), want)
    np.testing.assert_array_equal(np.ones((2, 1000)) @ mapped, np.ones((2, 1000)) @ want)
    again = spark.range(4).repartition(4).mapInPandas(
        lambda parts: (p.assign(id=int(mapped.open()[999, 6])) for p in parts), "id long"
    )
    assert {r["id"] for r in again.collect()} == {6999}
