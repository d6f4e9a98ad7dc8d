"""What the physical plans must and must not contain."""

import re

import numpy as np
import pytest

import __spark_entry__ as entry
from broadloom.operators import matrix as m
from broadloom.operators import network, scalers, stats
from broadloom.plans import encoding
from broadloom.queries import fixtures as fx
from broadloom.session import small_side

QUERIES = entry.queries()
NATIVE = [n for n in QUERIES if not re.match(r"g0[1-7]|a11|b09|b10|b19|c06|d22_scaling_histograms_all", n)]


def plan_of(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", ["c01_standard_scaler", "d05_reconstruction_error", "d15_group_summary", "d19_box_stats", "e04_balanced_best", "e11_recommendations", "h03_verdict"])
def test_native_operators_stay_in_the_jvm(spark, sf_dir, name):
    assert name in NATIVE
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInArrow|InPandas", plan)


@pytest.mark.parametrize("name", ["d22_scaling_histograms", "e04_balanced_best", "d05_reconstruction_error", "f02_search_grid", "c10_scaler_resolution"])
def test_no_cartesian_product(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)


@pytest.mark.parametrize("name", ["g05_encode", "g04_reconstruct", "b04_null_fill", "b08_positional_trim"])
def test_row_local_work_does_not_shuffle(spark, sf_dir, name):
    assert "Exchange" not in plan_of(QUERIES[name](spark, sf_dir))


def test_scaling_shuffles_parameters_only(spark, sf_dir):
    plan = plan_of(QUERIES["c01_standard_scaler"](spark, sf_dir))
    outside = re.sub(r"Subquery.*?(?=\n\S|\Z)", "", plan, flags=re.S)
    assert "hashpartitioning" not in outside


def test_all_linear_scalers_share_two_scans(spark, sf_dir):
    """One scan for the moments and one for the quartiles, whatever the scalers."""
    stats = scalers.scaled_stats(fx.matrix(spark, sf_dir), scalers.LINEAR)
    assert len(re.findall("FileScan", plan_of(stats))) == 2


def test_small_sides_spare_the_large_side_a_shuffle(spark, sf_dir):
    """Counting into bins moves bin counts, never cells."""
    cells = m.to_long(fx.line_matrix(spark, sf_dir))
    plan = plan_of(stats.histogram(cells, "value", 10, ["feature_idx"]))
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    before_scan = plan[: plan.index("lineitem")]
    assert before_scan.rindex("HashAggregate") > before_scan.rindex("Exchange hashpartitioning")


def test_counted_sides_above_the_limit_are_shuffled(spark):
    df = spark.range(10)
    assert small_side(df, 10, limit=9) is df
    assert "broadcast" in small_side(df, 9, limit=9)._jdf.queryExecution().toString().lower()


def test_projection_reaches_the_scan(spark, sf_dir):
    plan = plan_of(QUERIES["a04_projected_scan"](spark, sf_dir))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan


def test_top_per_source_limits_before_the_shuffle(spark, sf_dir):
    assert plan_of(QUERIES["e02_top_per_source"](spark, sf_dir)).count("WindowGroupLimit") >= 1


def test_only_stored_tables_are_discarded(spark, tmp_path):
    import os

    from broadloom.session import discard, materialize

    stored = materialize(spark.range(5).toDF("x"), "short-lived")
    folder = os.path.dirname(stored.inputFiles()[0].removeprefix("file://"))
    other = str(tmp_path / "broadloom" / "kept")
    spark.range(5).write.parquet(other)
    discard(stored)
    discard(spark.read.parquet(other))
    assert not os.path.exists(folder) and os.path.exists(other)


def test_models_of_a_scaler_share_one_scan(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        reads.add(1)
        yield from batches

    rows = [(i, [float(i), float(-i), 1.0]) for i in range(12)] + [(12, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "row_id long, features array<double>").repartition(2)
    matrix = table.mapInArrow(counted, table.schema)
    params = scalers.named(scalers.fit(table.filter("row_id < 12"), "maxabs"), "own")
    model_layers = network.layers_table(spark, [(name, 3, (), 2) for name in ("a", "b", "c", "lost")])
    kernel = np.array([[1.0, 0.0], [0.0, 1.0], [2.0, 3.0]])
    weights = spark.createDataFrame(
        [row for k, name in enumerate("abc") for row in network.weight_rows(name, [{"kernel": kernel * (k + 1), "bias": np.zeros(2)}])],
        network.WEIGHTS_SCHEMA,
    )
    status = encoding.encode_all(
        matrix, params, model_layers, weights, str(tmp_path / "out"), explicit={n: "own" for n in ("a", "b", "c", "lost")}
    )
    found = {r["model"]: r for r in status.collect()}
    assert reads.value == 2
    assert found["lost"]["error"] and found["lost"]["rows"] is None
    for k, name in enumerate("abc"):
        assert (found[name]["rows"], found[name]["failed_rows"], found[name]["error"]) == (13, 1, None)
        for r in spark.read.parquet(found[name]["output"]).collect():
            if r["row_id"] == 12:
                assert r["encode_error"] == "expected 3 features, found 2" and r["encoded_0"] is None
            else:
                want = np.maximum(np.array([r["row_id"] / 11, -r["row_id"] / 11, 1.0]) @ kernel * (k + 1), 0)
                np.testing.assert_allclose([r["encoded_0"], r["encoded_1"]], want, rtol=1e-6)
