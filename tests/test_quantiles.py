"""Exact quantiles on both ways against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadloom.operators import quantiles as module
from broadloom.operators import scalers
from broadloom.operators.quantiles import largest_group, median, quantiles, references

LEVELS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def groups(rng):
    return {
        0: rng.normal(size=501),
        1: np.round(rng.exponential(size=300), 1),
        2: np.full(40, 7.25),
        3: np.array([3.0]),
        4: np.concatenate([np.zeros(400), [1e18, -1e18, 1e-12]]),
        5: 2.0 ** rng.integers(-40, 60, size=250),
        6: np.array([1.0, 2.0, 3.0, 10.0]),
        7: np.array([-1.7e308, 1.7e308, 0.0, 1.0]),
    }


@pytest.fixture(scope="module")
def table(spark):
    data = groups(np.random.default_rng(3))
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    rows += [(0, None), (1, float("nan"))]
    return spark.createDataFrame(rows, "g int, v double"), data


@pytest.mark.parametrize("limit", [10**6, 60, 0])
def test_against_numpy(table, limit):
    df, data = table
    found = {r["g"]: r["q"] for r in quantiles(df, "v", LEVELS, ["g"], group_limit=limit, bins=16).collect()}
    for g, values in data.items():
        with np.errstate(over="ignore", invalid="ignore"):
            want = np.quantile(values, LEVELS)
        if g == 7:
            # The difference of the two extremes overflows in every linear formula.
            assert (found[g][0], found[g][-1]) == (want[0], want[-1])
            continue
        np.testing.assert_allclose(found[g], want, rtol=1e-12, atol=1e-12)


def test_many_levels_agree(table):
    df, data = table
    df = df.filter("g < 7")
    levels = references(40)
    short = {r["g"]: r["q"] for r in quantiles(df, "v", levels, ["g"]).collect()}
    long = {r["g"]: r["q"] for r in quantiles(df, "v", levels, ["g"], group_limit=0).collect()}
    for g in short:
        np.testing.assert_allclose(short[g], long[g], rtol=1e-12)
        np.testing.assert_allclose(short[g], np.quantile(data[g], levels), rtol=1e-12)


def test_known_quartiles(table):
    df, _ = table
    six = df.filter("g = 6")
    assert quantiles(six, "v", [0.25, 0.5, 0.75]).first()["q"] == [1.75, 2.5, 4.75]
    assert quantiles(six, "v", [0.25, 0.5, 0.75], group_limit=0).first()["q"] == [1.75, 2.5, 4.75]
    assert median(six, "v").first()["median"] == 2.5


def test_hot_group_is_narrowed_not_collected(spark):
    """A third of the rows in one group, far above the limit."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("g"),
        ((F.col("id") * 7919) % 10_007).cast("double").alias("v"),
    )
    assert largest_group(df, "v", ["g"]) == 10_000
    exact = {r["g"]: r["q"] for r in quantiles(df, "v", [0.25, 0.5], ["g"]).collect()}
    narrowed = {r["g"]: r["q"] for r in quantiles(df, "v", [0.25, 0.5], ["g"], group_limit=100).collect()}
    assert exact == narrowed


def test_bad_brackets_cost_a_round_but_nothing_else(spark, monkeypatch):
    """With a tiny sample and no safety the brackets miss; the counts notice."""
    monkeypatch.setattr(module, "SAMPLE", 12)
    monkeypatch.setattr(module, "SPREAD", 0.01)
    df = spark.range(20_000).select(
        (F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 10_007).cast("double").alias("v")
    )
    exact = {r["g"]: r["q"] for r in quantiles(df, "v", LEVELS, ["g"]).collect()}
    narrowed = {r["g"]: r["q"] for r in quantiles(df, "v", LEVELS, ["g"], group_limit=50).collect()}
    assert exact == narrowed


def test_empty_input(spark):
    empty = spark.createDataFrame([], "g int, v double")
    assert quantiles(empty, "v", [0.5], ["g"]).count() == 0
    assert quantiles(empty, "v", [0.5], ["g"], group_limit=-1).count() == 0


@pytest.mark.parametrize("limit", [10**6, 5])
@pytest.mark.parametrize("end", [math.inf, -math.inf])
def test_infinite_values_are_an_error(spark, limit, end):
    df = spark.createDataFrame([(float(x),) for x in range(50)] + [(end,), (math.nan,)], "v double")
    with pytest.raises(Exception, match="infinite values in v"):
        quantiles(df, "v", [0.25, 0.5], group_limit=limit).collect()


@pytest.mark.parametrize("kind", scalers.KINDS)
def test_fits_reject_infinite_cells(matrix_of, kind):
    with pytest.raises(Exception, match="infinite value in feature 1"):
        scalers.fit(matrix_of([[1.0, 2.0], [3.0, math.inf], [5.0, 6.0]]), kind).collect()


def test_many_levels_by_narrowing(spark):
    rng = np.random.default_rng(8)
    data = np.concatenate([rng.normal(size=3000), np.zeros(500), rng.pareto(0.5, 500) * 1e6])
    df = spark.createDataFrame([(float(x),) for x in data], "v double")
    levels = references(300)
    got = quantiles(df, "v", levels, group_limit=20).first()["q"]
    np.testing.assert_allclose(got, np.quantile(data, levels), rtol=1e-12)


@pytest.mark.parametrize("levels", [[0.1, 0.5, 0.999], references(100)])
def test_two_scans_of_the_input(spark, levels):
    """Long groups are read twice, whatever else happens reads the stored part inside the brackets."""
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        reads.add(1)
        yield from batches

    table = spark.range(0, 60_000, 1, 3).selectExpr("CAST(id % 4 AS INT) AS g", "CAST((id * 7919) % 60013 AS DOUBLE) AS v")
    df = table.mapInArrow(counted, table.schema)
    found = {r["g"]: r["q"] for r in quantiles(df, "v", levels, ["g"], group_limit=300).collect()}
    assert reads.value == 2 * 3
    for g in range(4):
        values = [float((i * 7919) % 60013) for i in range(g, 60_000, 4)]
        np.testing.assert_allclose(found[g], np.quantile(values, levels), rtol=1e-12)


def test_small_groups_beside_a_long_one(spark):
    """A bracket may be shorter than a rank of a small group, and values may repeat at its edges."""
    rows = [(0, float(i % 977)) for i in range(20_000)] + [(g, float(i * g)) for g in range(1, 30) for i in range(g)]
    df = spark.createDataFrame(rows, "g int, v double")
    want = {g: [v for k, v in rows if k == g] for g in range(30)}
    got = {r["g"]: r["q"] for r in quantiles(df, "v", LEVELS, ["g"], group_limit=50).collect()}
    for g, values in want.items():
        np.testing.assert_allclose(got[g], np.quantile(values, LEVELS), rtol=1e-12)
