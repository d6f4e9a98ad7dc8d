"""Known answers and properties of the scalers."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadloom.functions.numeric import EDGE, PROBIT_MARGIN, normal_scores, with_yeo_johnson, yeo_johnson
from broadloom.operators import matrix as m
from broadloom.operators import scalers
from broadloom.operators.stats import moments
from broadloom.queries import fixtures as fx
from broadloom.session import materialize


def scaled(matrix, kind, **options):
    params = materialize(scalers.fit(matrix, kind), "params")
    return [r["features"] for r in scalers.transform(matrix, params, kind, **options).orderBy("row_id").collect()]


def yj(x, lam):
    x = np.asarray(x, float)
    log_u, mu = np.log1p(np.abs(x)), np.where(x < 0, 2 - lam, lam)
    safe = np.where(mu == 0, 1.0, mu)
    return np.where(x < 0, -1, 1) * np.where(mu == 0, log_u, np.expm1(safe * log_u) / safe)


def likelihood(x, lam):
    return -len(x) / 2 * np.log(yj(x, lam).var()) + (lam - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x)))


COLUMN = [[1, 5], [2, 5], [3, 5], [10, 5]]


@pytest.mark.parametrize(
    "kind, constant", [("standard", 0.0), ("robust", 0.0), ("maxabs", 1.0), ("minmax", 0.0), ("power", 0.0)]
)
def test_constant_feature(matrix_of, kind, constant):
    assert [r[1] for r in scaled(matrix_of(COLUMN), kind)] == [constant] * 4


def test_known_column(matrix_of):
    matrix = matrix_of(COLUMN)
    x = np.array([1, 2, 3, 10.0])
    np.testing.assert_allclose([r[0] for r in scaled(matrix, "standard")], (x - 4) / 3.5355339059327378)
    np.testing.assert_allclose([r[0] for r in scaled(matrix, "robust")], (x - 2.5) / 3.0)
    np.testing.assert_allclose([r[0] for r in scaled(matrix, "maxabs")], x / 10)
    np.testing.assert_allclose([r[0] for r in scaled(matrix, "minmax")], (x - 1) / 9)
    assert scaled(matrix, "minmax") == scaled(matrix, "minmax_scale")


def test_noise_around_a_constant_is_not_spread(matrix_of):
    rows = [[1e9 + 1e-7 * (i % 2)] for i in range(50)]
    assert max(abs(r[0]) for r in scaled(matrix_of(rows), "standard")) < 1e-6


@pytest.mark.parametrize("kind", scalers.KINDS)
def test_missing_cells_are_skipped_and_kept(matrix_of, kind):
    nan = float("nan")
    rows = [[1, 1], [2, nan], [3, 2], [nan, 3], [10, 9]]
    got = scaled(matrix_of(rows), kind)
    assert math.isnan(got[1][1]) and math.isnan(got[3][0])
    clean = scaled(matrix_of([[1], [2], [3], [10]]), kind)
    if kind != "quantile":  # there the number of quantiles follows the row count
        np.testing.assert_allclose([got[i][0] for i in (0, 1, 2, 4)], [r[0] for r in clean], rtol=1e-9)


def test_single_row(matrix_of):
    for kind in scalers.KINDS:
        assert len(scaled(matrix_of([[4.0, 0.0]]), kind)) == 1


def test_ranges(spark, sf_dir):
    matrix = fx.matrix(spark, sf_dir)
    unit = np.array(scaled(matrix, "minmax"))
    assert unit.min() >= 0 and unit.max() <= 1 + 1e-12
    signed = np.array(scaled(matrix, "maxabs"))
    assert np.abs(signed).max() <= 1


def test_zero_stays_zero(matrix_of):
    assert scaled(matrix_of([[0, 0], [4, -2], [2, 0]]), "maxabs") == [[0, 0], [1, -1], [0.5, 0]]


@pytest.mark.parametrize("limit", [10**6, 3])
def test_value_counts_give_the_same_fit(matrix_of, limit):
    rng = np.random.default_rng(11)
    data = np.column_stack([rng.poisson(1, 300), rng.poisson(30, 300) * 1e6, np.full(300, 2), rng.normal(size=300)])
    rows = data.tolist()
    rows[5][0], rows[6][1] = None, float("nan")
    matrix = matrix_of(rows)
    kinds = ["standard", "robust", "maxabs", "minmax", "quantile"]
    key = lambda r: (r["scaler"], r["feature_idx"])
    plain = {key(r): r for r in scalers.fit(matrix, kinds).collect()}
    counted = {key(r): r for r in scalers.fit(matrix, kinds, compress=True, group_limit=limit).collect()}
    assert plain.keys() == counted.keys() and len(plain) == 20
    for at, r in plain.items():
        assert counted[at]["center"] == pytest.approx(r["center"], rel=1e-12)
        assert counted[at]["scale"] == pytest.approx(r["scale"], rel=1e-12)
        if r["quantiles"] is not None:
            np.testing.assert_allclose(counted[at]["quantiles"], r["quantiles"], rtol=1e-12)


# --- power ----------------------------------------------------------------


def test_yeo_johnson_and_derivatives(spark):
    rows = [(x, l) for x in (-3.0, -0.5, 0.0, 0.7, 40.0) for l in (-1.0, -1e-7, 0.0, 0.5, 1.0, 2.0, 2.0000001, 3.0)]
    df = spark.createDataFrame(rows, "x double, l double")
    staged = with_yeo_johnson(df, "x", "l", ("y0", "y1", "y2"))
    h = 1e-4
    for r in staged.withColumn("y", yeo_johnson(F.col("x"), F.col("l"))).collect():
        exact = [yj([r["x"]], r["l"] + d)[0] for d in (-h, 0.0, h)]
        assert r["y"] == pytest.approx(exact[1], rel=1e-6, abs=1e-9)
        assert r["y0"] == pytest.approx(r["y"], rel=1e-12, abs=1e-15)
        assert r["y1"] == pytest.approx((exact[2] - exact[0]) / (2 * h), rel=1e-4, abs=1e-5)
        assert r["y2"] == pytest.approx((exact[2] - 2 * exact[1] + exact[0]) / h**2, rel=1e-2, abs=1e-3)


def test_exponents_maximise_the_likelihood(matrix_of):
    rng = np.random.default_rng(5)
    data = np.column_stack(
        [
            rng.normal(size=400),
            rng.exponential(size=400) ** 2,
            -rng.exponential(size=400),
            rng.poisson(3, size=400),
            (rng.random(400) < 0.02).astype(float),
            rng.normal(1e4, 1, size=400),
        ]
    )
    fitted = {r["feature_idx"]: r for r in scalers.fit(matrix_of(data.tolist()), "power").collect()}
    collapsed = {r["feature_idx"]: r for r in scalers.fit(matrix_of(data.tolist()), "power", compress=True).collect()}
    for j in range(5):
        lam, x = fitted[j]["lambda"], data[:, j]
        assert lam == pytest.approx(collapsed[j]["lambda"], rel=1e-6)
        best = likelihood(x, lam)
        for step in (1e-2, 1e-1, 1.0):
            assert best >= likelihood(x, lam + step) - 1e-9
            assert best >= likelihood(x, lam - step) - 1e-9
        y = yj(x, lam)
        assert fitted[j]["center"] == pytest.approx(y.mean(), rel=1e-6, abs=1e-9)
        assert fitted[j]["scale"] == pytest.approx(y.std(), rel=1e-6)


# --- quantile -------------------------------------------------------------


def test_normal_scores():
    u = np.array([1e-6, 0.01, 0.2, 0.5, 0.77, 0.999, 1 - 1e-6])
    want = [NormalDist().inv_cdf(x) for x in u]
    np.testing.assert_allclose(normal_scores(u), want, rtol=1e-11, atol=1e-15)
    low, high = normal_scores(np.array([0.0, 1.0]))
    assert low == pytest.approx(-5.199337582605575, abs=1e-9) and high == pytest.approx(-low, abs=1e-9)
    assert PROBIT_MARGIN < EDGE


def midrank(x, q):
    """The definition: the mean of the ranks read from below and from above."""
    r = np.linspace(0, 1, len(q))
    return 0.5 * (np.interp(x, q, r) - np.interp(-x, -q[::-1], -r[::-1]))


@pytest.mark.parametrize("limit", [10**6, 0])
def test_uniform_scores_by_definition(spark, matrix_of, limit):
    rng = np.random.default_rng(2)
    data = np.column_stack([rng.poisson(2, 1500), rng.normal(size=1500), np.zeros(1500)])
    matrix = matrix_of(data.tolist())
    got = np.array(scaled(matrix, "quantile", normal=False, inline_limit=limit))
    for j in range(2):
        q = np.quantile(data[:, j], np.linspace(0, 1, 1000))
        want = midrank(data[:, j].astype(float), q)
        want[data[:, j] == q[0]], want[data[:, j] == q[-1]] = 0.0, 1.0
        np.testing.assert_allclose(got[:, j], want, atol=1e-9)
    assert set(got[:, 2]) == {0.0}


def test_new_data_outside_the_fitted_range(matrix_of):
    params = materialize(scalers.fit(matrix_of([[i] for i in range(11)]), "quantile"), "params")
    out = scalers.transform(matrix_of([[-5], [5], [99]]), params, "quantile", normal=False)
    assert [r["features"][0] for r in out.orderBy("row_id").collect()] == [0.0, 0.5, 1.0]


# --- comparison, storage, resolution --------------------------------------


@pytest.mark.parametrize("limit", [10**7, 0])
def test_comparison_equals_scaling_then_measuring(spark, sf_dir, limit):
    matrix = fx.matrix_with_constant(spark, sf_dir)
    short = {
        (r["scaler"], r["stat"], r["feature_idx"]): r["value"]
        for r in scalers.scaled_stats(matrix, inline_limit=limit).collect()
    }
    for kind in scalers.KINDS:
        params = materialize(scalers.fit(matrix, kind), "params")
        cells = m.to_long(scalers.transform(matrix, params, kind))
        for r in moments(cells).collect():
            at = r["feature_idx"]
            assert short[kind, "range", at] == pytest.approx(r["vmax"] - r["vmin"], abs=1e-6)
            assert short[kind, "mean", at] == pytest.approx(r["mean"], abs=1e-6)
            assert short[kind, "std", at] == pytest.approx(math.sqrt(r["var"]), abs=1e-6)


def test_join_transform_equals_inline(spark, sf_dir):
    matrix = fx.matrix_with_nulls(spark, sf_dir)
    for kind in ("robust", "power"):
        assert_close(scaled(matrix, kind), scaled(matrix, kind, inline_limit=0))


def assert_close(a, b):
    for left, right in zip(a, b, strict=True):
        for x, y in zip(left, right, strict=True):
            assert (x is None and y is None) or x == pytest.approx(y, rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_features_without_values_shift_no_others(matrix_of, limit):
    fitted = matrix_of([[i, None, i * i, None] for i in range(9)])
    whole = matrix_of([[i, 0, i * i, 0] for i in range(9)])
    new = matrix_of([[3, 5, 7, 1], [None, 1]])
    for kind in ("standard", "power", "quantile"):
        params = [materialize(scalers.fit(m, kind), "params") for m in (fitted, whole)]
        got, want = (
            [r["features"] for r in scalers.transform(new, p, kind, inline_limit=limit).orderBy("row_id").collect()]
            for p in params
        )
        assert got[0][1] is None and got[0][3] is None and got[1] == [None, None]
        assert_close([[got[0][0], got[0][2]]], [[want[0][0], want[0][2]]])


def test_rows_carry_no_parameters(matrix_of):
    """Constants of the plan for few features; for many, one pass of blocks however the result is used."""
    matrix = matrix_of([[1, 2], [3, 5]])
    for kind in ("robust", "power"):
        params = materialize(scalers.fit(matrix, kind), "params")
        for limit in (10**6, 0):
            cells = m.to_long(scalers.transform(matrix, params, kind, inline_limit=limit)).filter("value > 0")
            plan = cells._jdf.queryExecution().executedPlan().toString()
            assert plan.count("MapInArrow") == (limit == 0)
            assert not any(part in plan for part in ("ubquery", "Exchange", "split(", "_p"))


def test_unknown_scaler(spark, matrix_of):
    matrix = matrix_of([[1.0]])
    with pytest.raises(ValueError):
        scalers.fit(matrix, "no_such")
    params = scalers.empty_params(spark)
    with pytest.raises(LookupError):
        scalers.transform(matrix, params, "absent")
    assert scalers.transform(matrix, params, "absent", on_missing="identity").collect() == matrix.collect()


def test_resolution_order(spark):
    models = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "model string")
    available = spark.createDataFrame([("x",), ("b",), ("b_tuned",), ("c_tuned",)], "scaler string")
    explicit = spark.createDataFrame([("a", "x"), ("b", "gone")], "model string, scaler string")
    found = {r["model"]: r["scaler"] for r in scalers.resolve(models, available, explicit, "none").collect()}
    assert found == {"a": "x", "b": "b", "c": "c_tuned", "d": None}
    found = {r["model"]: r["scaler"] for r in scalers.resolve(models, available, explicit, "x").collect()}
    assert found["d"] == "x"
