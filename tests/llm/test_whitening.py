import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadloom.llm import whitening
from broadloom.llm.queries import QUERIES
from tests.llm.conftest import CLASHES

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, most=32):
    """Rows of (key, vector) by plain numpy over the whole list."""
    usable = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64.0 * c) + 1_000_000 for c in v] for _, v in usable]
    n = len(x)
    sums = [sum(column) for column in zip(*x)]
    centred = np.array(x, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return usable, n, deviation, centred @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def check(found, rows):
    usable, n, deviation, white, explained = brute(rows)
    by_key = {}
    for r in found:
        by_key.setdefault(r.vec_id, []).append(r)
    where = {}
    for i, (key, _) in enumerate(usable):
        where.setdefault(key, []).append(i)
    assert set(by_key) == set(where)
    signs = np.sign(white[where[max(where)][0]])
    probe = {r.component: r.whitened for r in by_key[max(where)]}
    for key, own in by_key.items():
        assert len(own) == len(where[key]) * white.shape[1]
        i = where[key][0]
        for r in own:
            k = r.component - 1
            assert r.n == n and r.deviation == deviation[i]
            assert r.whitened * np.sign(probe[k + 1]) == pytest.approx(white[i, k] * signs[k], abs=1e-6)
            assert r.explained == pytest.approx(explained[k], rel=1e-9)
            assert r.identity_error < 1e-6


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = QUERIES["op11_embedding_whitening"](spark, sf_dir)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(found.collect(), rows)


def odd_rows():
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(40)]
    rows += [(100 + i, rows[3][1]) for i in range(200)]  # a hot vector
    rows += [(7, rows[7][1]), (7, rows[7][1])]  # repeated rows
    odd = [(900, None), (901, [None] * 6), (902, [math.nan] * 6), (903, [math.inf] + [0.0] * 5), (904, [1e30] * 6)]
    return rows, odd + [(905, [1.0, 2.0]), (906, [])]


def ask(spark, rows, **options):
    given = spark.createDataFrame(rows, SCHEMA)
    for name in [*CLASHES, "x", "name", "_key", "rows"]:
        given = given.withColumn(name, F.lit("clash"))
    given = given.withColumn("x", whitening.quantised("embedding"))
    return whitening.whiten(given, "x", "vec_id", **options)


def test_odd_rows(spark):
    rows, odd = odd_rows()
    found = ask(spark, rows + odd).select("*", F.posexplode("whitened").alias("at", "value"))
    found = found.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("value").alias("whitened"),
                         F.get("explained", "at").alias("explained"), "identity_error")
    check(found.collect(), rows)


def test_weights_of_one(spark):
    rows, _ = odd_rows()
    once = {tuple(v): (k, v) for k, v in rows}
    usable, n, deviation, white, explained = brute(list(once.values()))
    found = {r.vec_id: r for r in ask(spark, rows, weights="one").collect()}
    assert len(found) == len({k for k, _ in rows})
    for i, (key, _) in enumerate(usable):
        assert found[key].n == n == 40 and found[key].deviation == deviation[i]
        assert np.abs(found[key].whitened) == pytest.approx(np.abs(white[i]), abs=1e-6)
        assert found[key].explained == pytest.approx(explained.tolist())


def test_flat_directions_are_left_out(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(a), 2.0, float(b), float(a)]) for i, (a, b) in enumerate(rng.integers(0, 50, (30, 2)))]
    found = ask(spark, rows).collect()
    assert {len(r.whitened) for r in found} == {2}
    assert max(r.identity_error for r in found) < 1e-6


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(i, [3.0, 4.0]) for i in range(9)]])
def test_nothing_to_whiten(spark, rows):
    found = ask(spark, rows)
    assert found.columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]
    assert found.collect() == []


def test_deviations_beyond_64_bits(spark):
    rows = [(1, [0.0]), (2, [float(1 << 40)]), (3, [1.0])]
    found = {r.vec_id: r.deviation for r in ask(spark, rows).collect()}
    assert found == {1: None, 2: None, 3: None}
    x = np.array([[1 << 40], [0], [5]])
    sums = [int(x.sum())]
    small = whitening._deviations(x // (1 << 20), 3, [int((x // (1 << 20)).sum())])
    assert small == [(3 * int(v) - (1 << 20)) ** 2 for v in (x // (1 << 20))[:, 0]]
    assert whitening._deviations(x, 3, sums)[0] is None


def test_unknown_weights(spark):
    with pytest.raises(ValueError):
        ask(spark, [], weights="other")
