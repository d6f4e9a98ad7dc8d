"""Every query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tools.check_oracle import SPARK_TYPES, compare, connect, types_of

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cursor = con.execute(ORACLES[name])
    assert compare(df.columns, got, [d[0] for d in cursor.description], cursor.fetchall()) == ""
    kinds = types_of(con, ORACLES[name])
    assert {c: SPARK_TYPES[t] for c, t in df.dtypes} == kinds


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    assert len(QUERIES[name](spark, sf_dir).take(1)) == 1


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["scaler", "stat", "bin", "bin_start", "bin_end", "count"]
    assert df.count() == 5 * 3 * 300
