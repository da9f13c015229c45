"""Every registered query: the same rows as its SQL, or else rows of a stable shape."""

import pytest

import __spark_entry__ as entry
from oracle_check import connect, differences

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf, con, name):
    assert differences(QUERIES[name](spark, sf), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_without_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows
    for c in ("score", "Importance", "mean", "pobre"):
        if c in df.columns:
            assert all(r[c] is not None for r in rows)
    if "pobre" in df.columns:
        assert {r["pobre"] for r in rows} <= {0, 1}
        assert len({r["id"] for r in rows}) == len(rows)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"id", "Clase", "pensiones", "Pobre"} <= set(df.columns)
