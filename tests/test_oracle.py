"""Every registered query against its DuckDB counterpart."""

import compare
import pytest

import __spark_entry__ as registry

QUERIES = registry.own_queries()
ORACLES = registry.own_oracle_sql()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = compare.connect(sf_dir)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = compare.spark_rows(QUERIES[name](spark, sf_dir))
    want = compare.duck_rows(duck, ORACLES[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry(spark):
    frame = registry.entry(spark)
    assert frame.count() > 0
    assert "doctitle" in frame.columns
