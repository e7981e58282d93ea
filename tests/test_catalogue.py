import pytest

from tests.oracle import compare, connect
from touchline.plans import catalogue, compositions, mechanisms  # noqa: F401


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, sf, duck, name):
    compare(spark, duck, catalogue.QUERIES[name], catalogue.SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    assert df.schema == catalogue.QUERIES[name](spark, sf).schema
    df.count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
