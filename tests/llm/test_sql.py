import pytest

from tests.oracle import compare, connect
from touchline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    compare(spark, connect(sf), queries.QUERIES[name], queries.ORACLE_SQL[name], sf)
