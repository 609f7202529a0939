import pytest

from chronoplane.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    assert compare(queries.QUERIES[name](spark, sf), sf, queries.ORACLE_SQL[name]) > 0


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
