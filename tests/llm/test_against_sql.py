"""The operators that SQL can express, on whole tables."""

import pytest
from tests.compare import same

from tidemark.llm import queries as llm

QUERIES, SQL = llm.queries(), llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    same(QUERIES[name](spark, data), SQL[name], data)
