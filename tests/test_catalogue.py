"""Every query of the catalogue against its SQL, and a stable schema for those without."""

import pytest
from tests.compare import same

from tidemark.plans import catalogue, oracle

QUERIES, SQL = catalogue.queries(), oracle.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    same(QUERIES[name](spark, data), SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["key", "value", "ts"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark, data, tmp_path):
    from tidemark.operators import scan
    from tidemark.sources import log

    log.append(log.from_events(spark, data), str(tmp_path / "log"))
    plan = scan.prefix_scan(log.read(spark, str(tmp_path / "log")), "u00000")._jdf.queryExecution().toString()
    assert "StringStartsWith(key,u00000)" in plan
