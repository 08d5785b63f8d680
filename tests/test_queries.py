import pytest
from oracle import assert_same, connect

import __spark_entry__ as entry
from sieveline.plans import registry

BASE = registry.queries()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [n for n in BASE if n in SQL])
def test_matches_sql(spark, sf, con, name):
    assert_same(BASE[name](spark, sf), SQL[name], con)


@pytest.mark.parametrize("name", [n for n in BASE if n not in SQL and n != "svd_embed"])
def test_runs(spark, sf, name):
    assert BASE[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["item_id", "doc_id", "score", "rank"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
