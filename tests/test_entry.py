"""Driver contract: entry runs on sf0.001, every query has a callable, and
every oracle belongs to a registered query."""

import os

import pytest

import __spark_entry__ as E

SMOKE = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="driver tables not present")
def test_entry_returns_rows(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "distance_km" in df.columns


def test_registry_consistent():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 40
    own = set(qs) - set(E._text_queries()[0])
    assert own - set(sqls) == {"html_to_text"}
    assert len(own & set(sqls)) >= 49


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="driver tables not present")
@pytest.mark.parametrize("name", ["nearest_n", "validation_issues", "park_parse",
                                  "clean_campgrounds", "column_profile"])
def test_queries_run_on_smoke_tables(spark, name):
    df = E.queries()[name](spark, SMOKE)
    assert df.count() >= 0 and df.columns
