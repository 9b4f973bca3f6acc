import pytest
from oracle import compare

import __spark_entry__ as entry
from mutagrid.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    compare(spark, catalog.QUERIES[name], catalog.ORACLES[name], sf_dir)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 1


def test_every_query_is_registered():
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = catalog.QUERIES["live_vs_nocov"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "EqualTo(l_returnflag,A)" in plan


def test_greedy_suite_kills_what_the_whole_suite_kills(spark, sf_dir):
    picked = catalog.QUERIES["greedy_minimise"](spark, sf_dir).groupBy("target").agg({"gain": "sum"}).collect()
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber").distinct().groupBy("l_orderkey").count().collect()
    assert {r[0]: r[1] for r in picked} == {str(r[0]): r[1] for r in rows}
