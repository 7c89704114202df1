"""Physical plans: pruning, pushdown, no table-sized single partition, no forced broadcast of growing tables."""

import re

import pytest

import __spark_entry__ as entry
from stockflow.operators import enrich
from stockflow.plans import views as v
from stockflow.sources import files

QUERIES = entry.queries()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_projection_reaches_the_scan(spark, sf):
    plan = _plan(QUERIES["kpi_top_products"](spark, sf))
    assert plan.count("FileScan") == 1 and "TakeOrderedAndProject" in plan
    assert "ReadSchema: struct<l_partkey:bigint,l_extendedprice:double,l_discount:double>" in plan


def test_filters_reach_the_scan(spark, sf):
    plan = _plan(QUERIES["csv_filtered_scan"](spark, sf))
    assert re.search(r"PushedFilters: \[.*EqualTo\(o_orderstatus,F\)", plan)
    sql = files.sql_scan(spark, "SELECT o_orderkey FROM o WHERE o_totalprice >= :low", {"low": 5.0}, {"o": v.table(spark, sf, "orders")})
    assert "GreaterThanOrEqual(o_totalprice,5.0)" in _plan(sql)


@pytest.mark.parametrize("name", ["lag_features", "enrich", "rolling_z", "spikes", "ts_fit", "agg_resample_w", "financial_features", "mann_kendall", "forecast_records", "kpi_revenue_trend"])
def test_rows_never_meet_in_one_partition(spark, sf, name):
    assert "SinglePartition" not in _plan(QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", ["kpi_top_products", "agg_resample_m", "correlation_pairs", "describe", "normality"])
def test_hot_paths_stay_in_the_jvm(spark, sf, name):
    plan = _plan(QUERIES[name](spark, sf))
    assert not re.search(r"PythonUDF|MapInPandas|FlatMapGroupsInPandas", plan) or name == "correlation_pairs"


def test_nothing_is_broadcast_by_hint(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(v.sales(spark, sf, "product_id", "warehouse_location", "order_date", "is_b2b"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") == 0 and plan.count("SortMergeJoin") == 5


@pytest.mark.parametrize("name", ["financial", "inventory", "enrich"])
def test_a_hot_product_is_split(spark, name):
    # A key with two thirds of the rows, and limits low enough for the size of a test.
    limits = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in limits}
    for k, value in limits.items():
        spark.conf.set(k, value)
    try:
        rows = spark.range(0, 60_000, 1, 8).selectExpr(
            "if(id % 3 < 2, 7, id) AS product_id", "id * 0.5 AS unit_price", "id % 9 + 1 AS quantity", "DATE'2024-01-01' AS order_date", "id AS quantity_on_hand", "id % 5 AS quantity_allocated"
        )
        make = {"financial": enrich.add_financial_features, "inventory": enrich.add_inventory_features, "enrich": enrich.enrich}[name]
        out = make(rows)
        out.collect()
        assert "skewed" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)
