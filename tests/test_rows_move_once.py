"""Lines move once for an order and once for a product, whatever the table's size; hot products and odd keys give the same rows."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stockflow.operators import enrich as en
from stockflow.operators import ordered
from stockflow.operators import stats as st
from stockflow.plans import views as v

QUERIES = entry.queries()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _line_scans(plan):
    return len(re.findall(r"FileScan parquet \[[^\]]*l_partkey", plan))


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stock_is_summed_where_the_lines_are(spark, sf, no_broadcast):
    plan = _plan(QUERIES["enrich"](spark, sf))
    assert _line_scans(plan) == 1 and "l_suppkey" not in " ".join(re.findall(r"Exchange hashpartitioning\((.*?),", plan))


def test_means_need_no_second_move(spark, sf, no_broadcast):
    assert _plan(QUERIES["financial_features"](spark, sf)).count("Exchange hashpartitioning") == 3


def test_sparse_columns_are_judged_on_written_stock(spark, sf):
    assert _line_scans(_plan(QUERIES["drop_sparse_columns"](spark, sf))) == 0


def test_partitions_follow_the_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(ordered, "PART_ROWS", 500)
    parts = -(-v.table(spark, sf, "lineitem").count() // 500)
    plan = _plan(QUERIES["kpi_stock_by_warehouse"](spark, sf))
    assert parts > 8 and re.search(rf"hashpartitioning\(l_orderkey#\d+L, {parts}\)", plan)


def test_ranks_are_segmented_without_counting_the_values(spark, sf, monkeypatch):
    given, real = [], st.running_total
    monkeypatch.setattr(st, "running_total", lambda *a: given.append(a[5:]) or real(*a))
    df = spark.range(40).selectExpr("id % 7 AS a", "id * 2 AS b")
    assert st.correlation_analysis(df, method="spearman", min_correlation=0.0).count() == 1
    assert given == [(80,)]


@pytest.fixture
def odd(spark, sf, tmp_path):
    for name in ("region", "nation", "supplier"):
        v.table(spark, sf, name).write.parquet(f"{tmp_path}/{name}.parquet")
    lines = v.table(spark, sf, "lineitem").filter("l_orderkey < 400")
    lines = lines.withColumn("l_partkey", F.expr("if(l_orderkey % 7 = 0, null, l_partkey % 20)")).withColumn("l_suppkey", F.expr("if(l_orderkey % 11 = 0, null, l_suppkey)"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = v.table(spark, sf, "orders")
    orders.filter("o_orderkey % 13 <> 0").union(orders.filter("o_orderkey % 5 = 0")).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_hot_and_plain_products_give_the_same_rows(spark, odd):
    columns, stock = ["order_date", "unit_price", *v.SALES_TIES], ["quantity_on_hand", "quantity_allocated"]

    def rows(sizes):
        df = en.enrich(v.lines_with_stock(spark, odd, sizes, columns, stock), v.SALES_TIES, sizes)
        return df.columns, sorted((tuple(f"{x:.9g}" if isinstance(x, float) else repr(x) for x in r) for r in df.collect()))

    plain = v.product_sizes(spark, odd)
    assert plain[0] <= ordered.HOT_ROWS
    assert rows(plain) == rows((ordered.HOT_ROWS + 1, plain[1]))


def test_repeated_orders_do_not_repeat_lines_without_order_columns(spark, odd):
    assert QUERIES["inventory_features"](spark, odd).count() == v.table(spark, odd, "lineitem").count()
