"""Queries: sources, cleansing, features, aggregation, normalisation, quality, KPIs, ETL."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockflow.functions import scalars as sc
from stockflow.operators import aggregate as agg
from stockflow.operators import cleanse as cl
from stockflow.operators import enrich as en
from stockflow.operators import quality as qu
from stockflow.operators.normalize import normalize
from stockflow.operators.ordered import HOT_ROWS, forward_fill
from stockflow.plans import kpi
from stockflow.plans import views as v
from stockflow.plans.etl import run_etl
from stockflow.plans.registry import query
from stockflow.plans.views import sql_with
from stockflow.session import materialize, scratch_path, store, widen
from stockflow.sources import files, sinks
from stockflow.streaming import jobs

TABLE_NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORDERS_CSV = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
REGIONS = ["africa", "america", "asia", "europe", "middle east"]
AS_OF = datetime(2001, 1, 1)

# ---------------------------------------------------------------- sources


def _orders_csv(spark, d, compression=None) -> str:
    path = scratch_path(spark, "orders-csv")
    sinks.write_csv(v.table(spark, d, "orders"), path, compression)
    return path


@query("csv_scan", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def csv_scan(spark, d):
    path = _orders_csv(spark, d, "gzip")
    return files.csv_scan(spark, path, ORDERS_CSV, ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"])


@query("csv_filtered_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def csv_filtered_scan(spark, d):
    filters = {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}
    return files.csv_scan(spark, _orders_csv(spark, d), ORDERS_CSV, None, filters).select("o_orderkey", "o_totalprice")


@query("csv_stream", "SELECT * FROM orders")
def csv_stream(spark, d):
    out = scratch_path(spark, "csv-stream")
    path = scratch_path(spark, "orders-csv")  # four files, one at a trigger
    sinks.write_csv(v.table(spark, d, "orders").repartition(4), path)
    chunks = jobs.csv_chunks(spark, path, ORDERS_CSV)
    jobs.write_stream(chunks, f"{out}/data", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/data")


@query("json_pages", "SELECT o_orderkey // 500 AS page, o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def json_pages(spark, d):
    # Bodies of up to 500 rows (the order key is unique), in both envelope forms.
    orders = v.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    page = F.floor(F.col("o_orderkey") / 500)
    last = orders.agg(F.max(page)).first()[0]
    rows = F.collect_list(F.struct(*orders.columns))
    bodies = orders.groupBy(page.alias("page")).agg(rows.alias("rows"))
    more = F.col("page") < last
    as_results = F.to_json(F.struct(F.col("rows").alias("results"), more.alias("has_next")))
    as_data = F.to_json(F.struct(F.col("rows").alias("data"), F.when(more, F.concat(F.lit("/orders?page="), F.col("page") + 1)).alias("next")))
    pages = bodies.select("page", F.when(F.size("rows") == 500, as_results).otherwise(as_data).alias("body"))
    return files.json_pages(pages, "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderpriority STRING")


@query(
    "sql_param_scan",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 250000 AND o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus <> 'P'",
)
def sql_param_scan(spark, d):
    text = "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice >= :low AND o_orderdate >= :since AND o_orderstatus <> :skip"
    text = text.replace("{orders}", "source_orders")
    params = {"low": 250000.0, "since": datetime(1998, 1, 1), "skip": "P"}
    return files.sql_scan(spark, text, params, {"source_orders": v.table(spark, d, "orders")})


@query(
    "multi_source",
    """SELECT 'customer' AS source, c_custkey AS party, c_acctbal AS balance, c_mktsegment AS segment FROM customer
       UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""",
)
def multi_source(spark, d):
    loaders = {
        "customer": lambda: v.table(spark, d, "customer").select(
            F.col("c_custkey").alias("party"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
        ),
        "supplier": lambda: v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("party"), F.col("s_acctbal").alias("balance")),
        "partner": lambda: v.table(spark, d, "no_such_table"),
    }
    frames, _ = files.multi_source(spark, loaders, {"partner": "party BIGINT, balance DOUBLE"})
    return files.union_sources(frames)


@query("scan_metrics", "SELECT count(*)::BIGINT AS records_extracted, 1::BIGINT AS files FROM lineitem")
def scan_metrics(spark, d):
    return files.scan_metrics(v.table(spark, d, "lineitem")).select("records_extracted", "files")


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLE_NAMES))
def table_counts(spark, d):
    return sinks.table_counts({t: v.table(spark, d, t) for t in TABLE_NAMES})


# ---------------------------------------------------------------- cleansing


@query("cleanse_dedup", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount, l_tax FROM lineitem")
def cleanse_dedup(spark, d):
    return cl.drop_duplicates(v.table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax"))


@query("standardize_names", 'SELECT o_orderkey AS order_key, o_custkey AS customer_id, o_totalprice AS total__usd_, o_orderdate AS "2nd_date" FROM orders')
def standardize_names(spark, d):
    raw = v.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return cl.standardize_names(raw.toDF(" Order Key", "Customer-ID", "Total (USD) ", "2nd.Date"))


@query("drop_sparse_columns", sql_with("inventory", "SELECT product_id, warehouse_location, quantity_on_hand, last_restock_date FROM inventory"))
def drop_sparse_columns(spark, d):
    stock = v.inventory(spark, d).select("product_id", "warehouse_location", "quantity_on_hand", "last_restock_date", "last_urgent_date")
    return cl.drop_sparse_columns(store(stock, "stock"))


QUANTITIES = ["quantity_on_hand", "quantity_allocated", "quantity_in_transit"]
MEDIAN_FILLED = ", ".join(f"coalesce({q}, (SELECT median({q}) FROM inventory)) AS {q}" for q in QUANTITIES)


@query("fill_median", sql_with("inventory", f"SELECT product_id, warehouse_location, {MEDIAN_FILLED} FROM inventory"))
def fill_median(spark, d):
    return cl.fill_missing(materialize(v.inventory(spark, d).select("product_id", "warehouse_location", *QUANTITIES)))


FILLED_DATE = "last_value(last_restock_date IGNORE NULLS) OVER (PARTITION BY product_id ORDER BY warehouse_location)"


@query("ffill", sql_with("inventory", f"SELECT product_id, warehouse_location, {FILLED_DATE} AS last_restock_date FROM inventory"))
def ffill(spark, d):
    stock = v.inventory(spark, d).select("product_id", "warehouse_location", "last_restock_date")
    return forward_fill(stock, ["last_restock_date"], ["product_id"], ["warehouse_location"])


MODE_FILLED = """coalesce(last_channel, (SELECT last_channel FROM inventory WHERE last_channel IS NOT NULL
       GROUP BY 1 ORDER BY count(*) DESC, last_channel LIMIT 1)) AS last_channel"""


@query(
    "fill_mode",
    sql_with(
        "inventory",
        f"SELECT product_id, warehouse_location, {MODE_FILLED}, coalesce(strftime(last_restock_date, '%Y-%m-%d'), 'UNKNOWN') AS restock_label FROM inventory",
    ),
)
def fill_mode(spark, d):
    label = F.date_format("last_restock_date", "yyyy-MM-dd").alias("restock_label")
    return cl.fill_missing(materialize(v.inventory(spark, d).select("product_id", "warehouse_location", "last_channel", label)))


OUTLIER_COLUMNS = ["quantity", "unit_price", "total_amount"]


def _outlier_rows(spark, d):
    return widen(v.sales(spark, d, "l_orderkey", "l_linenumber", "product_id", *OUTLIER_COLUMNS))


def _fence(column: str, table: str) -> str:
    q1, q3 = (f"(SELECT quantile_cont({column}, {p}) FROM {table})" for p in (0.25, 0.75))
    return f"{column} BETWEEN {q1} - 3.0 * ({q3} - {q1}) AND {q3} + 3.0 * ({q3} - {q1})"


PICKED = "l_orderkey, l_linenumber, product_id, quantity, unit_price, total_amount"


@query("outlier_iqr", sql_with("sales", f"SELECT {PICKED} FROM sales WHERE " + " AND ".join(_fence(c, "sales") for c in OUTLIER_COLUMNS)))
def outlier_iqr(spark, d):
    return cl.remove_outliers_iqr(_outlier_rows(spark, d), OUTLIER_COLUMNS)


@query(
    "outlier_iqr_seq",
    sql_with(
        "sales",
        f"""WITH s1 AS (SELECT * FROM sales WHERE {_fence("quantity", "sales")}),
        s2 AS (SELECT * FROM s1 WHERE {_fence("unit_price", "s1")})
        SELECT {PICKED} FROM s2 WHERE {_fence("total_amount", "s2")}""",
    ),
)
def outlier_iqr_seq(spark, d):
    return cl.remove_outliers_iqr(_outlier_rows(spark, d), OUTLIER_COLUMNS, sequential=True)


def _z_keep(column: str) -> str:
    return f"abs({column} - (SELECT avg({column}) FROM sales)) / (SELECT stddev_pop({column}) FROM sales) < 3"


@query("outlier_zscore", sql_with("sales", f"SELECT {PICKED} FROM sales WHERE " + " AND ".join(_z_keep(c) for c in OUTLIER_COLUMNS)))
def outlier_zscore(spark, d):
    return cl.remove_outliers_zscore(_outlier_rows(spark, d), OUTLIER_COLUMNS)


@query("repair_numeric", "SELECT event_id, event_type, regexp_extract(props, '([0-9]+)', 1)::DOUBLE AS k FROM events")
def repair_numeric(spark, d):
    return cl.repair_types(v.table(spark, d, "events").select("event_id", "event_type", F.regexp_extract("props", "([0-9]+)", 1).alias("k")))


@query("repair_datetime", "SELECT event_id, event_type, date_trunc('second', ts) AS ts FROM events")
def repair_datetime(spark, d):
    events = v.table(spark, d, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    return cl.repair_types(events)


def _raw_stock(spark, d):
    """Stock with untidy names, text cells, gaps and a mostly empty column."""
    s = v.inventory(spark, d)
    return s.select(
        F.col("product_id").alias("Product ID"),
        F.col("warehouse_location").alias("Warehouse-Location"),
        F.col("quantity_on_hand").cast("bigint").cast("string").alias("Quantity On Hand"),
        F.col("quantity_allocated").alias("quantity_allocated"),
        F.col("last_restock_date").alias("Last Restock"),
        F.col("last_channel").alias(" Last.Channel "),
        F.col("last_urgent_date").alias("Last Urgent"),
    )


FILLED_STOCK = f"""filled AS (SELECT product_id, warehouse_location, coalesce(quantity_on_hand, (SELECT median(quantity_on_hand) FROM inventory)) AS quantity_on_hand,
          coalesce(quantity_allocated, (SELECT median(quantity_allocated) FROM inventory)) AS quantity_allocated,
          {FILLED_DATE} AS last_restock, {MODE_FILLED} FROM inventory)"""
CLEANSED = f"""{FILLED_STOCK},
       clean AS (SELECT * FROM filled WHERE {_fence("product_id", "filled")} AND {_fence("quantity_on_hand", "filled")}
                 AND {_fence("quantity_allocated", "filled")})"""


def _cleansed(spark, d, audit=None):
    return cl.cleanse(_raw_stock(spark, d), ["Product ID"], ["Warehouse-Location"], audit=audit)


@query("cleanse", sql_with("inventory", f"WITH {CLEANSED} SELECT * FROM clean"))
def cleanse(spark, d):
    return _cleansed(spark, d)


@query(
    "cleanse_audit",
    sql_with(
        "inventory",
        """WITH gaps AS (SELECT avg((quantity_on_hand IS NULL)::INT) AS hand, avg((quantity_allocated IS NULL)::INT) AS alloc, avg((last_restock_date IS NULL)::INT) AS restock,
                 avg((last_channel IS NULL)::INT) AS channel, avg((last_urgent_date IS NULL)::INT) AS urgent FROM inventory),
        steps AS (SELECT 0 AS o, 'remove_duplicates' AS step, '' AS column_name
          UNION ALL SELECT 1, 'standardize_column_names', '' UNION ALL SELECT 2, 'convert_numeric', 'quantity_on_hand'
          UNION ALL SELECT 3, 'drop_column', 'last_urgent' FROM gaps WHERE urgent > 0.5
          UNION ALL SELECT 4, 'fill_median', 'quantity_on_hand' FROM gaps WHERE hand BETWEEN 1e-9 AND 0.5
          UNION ALL SELECT 5, 'fill_median', 'quantity_allocated' FROM gaps WHERE alloc BETWEEN 1e-9 AND 0.5
          UNION ALL SELECT 6, 'fill_forward', 'last_restock' FROM gaps WHERE restock BETWEEN 1e-9 AND 0.5
          UNION ALL SELECT 7, 'fill_mode_or_unknown', 'last_channel' FROM gaps WHERE channel BETWEEN 1e-9 AND 0.5
          UNION ALL SELECT 8, 'remove_outliers_iqr', 'product_id' UNION ALL SELECT 9, 'remove_outliers_iqr', 'quantity_on_hand'
          UNION ALL SELECT 10, 'remove_outliers_iqr', 'quantity_allocated')
        SELECT (row_number() OVER (ORDER BY o) - 1)::INTEGER AS step_no, step, column_name FROM steps""",
    ),
)
def cleanse_audit(spark, d):
    audit = cl.Audit()
    _cleansed(spark, d, audit)
    return audit.frame(spark)


def _profile_sql(column: str, numeric: bool) -> str:
    q = [f"quantile_cont({column}::DOUBLE, {p})" if numeric else "NULL::DOUBLE" for p in (0.25, 0.5, 0.75)]
    mode = "NULL" if numeric else f"(SELECT {column} FROM inventory WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {column} LIMIT 1)"
    return f"""SELECT '{column}' AS column_name, count(*) AS n_rows, count(*) - count({column}) AS missing,
        (count(*) - count({column})) / count(*) AS missing_share, count(DISTINCT {column}) AS n_distinct, {q[0]} AS q1, {q[1]} AS median, {q[2]} AS q3, {mode} AS mode FROM inventory"""


@query(
    "column_profile",
    sql_with(
        "inventory",
        " UNION ALL ".join(
            [_profile_sql(c, True) for c in ["product_id", "quantity_on_hand", "quantity_allocated"]] + [_profile_sql(c, False) for c in ["warehouse_location", "last_channel"]]
        ),
    ),
)
def column_profile(spark, d):
    return cl.column_profile(materialize(v.inventory(spark, d).select("product_id", "warehouse_location", "quantity_on_hand", "quantity_allocated", "last_channel")))


# ---------------------------------------------------------------- features

DATE_SQL = """year({c})::INT AS {p}_year, month({c})::INT AS {p}_month, quarter({c})::INT AS {p}_quarter, (isodow({c}) - 1)::INT AS {p}_day_of_week,
       day({c})::INT AS {p}_day_of_month, weekofyear({c})::INT AS {p}_week_of_year, (isodow({c}) >= 6)::INT AS {p}_is_weekend,
       (day({c}) = 1)::INT AS {p}_is_month_start, ({c}::DATE = last_day({c}::DATE))::INT AS {p}_is_month_end"""


@query("date_features", f"SELECT o_orderkey, o_orderdate AS order_date, {DATE_SQL.format(c='o_orderdate', p='order')} FROM orders")
def date_features(spark, d):
    return en.add_date_features(v.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("order_date")))


TIES = ", ".join(v.SALES_TIES)
MONEY = ["product_id", "order_date", "unit_price", *v.SALES_TIES]


@query(
    "financial_features",
    sql_with(
        "sales",
        f"""SELECT product_id, {TIES}, unit_price * quantity AS revenue, strftime(order_date, '%Y-%m') AS transaction_year_month,
            round(avg(unit_price) OVER p, 4) AS avg_price_by_product, round((unit_price - avg(unit_price) OVER p) / avg(unit_price) OVER p * 100, 4) AS price_vs_avg
            FROM sales WINDOW p AS (PARTITION BY product_id)""",
    ),
)
def financial_features(spark, d):
    sizes = v.product_sizes(spark, d)
    out = en.add_financial_features(v.sales(spark, d, *MONEY, by_product=sizes[0] <= HOT_ROWS), sizes)
    return out.withColumns({c: F.round(c, 4) for c in ("avg_price_by_product", "price_vs_avg")}).drop("order_date", "unit_price")


STOCK = ["quantity_on_hand", "quantity_allocated"]


@query(
    "inventory_features",
    sql_with(
        "sales inventory",
        """SELECT product_id, warehouse_location, quantity, l_orderkey, l_linenumber, quantity_on_hand, quantity_allocated,
           quantity_on_hand - quantity_allocated AS available_quantity, quantity_allocated / nullif(quantity_on_hand, 0) AS allocation_rate,
           round(quantity_on_hand / nullif(avg(quantity) OVER (PARTITION BY product_id), 0), 6) AS stock_coverage_days
           FROM sales LEFT JOIN inventory USING (product_id, warehouse_location)""",
    ),
)
def inventory_features(spark, d):
    sizes = v.product_sizes(spark, d)
    lines = v.lines_with_stock(spark, d, sizes, ["quantity", "l_orderkey", "l_linenumber"], STOCK)
    return en.add_inventory_features(lines, sizes).withColumn("stock_coverage_days", F.round("stock_coverage_days", 6))


LAG_SQL = ", ".join(
    f"lag({c}, {n}) OVER w AS {name}_lag_{n}d" for n in en.LAGS for name, c in (("revenue", "total_amount"), ("quantity", "quantity"))
)


@query("lag_features", sql_with("sales", f"SELECT product_id, order_date, {TIES}, {LAG_SQL} FROM sales WINDOW w AS (PARTITION BY product_id ORDER BY order_date, {TIES})"))
def lag_features(spark, d):
    return en.add_lag_features(v.sales(spark, d, "product_id", "order_date", *v.SALES_TIES), v.SALES_TIES)


@query(
    "lag_days",
    sql_with(
        "daily",
        "SELECT a.entity_id, a.ds, a.y, a.q, "
        + ", ".join(f"b{n}.y AS revenue_lag_{n}d, b{n}.q AS quantity_lag_{n}d" for n in en.LAGS)
        + " FROM daily a "
        + " ".join(f"LEFT JOIN daily b{n} ON a.entity_id = b{n}.entity_id AND a.ds = b{n}.ds + {n}" for n in en.LAGS),
    ),
)
def lag_days(spark, d):
    return en.calendar_lags(v.daily(spark, d))


@query(
    "enrich",
    sql_with(
        "sales inventory",
        f"""SELECT product_id, order_date, {TIES}, unit_price, quantity_on_hand, quantity_allocated, {DATE_SQL.format(c="order_date", p="order")}, {DATE_SQL.format(c="ship_date", p="ship")},
            unit_price * quantity AS revenue, strftime(order_date, '%Y-%m') AS transaction_year_month, round(avg(unit_price) OVER p, 4) AS avg_price_by_product,
            round((unit_price - avg(unit_price) OVER p) / avg(unit_price) OVER p * 100, 4) AS price_vs_avg,
            quantity_on_hand - quantity_allocated AS available_quantity, quantity_allocated / nullif(quantity_on_hand, 0) AS allocation_rate,
            round(quantity_on_hand / nullif(avg(quantity) OVER p, 0), 6) AS stock_coverage_days, {LAG_SQL}
            FROM sales LEFT JOIN inventory USING (product_id, warehouse_location)
            WINDOW p AS (PARTITION BY product_id), w AS (PARTITION BY product_id ORDER BY order_date, {TIES})""",
    ),
)
def enrich(spark, d):
    sizes = v.product_sizes(spark, d)
    lines = v.lines_with_stock(spark, d, sizes, [c for c in MONEY if c != "product_id"], STOCK)
    out = en.enrich(lines.drop("warehouse_location"), v.SALES_TIES, sizes)
    return out.withColumns({c: F.round(c, n) for c, n in (("avg_price_by_product", 4), ("price_vs_avg", 4), ("stock_coverage_days", 6))})


@query("margin_pct", sql_with("products", "SELECT product_id, CASE WHEN unit_price > 0 THEN round((unit_price - unit_cost) / unit_price * 100, 6) ELSE 0 END AS margin_percentage FROM products"))
def margin_pct(spark, d):
    return v.products(spark, d).select("product_id", F.round(sc.margin_pct(F.col("unit_price"), F.col("unit_cost")), 6).alias("margin_percentage"))


@query(
    "stockout_risk",
    sql_with(
        "inventory",
        """WITH s AS (SELECT *, quantity_on_hand * 30 / nullif(quantity_allocated, 0) AS days_of_supply FROM inventory)
        SELECT product_id, warehouse_location, round(CASE WHEN days_of_supply IS NULL THEN 0.5::DOUBLE WHEN days_of_supply <= 0 THEN 1 WHEN days_of_supply >= 30 THEN 0
               ELSE 1 - days_of_supply / 30 END, 6) AS stockout_risk FROM s""",
    ),
)
def stockout_risk(spark, d):
    days = sc.ratio(F.col("quantity_on_hand") * 30, F.col("quantity_allocated"))
    return v.inventory(spark, d).select("product_id", "warehouse_location", F.round(sc.stockout_risk(days), 6).alias("stockout_risk"))


@query(
    "supplier_score",
    sql_with(
        "suppliers",
        """SELECT supplier_id, round(on_time_delivery_rate * 0.30 + quality_acceptance_rate * 0.25 + greatest(0, 100 - average_lead_time_days / 100 * 5) * 0.20
           + cost_competitiveness_score * 0.15 + least(100, total_orders / 10) * 0.10, 2) AS overall_score FROM suppliers""",
    ),
)
def supplier_score(spark, d):
    lead, responsiveness = F.col("average_lead_time_days") / 100, F.least(F.lit(100.0), F.col("total_orders") / 10)
    score = sc.supplier_score(F.col("on_time_delivery_rate"), F.col("quality_acceptance_rate"), lead, F.col("cost_competitiveness_score"), responsiveness)
    return v.suppliers(spark, d).select("supplier_id", score.alias("overall_score"))


@query(
    "sales_enriched",
    sql_with(
        "sales products",
        """SELECT l_orderkey, l_linenumber, product_id, total_amount, order_date, name, category, lead_time_days, warehouse_location
           FROM sales JOIN products USING (product_id)""",
    ),
)
def sales_enriched(spark, d):
    lines = v.sales(spark, d, "l_orderkey", "l_linenumber", "product_id", "total_amount", "order_date", "warehouse_location")
    return lines.join(v.products(spark, d).select("product_id", "name", "category", "lead_time_days"), "product_id")


# ---------------------------------------------------------------- aggregation and scaling


def price_range(column):
    return F.max(column) - F.min(column)


@query(
    "agg_group",
    sql_with(
        "sales",
        """SELECT warehouse_location, order_status, round(sum(total_amount), 4) AS total_amount_sum, round(avg(total_amount), 3) AS total_amount_mean,
           median(total_amount) AS total_amount_median, max(quantity) AS quantity_max, count(DISTINCT quantity) AS quantity_nunique,
           round(stddev_samp(quantity), 6) AS quantity_std, max(unit_price) - min(unit_price) AS unit_price_price_range FROM sales GROUP BY 1, 2""",
    ),
)
def agg_group(spark, d):
    sales = v.sales(spark, d, "warehouse_location", "order_status", "total_amount", "quantity", "unit_price")
    spec = {"total_amount": ["sum", "mean", "median"], "quantity": ["max", "nunique", "std"], "unit_price": [price_range]}
    out = agg.aggregate(materialize(sales), ["warehouse_location", "order_status"], spec)
    return out.withColumns({"total_amount_sum": F.round("total_amount_sum", 4), "total_amount_mean": F.round("total_amount_mean", 3), "quantity_std": F.round("quantity_std", 6)})


def _resample_sql(unit: str, label: str) -> str:
    return sql_with(
        "sales",
        f"""WITH p AS (SELECT warehouse_location, order_status, date_trunc('{unit}', order_date)::DATE AS d, round(sum(total_amount), 4) AS s, count(total_amount) AS c, round(avg(quantity), 6) AS m
               FROM sales GROUP BY ALL),
        b AS (SELECT warehouse_location, order_status, unnest(generate_series(min(d)::TIMESTAMP, max(d)::TIMESTAMP, INTERVAL 1 {unit}))::DATE AS d FROM p GROUP BY 1, 2)
        SELECT b.warehouse_location, b.order_status, {label} AS order_date, coalesce(s, 0) AS total_amount_sum, coalesce(c, 0) AS total_amount_count, m AS quantity_mean
        FROM b LEFT JOIN p USING (warehouse_location, order_status, d)""",
    )


def _resample(spark, d, freq):
    sales = v.sales(spark, d, "warehouse_location", "order_status", "order_date", "total_amount", "quantity")
    out = agg.aggregate(sales, ["warehouse_location", "order_status"], {"total_amount": ["sum", "count"], "quantity": ["mean"]}, freq)
    return out.withColumns({"total_amount_sum": F.round("total_amount_sum", 4), "quantity_mean": F.round("quantity_mean", 6)})


@query("agg_resample_d", _resample_sql("day", "b.d"))
def agg_resample_d(spark, d):
    return _resample(spark, d, "D")


@query("agg_resample_w", _resample_sql("week", "b.d + 6"))
def agg_resample_w(spark, d):
    return _resample(spark, d, "W")


@query("agg_resample_m", _resample_sql("month", "last_day(b.d)"))
def agg_resample_m(spark, d):
    return _resample(spark, d, "M")


def _normalized_sql(expression: str) -> str:
    columns = ", ".join(f"round({expression.format(c=c)}, 6) AS {c}_normalized" for c in ("quantity", "unit_price"))
    return sql_with("sales", f"SELECT l_orderkey, l_linenumber, {columns} FROM sales")


def _normalized(spark, d, method):
    out = normalize(widen(v.sales(spark, d, "l_orderkey", "l_linenumber", "quantity", "unit_price")), ["quantity", "unit_price"], method)
    return out.select("l_orderkey", "l_linenumber", *[F.round(f"{c}_normalized", 6).alias(f"{c}_normalized") for c in ("quantity", "unit_price")])


@query("normalize_minmax", _normalized_sql("({c} - (SELECT min({c}) FROM sales)) / (SELECT max({c}) - min({c}) FROM sales)"))
def normalize_minmax(spark, d):
    return _normalized(spark, d, "minmax")


@query("normalize_zscore", _normalized_sql("({c} - (SELECT avg({c}) FROM sales)) / (SELECT stddev_samp({c}) FROM sales)"))
def normalize_zscore(spark, d):
    return _normalized(spark, d, "zscore")


@query("normalize_robust", _normalized_sql("({c} - (SELECT median({c}) FROM sales)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM sales)"))
def normalize_robust(spark, d):
    return _normalized(spark, d, "robust")


# ---------------------------------------------------------------- quality


@query(
    "quality_checks",
    sql_with(
        "inventory",
        """WITH f AS (SELECT o_custkey, o_orderstatus, o_orderpriority, o_orderdate AS order_date, round(o_totalprice / 1000) - 1 AS quantity FROM orders),
        t AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM f)) AS u, count(*) FILTER (quantity < 0) AS neg,
              count(*) FILTER (order_date > TIMESTAMP '2001-01-01') AS fut FROM f)
        SELECT 'orders' AS table_name, 'no_duplicates' AS check_name, 'uniqueness' AS check_type, n = u AS passed, n AS total_records, n - u AS failed_records, (n - u) / n AS failure_rate FROM t
        UNION ALL SELECT 'orders', 'no_negative_quantities', 'validity', neg = 0, n, neg, neg / n FROM t
        UNION ALL SELECT 'orders', 'no_future_dates', 'validity', fut = 0, n, fut, fut / n FROM t
        UNION ALL SELECT 'orders', 'data_completeness', 'completeness', true, n * 5, 0, 0 FROM t
        UNION ALL SELECT 'inventory', 'no_duplicates', 'uniqueness', true, count(*), 0, 0 FROM inventory
        UNION ALL SELECT 'inventory', 'no_negative_quantities', 'validity', true, count(*), 0, 0 FROM inventory
        UNION ALL SELECT 'inventory', 'no_future_dates', 'validity', true, count(*), 0, 0 FROM inventory
        UNION ALL SELECT 'inventory', 'data_completeness', 'completeness', 1 - m / (n * 3) > 0.9, n * 3, m, m / (n * 3)
          FROM (SELECT count(*) AS n, 2 * count(*) - count(quantity_on_hand) - count(last_urgent_date) AS m FROM inventory)""",
    ),
)
def quality_checks(spark, d):
    orders = v.table(spark, d, "orders").select(
        "o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").alias("order_date"), (F.round(F.col("o_totalprice") / 1000) - 1).alias("quantity")
    )
    stock = v.inventory(spark, d).select(F.struct("product_id", "warehouse_location").alias("item"), "quantity_on_hand", "last_urgent_date")
    as_of = F.lit(AS_OF)
    return qu.quality_checks(orders, "orders", as_of).unionByName(qu.quality_checks(stock, "inventory", as_of))


def _rule_sql(rules: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) FILTER (NOT coalesce({ok}, false)) AS failed_records FROM {source}" for name, ok in rules.items())


PRODUCT_TYPES = ["economy", "standard", "promo", "small", "medium"]


@query(
    "validate_products",
    sql_with(
        "products",
        """SELECT product_id, list_filter([CASE WHEN NOT (regexp_full_match(sku, '[A-Z0-9\\-]+') AND length(sku) BETWEEN 3 AND 50) THEN 'sku_format' END,
             CASE WHEN NOT length(name) BETWEEN 1 AND 200 THEN 'name_length' END,
             CASE WHEN category NOT IN ('economy', 'standard', 'promo', 'small', 'medium') THEN 'category_known' END,
             CASE WHEN NOT unit_price > 0 THEN 'unit_price_positive' END, CASE WHEN NOT unit_cost > 0 THEN 'unit_cost_positive' END,
             CASE WHEN NOT lead_time_days > 0 THEN 'lead_time_days_positive' END, CASE WHEN NOT unit_price >= unit_cost THEN 'price_covers_cost' END],
             lambda x: x IS NOT NULL) AS failed FROM products""".replace("list_filter(", "array_to_string(list_filter(").replace("IS NOT NULL) AS failed", "IS NOT NULL), ',') AS failed_rules"),
    ),
)
def validate_products(spark, d):
    return qu.validate(v.products(spark, d), qu.product_rules(PRODUCT_TYPES)).select("product_id", F.array_join("failed_rules", ",").alias("failed_rules"))


STOCK_RULES = {"warehouse_known": "warehouse_location IN ('africa', 'america', 'asia')", **{f"{q}_non_negative": f"{q} >= 0" for q in QUANTITIES}}


@query("validate_inventory", sql_with("inventory", _rule_sql(STOCK_RULES, "inventory")))
def validate_inventory(spark, d):
    return qu.rule_failures(v.inventory(spark, d), qu.inventory_rules(["africa", "america", "asia"]))


SALES_RULES = {
    "quantity_positive": "quantity > 0",
    "unit_price_positive": "unit_price > 0",
    "total_amount_positive": "total_amount > 0",
    "discount_amount_non_negative": "discount_amount >= 0",
    "warehouse_known": "warehouse_location IN ('africa', 'america', 'asia', 'europe', 'middle east')",
    "status_known": "order_status IN ('pending', 'shipped', 'delivered')",
    "total_matches": "abs(total_amount - (quantity * unit_price - discount_amount)) <= 0.01",
    "currency_code": "length('USD') = 3",
}


@query("validate_sales", sql_with("sales", _rule_sql(SALES_RULES, "sales")))
def validate_sales(spark, d):
    sales = v.sales(spark, d, "quantity", "unit_price", "total_amount", "discount_amount", "warehouse_location", "order_status").withColumn("currency", F.lit("USD"))
    return qu.rule_failures(sales, {**qu.sales_rules(REGIONS), **qu.currency_rule()})


SUPPLIER_RULES = {
    "name_present": "length(supplier_name) >= 1",
    **{f"{c}_percent": f"{c} BETWEEN 0 AND 100" for c in ("on_time_delivery_rate", "quality_acceptance_rate", "cost_competitiveness_score")},
    "average_lead_time_days_non_negative": "average_lead_time_days >= 0",
    "total_orders_positive": "total_orders > 0",
    "total_value_positive": "total_value > 0",
}


@query("validate_suppliers", sql_with("suppliers", _rule_sql(SUPPLIER_RULES, "suppliers")))
def validate_suppliers(spark, d):
    return qu.rule_failures(v.suppliers(spark, d), qu.supplier_rules())


@query("unique_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_keys(spark, d):
    return qu.duplicate_keys(v.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("orphan_rows", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IS NOT NULL AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def orphan_rows(spark, d):
    return qu.orphans(v.table(spark, d, "customer"), "c_custkey", v.table(spark, d, "orders"), "o_custkey").select("c_custkey", "c_name")


# ---------------------------------------------------------------- KPIs

OVERVIEW_SQL = """months AS (SELECT strftime(order_date, '%Y-%m') AS month, count(DISTINCT l_orderkey) AS orders, round(sum(total_amount), 4) AS revenue, sum(quantity) AS units,
             count(*) FILTER (date_diff('day', order_date, ship_date) <= 60) / count(*) AS on_time_share FROM sales GROUP BY 1)"""


def _change_sql(c: str) -> str:
    return f"round(({c} - lag({c}) OVER w) / nullif(lag({c}) OVER w, 0) * 100, 4) AS {c}_change_pct"


def _overview(spark, d):
    return kpi.overview(v.sales(spark, d, "order_date", "ship_date", "l_orderkey", "total_amount", "quantity"))


@query("kpi_overview", sql_with("sales", f"WITH {OVERVIEW_SQL} SELECT *, {', '.join(map(_change_sql, ('orders', 'revenue', 'on_time_share')))} FROM months WINDOW w AS (ORDER BY month)"))
def kpi_overview(spark, d):
    return _overview(spark, d)


@query(
    "kpi_status",
    sql_with(
        "sales",
        f"""WITH {OVERVIEW_SQL} SELECT month, revenue, round((revenue - lag(revenue) OVER w) / lag(revenue) OVER w * 100, 4) AS change_percentage,
            CASE WHEN revenue > lag(revenue) OVER w THEN 'up' WHEN revenue < lag(revenue) OVER w THEN 'down' WHEN revenue = lag(revenue) OVER w THEN 'stable' END AS change_direction,
            CASE WHEN units >= 20000 THEN 'critical' WHEN units >= 18000 THEN 'warning' ELSE 'normal' END AS current_status FROM months WINDOW w AS (ORDER BY month)""",
    ),
)
def kpi_status(spark, d):
    months = _overview(spark, d).withColumn("_before", F.lag("revenue").over(Window.orderBy("month")))  # one row per month
    moved = sc.change(F.col("revenue"), F.col("_before"))
    return months.select(
        "month",
        "revenue",
        F.round(moved["change_percentage"], 4).alias("change_percentage"),
        moved["change_direction"].alias("change_direction"),
        sc.metric_status(F.col("units"), 18000, 20000).alias("current_status"),
    )


@query(
    "kpi_revenue_trend",
    sql_with(
        "daily",
        """SELECT entity_id, ds, y AS revenue, round(CASE WHEN count(*) OVER w = 7 THEN avg(y) OVER w END, 4) AS moving_average
           FROM daily WINDOW w AS (PARTITION BY entity_id ORDER BY ds ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    ),
)
def kpi_revenue_trend(spark, d):
    return kpi.revenue_trend(v.daily(spark, d))


@query("kpi_status_mix", sql_with("sales", "SELECT order_status, count(*) AS n, count(*) * 100 / sum(count(*)) OVER () AS share_pct FROM sales GROUP BY 1"))
def kpi_status_mix(spark, d):
    return kpi.status_mix(v.sales(spark, d, "order_status"))


@query(
    "kpi_stock_by_warehouse",
    sql_with("inventory", "SELECT warehouse_location, sum(quantity_on_hand) AS on_hand, sum(quantity_allocated) AS allocated, count(*) AS n_items FROM inventory GROUP BY 1"),
)
def kpi_stock_by_warehouse(spark, d):
    return kpi.stock_by_warehouse(v.inventory(spark, d))


@query("kpi_top_products", sql_with("sales", "SELECT product_id, round(sum(total_amount), 4) AS revenue FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def kpi_top_products(spark, d):
    return kpi.top_products(v.sales(spark, d, "product_id", "total_amount"))


@query(
    "stock_heatmap",
    sql_with(
        "inventory",
        "SELECT product_id, " + ", ".join(f"sum(quantity_on_hand) FILTER (warehouse_location = '{r}') AS \"{r}\"" for r in REGIONS) + " FROM inventory GROUP BY 1",
    ),
)
def stock_heatmap(spark, d):
    return kpi.stock_heatmap(v.inventory(spark, d), REGIONS)


@query(
    "report_periodic",
    sql_with(
        "sales",
        """WITH p AS (SELECT warehouse_location, date_trunc('week', order_date)::DATE AS d, count(*) AS lines, sum(quantity) AS units, round(sum(total_amount), 4) AS revenue FROM sales GROUP BY ALL),
        b AS (SELECT warehouse_location, unnest(generate_series(min(d)::TIMESTAMP, max(d)::TIMESTAMP, INTERVAL 7 DAY))::DATE AS d FROM p GROUP BY 1)
        SELECT warehouse_location, d + 6 AS period_end, coalesce(lines, 0) AS lines, coalesce(units, 0) AS units, coalesce(revenue, 0) AS revenue FROM b LEFT JOIN p USING (warehouse_location, d)""",
    ),
)
def report_periodic(spark, d):
    return kpi.periodic_report(v.sales(spark, d, "warehouse_location", "order_date", "total_amount", "quantity"), "W")


@query(
    "kpi_window_48h",
    """SELECT s AS window_start, s + INTERVAL 48 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total
       FROM (SELECT unnest(generate_series(date_trunc('hour', ts) - INTERVAL 47 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS s, event_type, value FROM events) GROUP BY ALL""",
)
def kpi_window_48h(spark, d):
    return kpi.rolling_totals(v.table(spark, d, "events"))


LATE = "20 days"


def land_in_quarters(spark, events, folder, late):
    """``events`` as files in four portions by time; rows that are ``late`` land with the next portion."""
    low, high = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    portion = F.least(F.floor((F.unix_micros("ts") - low) * 4 / F.lit(max(high - low, 1) + 1)) + late.cast("int"), F.lit(3))
    for i in range(4):
        events.filter(portion == i).repartition(2).write.mode("append").parquet(folder)
    return folder


# Windows that the watermark has closed: those that end ``LATE`` before the last event.
@query(
    "kpi_window_48h_stream",
    f"""WITH w AS (SELECT unnest(generate_series(date_trunc('hour', ts) - INTERVAL 47 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS s, event_type, value FROM events)
       SELECT s AS window_start, s + INTERVAL 48 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w
       WHERE s + INTERVAL 48 HOUR <= (SELECT max(ts) FROM events) - INTERVAL {LATE} GROUP BY ALL""",
)
def kpi_window_48h_stream(spark, d):
    # A tenth of the events lands a portion later than it happened, within the delay that the watermark allows.
    events = v.table(spark, d, "events").select("ts", "event_type", "value", "event_id").withColumn("ts", F.col("ts").cast("timestamp"))
    folder, out = scratch_path(spark, "windows-in"), scratch_path(spark, "windows-out")
    land_in_quarters(spark, events, folder, F.col("event_id") % 10 == 0)
    totals = jobs.rolling_totals_stream(jobs.parquet_chunks(spark, folder, events.schema, files_per_chunk=2), delay=LATE)
    jobs.write_stream(totals, f"{out}/data", f"{out}/state").awaitTermination()
    return spark.read.schema(totals.schema).parquet(f"{out}/data")


# ---------------------------------------------------------------- ETL


def _etl(spark, d, log=None):
    def steps(df):
        return cl.cleanse(df, ["Product ID"], ["Warehouse-Location"])

    loaders = {"stock": lambda: _raw_stock(spark, d), "returns": lambda: v.table(spark, d, "no_such_table")}
    return run_etl(spark, "stock", loaders, [steps, en.enrich], {"returns": "product_id BIGINT"}, as_of=F.lit(AS_OF), log_path=log)


@query(
    "etl_run",
    sql_with("inventory", f"WITH {CLEANSED} SELECT *, quantity_on_hand - quantity_allocated AS available_quantity FROM clean".replace("SELECT *, quantity_on_hand - quantity_allocated AS available_quantity", f"SELECT *, {DATE_SQL.format(c='last_restock', p='last_restock')}")),
)
def etl_run(spark, d):
    return _etl(spark, d).frames["stock"]


@query(
    "run_log",
    sql_with("inventory", f"WITH {CLEANSED} SELECT 'stock' AS pipeline_name, 'completed' AS status, count(*)::BIGINT AS records_processed, 0::BIGINT AS records_failed, 0::BIGINT AS records_skipped FROM clean"),
)
def run_log(spark, d):
    path = scratch_path(spark, "run-log")
    _etl(spark, d, path)
    return spark.read.parquet(path).select("pipeline_name", "status", "records_processed", "records_failed", "records_skipped")


@query(
    "etl_failed_source",
    """SELECT 'orders' AS source, count(*) AS n_rows, count(*) AS n_transformed, 0::BIGINT AS n_failed, false AS has_error FROM orders
       UNION ALL SELECT 'parts', count(*), 0, count(*), true FROM part""",
)
def etl_failed_source(spark, d):
    # The brands of parts are no numbers: the cast fails when its rows are written, and the raw rows go on; orders are not held up.
    def as_number(df):
        return df.withColumn("code", F.col("code").cast("int")) if "code" in df.columns else df.withColumn("year", F.year("o_orderdate"))

    loaders = {
        "parts": lambda: v.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("code")),
        "orders": lambda: v.table(spark, d, "orders").select("o_orderkey", "o_orderdate"),
    }
    run = run_etl(spark, "numbers", loaders, [as_number], validate=False)
    m = run.metrics
    counts = [
        frame.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("source"),
            "n_rows",
            F.lit(0 if name in run.errors else m["records_transformed"]).cast("long").alias("n_transformed"),
            F.lit(m["records_failed"] if name in run.errors else 0).cast("long").alias("n_failed"),
            F.lit(name in run.errors).alias("has_error"),
        )
        for name, frame in run.frames.items()
    ]
    return reduce(DataFrame.unionByName, counts)
