import numpy as np
import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from stockflow.functions import scalars as sc
from stockflow.operators import aggregate as agg
from stockflow.operators import cleanse as cl
from stockflow.operators import enrich as en
from stockflow.operators import quality as qu
from stockflow.operators.normalize import normalize
from stockflow.plans.etl import QualityError, run_etl
from stockflow.plans.schemas import TABLES, table_schema
from stockflow.session import scratch_path
from stockflow.sources import files, sinks


# ---------------------------------------------------------------- cleansing


def test_standard_names(spark):
    assert cl.standard_name(" Unit-Price (USD)") == "unit_price__usd_"
    with pytest.raises(ValueError, match="a_b"):
        cl.standardize_names(spark.createDataFrame([(1, 2)], "`a-b` int, `A b` int"))


def test_iqr_trim(spark):
    df = spark.createDataFrame([(float(x),) for x in [10, 11, 9, 10, 12, 10, 11, 9, 10, 100]], "x double")
    assert cl.remove_outliers_iqr(df).agg(F.max("x")).first()[0] == 12
    few = spark.createDataFrame([(float(x),) for x in [1, 1, 1, 2, 1000]], "x double")
    assert cl.remove_outliers_iqr(few).count() == 5


def test_sequential_trim_depends_on_order(spark):
    rows = [(float(i % 9), float(i % 7)) for i in range(60)] + [(500.0, 90.0), (4.0, 30.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert cl.remove_outliers_iqr(df).count() == 60
    assert cl.remove_outliers_iqr(df, ["a", "b"], sequential=True).count() == 60


def test_zscore_trim_keeps_missing(spark):
    df = spark.createDataFrame([(float(i % 10),) for i in range(100)] + [(1000.0,), (None,)], "x double")
    out = cl.remove_outliers_zscore(df)
    assert out.count() == 101 and out.filter("x IS NULL").count() == 1


def test_fill_missing(spark):
    rows = [(i, None if i < 3 else float(i), None if i == 1 else ("b" if i % 2 else "a"), None if i == 2 else f"t{i}", None if i < 20 else "rare", dt.datetime(2024, 1, 1 + i) if i != 5 else None) for i in range(24)]
    df = spark.createDataFrame(rows, "id int, num double, few string, many string, sparse string, at timestamp")
    audit = cl.Audit()
    out = {r.id: r for r in cl.fill_missing(df, order=["id"], audit=audit).collect()}
    assert "sparse" not in out[0].asDict()
    assert out[0].num == 13.0 and out[1].few == "a" and out[2].many == "UNKNOWN" and out[5].at == dt.datetime(2024, 1, 5)
    assert audit.steps == [("drop_column", "sparse"), ("fill_median", "num"), ("fill_forward", "at"), ("fill_mode_or_unknown", "few"), ("fill_mode_or_unknown", "many")]
    kept = cl.fill_missing(df).filter("id = 5").first()
    assert kept.at is None


def test_type_repair(spark):
    rows = [("1", "2024-01-05", "x"), (" 2.5", "no date", "3"), ("-3", None, "y"), ("4", "2024-02-06 10:00:00", "z"), ("5", None, "w"), ("bad", None, "v")]
    out = cl.repair_types(spark.createDataFrame(rows, "n string, d string, s string")).collect()
    assert [r.n for r in out] == [1, 2.5, -3, 4, 5, None]
    assert [r.d for r in out][:4] == [dt.datetime(2024, 1, 5), None, None, dt.datetime(2024, 2, 6, 10)]
    assert [r.s for r in out][0] == "x"


def test_cleanse_order(spark):
    """Text that holds numbers gets the median by default, a text fill in the compatible order."""
    rows = [(str(i), i % 4) for i in range(30)] * 2 + [(None, 1)]
    df = spark.createDataFrame(rows, "`N Value` string, g int")
    default = cl.cleanse(df)
    assert default.count() == 31 and default.agg(F.percentile("n_value", 0.5)).first()[0] == 14.5
    assert default.filter("n_value = 14.5").count() == 1
    compat = cl.cleanse(df, compat=True)
    assert compat.filter("n_value IS NULL").count() == 1


# ---------------------------------------------------------------- features and aggregation


def test_weekly_resample(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 3), 1.0), ("a", dt.date(2024, 1, 17), 2.0), (None, dt.date(2024, 1, 3), 9.0)], "g string, order_date date, v double")
    weekly = agg.aggregate(df, ["g"], {"v": "sum"}, "W").orderBy("order_date").collect()
    assert [(r.order_date, r.v) for r in weekly] == [(dt.date(2024, 1, 7), 1), (dt.date(2024, 1, 14), 0), (dt.date(2024, 1, 21), 2)]


def test_monthly_resample(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 3), 1.0), ("a", dt.date(2024, 3, 17), 2.0)], "g string, order_date date, v double")
    monthly = agg.aggregate(df, ["g"], {"v": ["mean", "count", "median"]}, "M").orderBy("order_date").collect()
    assert [(r.order_date, r.v_mean, r.v_count, r.v_median) for r in monthly] == [
        (dt.date(2024, 1, 31), 1, 1, 1), (dt.date(2024, 2, 29), None, 0, None), (dt.date(2024, 3, 31), 2, 1, 2),
    ]


def test_month_end_does_not_drift(spark):
    df = spark.createDataFrame([("a", dt.date(2023, 1, 31), 1.0), ("a", dt.date(2023, 12, 31), 1.0)], "g string, order_date date, v double")
    assert agg.aggregate(df, ["g"], {"v": "count"}, "M").count() == 12


def test_unknown_aggregate(spark):
    with pytest.raises(ValueError, match="mystery"):
        agg.aggregate(spark.range(1), ["id"], {"id": "mystery"})


def test_enrich_skips_what_it_cannot_compute(spark):
    df = spark.createDataFrame([(1.0, 2, 10, 0)], "unit_price double, quantity int, quantity_on_hand int, quantity_allocated int")
    assert en.enrich(df).columns == df.columns
    dated = en.enrich(df.withColumn("order_date", F.to_timestamp(F.lit("2024-12-30")))).first()
    assert (dated.revenue, dated.transaction_year_month, dated.order_week_of_year, dated.order_day_of_week) == (2.0, "2024-12", 1, 0)


def test_inventory_features_divide_by_zero(spark):
    df = spark.createDataFrame([("a", 0, 5, 0.0)], "product_id string, quantity_on_hand int, quantity_allocated int, quantity double")
    row = en.add_inventory_features(df).first()
    assert (row.available_quantity, row.allocation_rate, row.stock_coverage_days) == (-5, None, None)


def test_scalars(spark):
    rows = spark.createDataFrame([(None,), (0.0,), (15.0,), (30.0,)], "d double").select(sc.stockout_risk(F.col("d")).alias("r")).collect()
    assert [r.r for r in rows] == [0.5, 1, 0.5, 0]
    score = spark.range(1).select(sc.supplier_score(F.lit(95.0), F.lit(98.0), F.lit(10.0), F.lit(80.0), F.lit(90.0)).alias("s")).first().s
    assert score == 84.0
    margins = spark.createDataFrame([(10.0, 4.0), (0.0, 1.0)], "p double, c double").select(sc.margin_pct(F.col("p"), F.col("c")).alias("m")).collect()
    assert [r.m for r in margins] == [60, 0]
    labels = spark.createDataFrame([(x,) for x in (0.4, 0.7, 1.2, -0.7, -1.0)], "s double").select(sc.skewness_label(F.col("s")).alias("l")).collect()
    assert [r.l for r in labels] == ["approximately_symmetric", "right_skewed", "highly_right_skewed", "left_skewed", "highly_left_skewed"]
    strengths = spark.createDataFrame([(x,) for x in (-0.8, 0.6, 0.45, 0.2, 0.1)], "r double").select(sc.correlation_strength(F.col("r")).alias("l")).collect()
    assert [r.l for r in strengths] == ["very_strong", "strong", "moderate", "weak", "very_weak"]


def test_normalize(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0), ("b", 10.0, 5.0)], "g string, x double, flat double")
    out = normalize(df).orderBy("x").collect()
    assert [r.x_normalized for r in out] == [0, pytest.approx(2 / 9), 1] and [r.flat_normalized for r in out] == [None] * 3
    assert normalize(df, ["nope"]).columns == df.columns
    by = {(r.g, r.x): r.x_normalized for r in normalize(df, ["x"], by=["g"]).collect()}
    assert by == {("a", 1): 0, ("a", 3): 1, ("b", 10): None}


# ---------------------------------------------------------------- quality


def test_validators(spark):
    df = spark.createDataFrame([("SKU-1", "n", "other", 5.0, 4.0, 3), ("x", "", "toys", 0.0, 4.0, None)], "sku string, name string, category string, unit_price double, unit_cost double, lead_time_days int")
    good, bad = qu.split_valid(df, qu.product_rules())
    assert good.count() == 1
    assert bad.first().failed_rules == ["sku_format", "name_length", "category_known", "unit_price_positive", "lead_time_days_positive", "price_covers_cost"]


def test_quality_report(spark):
    rows = [(1, -1, dt.datetime(2024, 1, 1)), (1, -1, dt.datetime(2024, 1, 1)), (2, 3, dt.datetime(2030, 1, 1)), (3, 3, None)]
    df = spark.createDataFrame(rows, "id int, quantity int, order_date timestamp")
    report = {r.check_name: r for r in qu.quality_checks(df, "t", F.lit(dt.datetime(2025, 1, 1))).collect()}
    assert [(report[c].passed, report[c].failed_records) for c in ("no_duplicates", "no_negative_quantities", "no_future_dates")] == [(False, 1), (False, 2), (False, 2)]
    assert report["data_completeness"].passed and report["data_completeness"].failed_records == 1
    free = {r.check_name: r.passed for r in qu.quality_checks(spark.range(5), "t", F.current_timestamp()).collect()}
    assert all(free.values())


def test_orphans_and_duplicate_keys(spark):
    child = spark.createDataFrame([(1,), (1,), (9,), (None,)], "p int")
    assert [r.p for r in qu.orphans(child, "p", spark.createDataFrame([(1,)], "id int"), "id").collect()] == [9]
    assert [(r.p, r.n_rows) for r in qu.duplicate_keys(child, ["p"]).collect()] == [(1, 2)]


# ---------------------------------------------------------------- sources and ETL


def test_csv_with_gzip_bom_and_semicolons(spark, tmp_path):
    path = tmp_path / "orders.csv.gz"
    path.write_bytes(gzip.compress("﻿order id;amount;day\n1;2.5;2024-01-01\n2;NaN;2024-01-02\n".encode()))
    assert files.infer_delimiter(spark, str(path)) == ";"
    df = files.csv_scan(spark, str(path), delimiter=";")
    assert df.columns == ["order id", "amount", "day"]
    assert [r.amount for r in df.orderBy("order id").collect()] == [2.5, None]
    with pytest.raises(ValueError, match="nope"):
        files.csv_scan(spark, str(path), delimiter=";", filters={"nope": 1})


def test_csv_round_trip(spark):
    path = scratch_path(spark, "csv")
    df = spark.createDataFrame([(1, "a,b", dt.datetime(2024, 1, 1, 2, 3, 4)), (2, None, None)], "id int, name string, at timestamp")
    sinks.write_csv(df, path)
    assert sorted(map(tuple, files.csv_scan(spark, path, df.schema).collect())) == sorted(map(tuple, df.collect()))


def test_json_pages_stop_at_the_first_last_page(spark, tmp_path):
    bodies = ['{"results": [{"id": 1}], "has_next": true}', '{"data": [{"id": 2}, {"id": 3}], "next": null}', '{"results": [{"id": 4}]}']
    for i, body in enumerate(bodies, 1):
        (tmp_path / f"page-{i:04d}.json").write_text(body)
    pages = files.read_pages(spark, str(tmp_path))
    assert sorted(r.id for r in files.json_pages(pages, "id INT").collect()) == [1, 2, 3]
    assert sorted(r.id for r in files.json_pages(pages, "id INT", max_pages=1).collect()) == [1]


def test_json_page_shapes_per_source(spark):
    rows = [
        ("list", 1, '[{"id": 1}, {"id": 2}]'), ("list", 2, '[{"id": 3}]'),
        ("empty", 1, '{"results": [{"id": 5}], "next": "x"}'), ("empty", 2, '{"results": []}'), ("empty", 3, '{"results": [{"id": 6}]}'),
        ("broken", 1, '{"data": [{"id": 7}], "has_next": true}'), ("broken", 2, "not json"), ("broken", 3, '{"data": [{"id": 8}]}'),
    ]
    pages = spark.createDataFrame(rows, "source string, page bigint, body string")
    got = {(r.source, r.id) for r in files.json_pages(pages, "id INT", by=["source"]).collect()}
    assert got == {("list", 1), ("list", 2), ("empty", 5), ("broken", 7)}


def test_sql_scan_keeps_columns_when_empty(spark):
    out = files.sql_scan(spark, "SELECT id, id + :n AS m FROM numbers WHERE id > :low", {"n": 5, "low": 100}, {"numbers": spark.range(3)})
    assert out.columns == ["id", "m"] and out.count() == 0


def test_run_etl_policies(spark):
    log = scratch_path(spark, "log")

    def broken(df):
        return df.select("no_such_column") if "b" in df.columns else df.withColumn("c", F.lit(1))

    loaders = {"good": lambda: spark.range(4).toDF("a"), "bad": lambda: spark.range(3).toDF("b"), "gone": lambda: spark.table("no_such_table")}
    run = run_etl(spark, "p", loaders, [broken], {"gone": "x INT"}, log_path=log)
    assert run.status == "completed" and set(run.errors) == {"bad", "gone"}
    assert run.frames["good"].columns == ["a", "c"] and run.frames["bad"].columns == ["b"] and run.frames["gone"].columns == ["x"]
    m = run.metrics
    assert (m["sources_processed"], m["records_extracted"], m["records_transformed"], m["records_failed"]) == (3, 7, 4, 3)
    row = spark.read.parquet(log).first()
    assert (row.status, row.records_processed, row.records_failed) == ("completed", 4, 3)
    assert row.run_metadata["transformations_applied"] == str(m["transformations_applied"])


def test_run_etl_can_fail_on_a_check(spark):
    log = scratch_path(spark, "log")
    twice = lambda: spark.range(2).unionByName(spark.range(2))
    with pytest.raises(QualityError, match="no_duplicates"):
        run_etl(spark, "p", {"s": twice}, [], fail_on=["no_duplicates"], log_path=log)
    assert spark.read.parquet(log).first().status == "failed"
    assert run_etl(spark, "p", {"s": twice}, []).metrics["quality_checks_failed"] == 1


def test_table_schemas_parse(spark):
    for name in TABLES:
        assert table_schema(name).fields


def test_user_aggregates_in_steps(spark, monkeypatch):
    from stockflow.operators import aggregate as agg

    monkeypatch.setattr(agg, "HELD", 3)  # states are passed on often
    rows = [("a", i % 7, None if i % 5 == 0 else float(i)) for i in range(500)] + [("b", 1, None), (None, 1, 5.0), ("c", None, 6.0)]
    df = spark.createDataFrame(rows, "k string, m int, x double").repartition(9)
    total = agg.Mergeable("total", [0.0, 0.0], lambda s, x: [s[0] + x.sum(), s[1] + len(x)], lambda a, b: [a[0] + b[0], a[1] + b[1]], lambda s: s[0] / s[1] if s[1] else None)
    found = {r.k: (r.x_total, r.x_count) for r in agg.aggregate(df, ["k"], {"x": [total, "count"]}).collect()}
    values = [x for k, _, x in rows if k == "a" and x is not None]
    assert found == {"a": (sum(values) / len(values), len(values)), "b": (None, 0), "c": (6.0, 1)}
    two = {(r.k, r.m): r.x for r in agg.aggregate(df, ["k", "m"], {"x": total}).collect()}
    assert len(two) == 8 and two["a", 3] == np.mean([x for k, m, x in rows if m == 3 and x is not None and k == "a"])
    direct = agg.merged(df, ["k", "m"], [("x", total, "x")]).collect()  # null keys are keys
    assert len(direct) == len({(k, m) for k, m, _ in rows}) and {r.x for r in direct if r.m is None} == {6.0}
    assert agg.merged(df.filter("false"), ["k"], [("x", total, "x")]).count() == 0
