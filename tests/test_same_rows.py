"""The same rows at every size: limits that choose between plans do not change results, NULL keys included."""

import pytest
from pyspark.sql import functions as F

from stockflow.operators import stats as st
from stockflow.operators.anomaly_statistical import detect, fit_statistics
from stockflow.operators.ordered import forward_fill, over_entities, running_total
from stockflow.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def rows(spark):
    """600 rows of three keys, one of them NULL, with gaps."""
    key = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit("a")).otherwise(F.lit("b"))
    value = F.when(F.col("id") % 4 != 0, (F.col("id") * 7919 % 1009).cast("double"))
    return spark.range(600).select(key.alias("k"), F.col("id").alias("t"), value.alias("v")).repartition(8).cache()


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_forward_fill(rows):
    low, high = (_rows(forward_fill(rows, ["v"], ["k"], ["t"], hot_rows=n)) for n in (10, None))
    assert low == high and len(low) == 600


def test_lags(rows):
    lag = lambda w: {"before": F.lag("v", 3).over(w)}
    low, high = (_rows(over_entities(rows, ["k"], ["t"], lag, 3, hot_rows=n)) for n in (10, None))
    assert low == high


def test_running_total(rows):
    got = {(r.k, r.t): r.upto for r in running_total(rows, "t", "upto", ["k"], ["t"]).collect()}
    total, expected = {}, {}
    for r in rows.orderBy("t").collect():
        total[r.k] = total.get(r.k, 0) + r.t
        expected[r.k, r.t] = total[r.k]
    assert got == expected


def test_quantiles(rows):
    low, high = (_rows(exact_quantiles(rows, ["v"], [0.1, 0.5, 0.9], ["k"], buffer_rows=n)) for n in (10, 10**9))
    assert low == high and len(low) == 3


def test_models_of_null_entities(rows):
    flagged = detect(rows, fit_statistics(rows, ["v"], ["k"]), threshold=1.0)
    assert {r.k for r in flagged.filter("anomaly_score > 0").collect()} == {None, "a", "b"}
    assert flagged.count() == 600


def test_abc_with_negative_and_zero_totals(spark):
    df = spark.createDataFrame([("x", 100.0), ("y", 50.0), ("z", -60.0)], "item string, v double")
    shares = {r.item: (r.value_pct, r.cumulative_pct, r.abc_class) for r in st.abc_analysis(df, "v", "item").collect()}
    assert shares["x"][0] == pytest.approx(100 / 0.9) and shares["z"][1] == pytest.approx(100) and shares["z"][2] == "C"
    zero = st.abc_analysis(df.union(spark.createDataFrame([("w", -90.0)], df.schema)), "v", "item").collect()
    assert [(r.value_pct, r.abc_class) for r in zero] == [(None, "C")] * 4
    assert st.abc_analysis(df.filter("false"), "v", "item").count() == 0


def test_describe_nan_and_empty(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "v double")
    row = st.describe(df).first()
    assert (row["count"], row.missing, row.missing_pct, row["mean"]) == (2, 2, 50.0, 2.0)
    assert st.describe(df.filter("false")).first().missing_pct is None


def test_series_figures(rows):
    from stockflow.operators import anomaly_timeseries as ts

    for make in (
        lambda hot: ts.fit_series(rows, "v", "k", "t", 30, hot_rows=hot).select("k", "n", *[F.round(c, 9) for c in ("rolling_mean", "rolling_std", "trend")]),
        lambda hot: ts.seasonal_factors(rows, "v", "k", "t", hot_rows=hot).withColumn("factor", F.round("factor", 9)),
        lambda hot: ts.peaks(rows.withColumn("v", F.floor(F.col("v") / 300)), "v", "k", ["t"], hot_rows=hot),
        lambda hot: ts.rolling_scores(rows, ["v"], "k", ["t"], hot_rows=hot).select("k", "t", F.round("v_rolling_z", 6)),
    ):
        assert _rows(make(10)) == _rows(make(None))
