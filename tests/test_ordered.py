"""Hot-key forms give the same results as the plain windows and as NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stockflow.operators import ordered
from stockflow.operators import quantiles as qt
from stockflow.operators.anomaly_timeseries import rolling_scores
from stockflow.operators.enrich import add_lag_features
from stockflow.operators.ordered import forward_fill, over_entities, running_total


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds half of the rows, and one moment of that key a third of them."""
    rng = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({
        "k": np.where(np.arange(n) % 2 == 0, "hot", np.char.add("k", (np.arange(n) % 40).astype(str))),
        "t": np.where(np.arange(n) % 6 == 0, 50, rng.integers(0, 400, n)),
        "id": np.arange(n),
        "x": rng.integers(0, 1000, n).astype(float),
    })
    pdf["gap"] = pdf["x"].where(rng.random(n) < 0.05)
    return pdf, spark.createDataFrame(pdf.astype({"gap": object}).where(pdf.notna(), None), "k string, t long, id long, x double, gap double").repartition(7).checkpoint()


def _frame(df, columns):
    return df.select(*columns).toPandas().sort_values("id").reset_index(drop=True)


def test_running_total(skewed):
    pdf, df = skewed
    want = pdf.sort_values(["k", "t", "id"]).assign(s=lambda p: p.groupby("k")["x"].cumsum()).sort_values("id")["s"].to_numpy()
    got = _frame(running_total(df, "x", "s", ["k"], ["t", "id"]), ["id", "s"])["s"].to_numpy()
    np.testing.assert_allclose(got, want)
    whole = pdf.sort_values(["x", "id"], ascending=[False, True]).assign(s=lambda p: p["x"].cumsum()).sort_values("id")["s"].to_numpy()
    got = _frame(running_total(df, "x", "s", [], [F.col("x").desc(), F.col("id")]), ["id", "s"])["s"].to_numpy()
    np.testing.assert_allclose(got, whole)


@pytest.mark.parametrize("reach", [1, 29, 700])
def test_over_entities_with_a_hot_key(skewed, reach):
    _, df = skewed

    def make(w):
        return {"lagged": F.lag("x", reach).over(w), "total": F.sum("x").over(w.rowsBetween(-reach, 0))}

    plain = _frame(over_entities(df, ["k"], ["t", "id"], make, reach), ["id", "lagged", "total"])
    hot = _frame(over_entities(df, ["k"], ["t", "id"], make, reach, hot_rows=10), ["id", "lagged", "total"])
    pd.testing.assert_frame_equal(plain, hot)


@pytest.mark.parametrize("reach", [2, 29])
def test_over_entities_with_hundreds_of_segments(spark, monkeypatch, reach):
    # One key in segments of some three rows each; a second one beside it.
    df = spark.range(1200).selectExpr("id", "if(id % 40 = 7, NULL, 'hot') AS k", "(id * 7919) % 1200 AS t", "(id * 31) % 97 / 2 AS x").checkpoint()

    def make(w):
        return {"lagged": F.lag("x", reach).over(w), "total": F.sum("x").over(w.rowsBetween(-reach, 0))}

    plain = _frame(over_entities(df, ["k"], ["t"], make, reach), ["id", "lagged", "total"])
    monkeypatch.setattr(ordered, "HOT_ROWS", 3)
    hot = over_entities(df, ["k"], ["t"], make, reach, hot_rows=3)
    pd.testing.assert_frame_equal(plain, _frame(hot, ["id", "lagged", "total"]))


def test_reached_segments_by_brute_force(spark):
    rng = np.random.default_rng(6)
    tails = [(key, seg, int(rng.integers(1, 8))) for key in ("a", None) for seg in sorted(rng.choice(10_000, 2000, replace=False).tolist())]
    sizes = spark.createDataFrame(tails, f"k string, {ordered.SEG} long, _tail long")
    want = set()
    for key in ("a", None):
        own = [(s, n) for k, s, n in tails if k == key]
        for i, (s, _) in enumerate(own):
            after = 0
            for target, n in own[i + 1 :]:
                if after >= 7:
                    break
                want.add((key, s, target, after))
                after += n
    found = ordered._reached(sizes, ["k"], 7).collect()
    assert len(found) == len(want) and set(map(tuple, found)) == want


def test_forward_fill_with_a_hot_key(skewed):
    pdf, df = skewed
    want = pdf.sort_values(["k", "t", "id"]).assign(gap=lambda p: p.groupby("k")["gap"].ffill()).sort_values("id")["gap"].to_numpy(float)
    for limit in (10, 10**6):
        got = _frame(forward_fill(df, ["gap"], ["k"], ["t", "id"], hot_rows=limit), ["id", "gap"])["gap"].to_numpy(float)
        np.testing.assert_array_equal(got, want)


def test_lags_and_rolling_scores_with_a_hot_key(skewed):
    _, df = skewed
    sales = df.select(F.col("k").alias("product_id"), F.timestamp_seconds("t").alias("order_date"), "id", F.col("x").alias("total_amount"), (F.col("x") / 2).alias("quantity"))
    a, b = (add_lag_features(sales, ["id"], hot_rows=h).toPandas().sort_values("id").reset_index(drop=True) for h in (10, 10**6))
    pd.testing.assert_frame_equal(a[sorted(a)], b[sorted(b)])
    a, b = (_frame(rolling_scores(df, ["x"], "k", ["t", "id"], hot_rows=h), ["id", "x_rolling_z", "x_height"]) for h in (10, 10**6))
    pd.testing.assert_frame_equal(a, b)


PROBS = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("by", [[], ["k"]])
def test_quantiles_beyond_the_buffer(skewed, by):
    pdf, df = skewed
    forms = {
        "built-in": qt.exact_quantiles(df, ["x", "gap"], PROBS, by),
        "bracketed": qt.exact_quantiles(df, ["x", "gap"], PROBS, by, buffer_rows=5),
        "by rank": qt._by_rank(df, ["x", "gap"], PROBS, by),
    }
    groups = pdf.groupby("k") if by else [("all", pdf)]
    want = {key: {c: g[c].quantile(PROBS).to_numpy() if g[c].notna().any() else None for c in ("x", "gap")} for key, g in groups}
    for form, frame in forms.items():
        rows = {(r["k"] if by else "all"): r for r in frame.collect()}
        assert set(rows) == set(want), form
        for key, columns in want.items():
            for c, values in columns.items():
                if values is None:
                    assert rows[key][c] is None, form
                else:
                    np.testing.assert_allclose(rows[key][c], values, err_msg=f"{form} {key} {c}")


def test_quantiles_with_one_dominant_value(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 != 0, 7.0).otherwise(F.col("id").cast("double")).alias("x"))
    want = df.toPandas()["x"].quantile([0.25, 0.5, 0.95]).to_numpy()
    np.testing.assert_allclose(qt.exact_quantiles(df, ["x"], [0.25, 0.5, 0.95], buffer_rows=10).first()["x"], want)


def test_result_does_not_depend_on_partitioning(skewed):
    _, df = skewed
    totals = [_frame(running_total(df.repartition(n), "x", "s", ["k"], ["t", "id"]), ["id", "s"]) for n in (1, 13)]
    pd.testing.assert_frame_equal(*totals)


def test_window_reference(skewed):
    """The plain path is the ordinary window."""
    _, df = skewed
    w = Window.partitionBy("k").orderBy("t", "id")
    a = _frame(df.withColumn("p", F.lag("x").over(w)), ["id", "p"])
    b = _frame(over_entities(df, ["k"], ["t", "id"], lambda v: {"p": F.lag("x").over(v)}, 1), ["id", "p"])
    pd.testing.assert_frame_equal(a, b)
