import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stockflow.operators import anomaly_ensemble as ens
from stockflow.operators import anomaly_ml as ml
from stockflow.operators import anomaly_statistical as stat
from stockflow.operators import anomaly_timeseries as ts

SPIKE = [10, 11, 9, 10, 12, 10, 11, 9, 10, 100]


def _column(spark, values):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "id int, x double")


def _series(spark, values):
    return _column(spark, values).select(F.lit("a").alias("entity_id"), F.date_add(F.lit("2024-01-01"), "id").alias("ds"), F.col("x").alias("y"))


@pytest.mark.parametrize("method, flagged", [("modified_zscore", [100]), ("iqr", [100]), ("zscore", []), ("other", [])])
def test_statistical_methods(spark, method, flagged):
    df = _column(spark, SPIKE)
    out = stat.detect(df, stat.fit_statistics(df, ["x"]), method)
    assert [r.x for r in out.filter("is_anomaly").collect()] == flagged


def test_statistical_score_and_missing(spark):
    df = _column(spark, [*SPIKE, None])
    model = stat.fit_statistics(df, ["x"])
    assert (model.values["x_median"], model.values["x_mad"]) == (10, 1)
    rows = {r.id: r for r in stat.detect(df, model).collect()}
    assert rows[9].anomaly_score == 1 and rows[4].anomaly_score == pytest.approx(1.349 / 6)
    assert rows[10].anomaly_score == 0 and not rows[10].is_anomaly


def test_fit_on_history_detect_on_new_rows(spark):
    model = stat.fit_statistics(_column(spark, SPIKE), ["x"])
    new = spark.createDataFrame([(1.0, 50.0), (2.0, 10.0)], "other double, x double")
    assert [r.is_anomaly for r in stat.detect(new, model).orderBy("other").collect()] == [True, False]


def test_constant_column(spark):
    df = _column(spark, [5, 5, 5, 5, 6])
    assert [r.x for r in stat.detect(df, stat.fit_statistics(df, ["x"])).filter("is_anomaly").collect()] == [6]


def test_model_per_entity(spark):
    df = spark.createDataFrame([("a", float(v)) for v in SPIKE] + [("b", float(v) * 100) for v in SPIKE], "e string, x double")
    model = stat.fit_statistics(df, ["x"], ["e"])
    assert sorted(r.x for r in stat.detect(df, model).filter("is_anomaly").collect()) == [100, 10000]


@pytest.mark.parametrize("n, z, flagged", [(10, 2.8460, False), (12, 3.1754, True)])
def test_rolling_z_bound(spark, n, z, flagged):
    series = _series(spark, [1] * (n - 1) + [100])
    last = ts.rolling_scores(series, ["y"]).orderBy(F.desc("ds")).first()
    assert last.y_rolling_z == pytest.approx(z, abs=1e-4)
    assert ts.detect_series(series).orderBy(F.desc("ds")).first().is_anomaly is flagged


@pytest.mark.parametrize("values, want", [([0, 2, 1, 3, 3, 3, 1], [1, 4]), ([0, 2, 2, 0], [1]), ([3, 2, 1], []), ([1, 2, 2], []), ([0, 5, None, 5, 9], [1])])
def test_peaks(spark, values, want):
    out = ts.peaks(_series(spark, values)).withColumn("i", F.datediff("ds", F.lit("2024-01-01")))
    assert [r.i for r in out.filter("is_peak").orderBy("i").collect()] == want


def test_series_fit_needs_a_window(spark):
    assert ts.fit_series(_series(spark, range(29))).count() == 0
    row = ts.fit_series(_series(spark, range(40))).first()
    assert (row.trend, row.rolling_mean) == (pytest.approx(1), pytest.approx(24.5))
    factors = {r.position: r.factor for r in ts.seasonal_factors(_series(spark, range(14))).collect()}
    assert factors == {i: i + 3.5 for i in range(7)}


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 3))
    x[:, 1] += 0.8 * x[:, 0]
    x[:20] += 12 * np.sign(rng.normal(size=(20, 3)))
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id int, a double, b double, c double").repartition(5).checkpoint()


def test_detectors_find_planted_outliers(spark, planted):
    columns = ["a", "b", "c"]
    model = ml.fit_ml(planted, columns)
    out = ml.ml_detect(planted, model).toPandas().sort_values("id")
    outliers = out["id"] < 20
    for flag in ("forest_flag", "ellipse_flag", "ml_flag"):
        assert out.loc[outliers, flag].all(), flag
    for flag in ("forest_flag", "ellipse_flag", "pca_flag"):
        assert out[flag].mean() == pytest.approx(0.05, abs=0.002), flag
    assert out["ml_score"].between(0, 1).all()
    assert (out["ml_flag"] == (out["ml_votes"] >= 2)).all()
    assert out.loc[outliers, "ml_score"].min() > out.loc[~outliers, "ml_score"].median()


def test_forest_repeats_and_ignores_partitioning(spark, planted):
    def scores(df):
        return ml.forest_detect(df, ml.fit_forest(df, ml.fit_scaling(df, ["a", "b", "c"]))).toPandas().sort_values("id")["isolation"].to_numpy()

    np.testing.assert_allclose(scores(planted), scores(planted.repartition(3)))


def test_ellipse_resists_outliers(spark, planted):
    scaling = ml.fit_scaling(planted, ["a", "b", "c"])
    ellipse = ml.fit_ellipse(planted, scaling)
    clean = planted.filter("id >= 20").select(*[v.alias(str(i)) for i, v in enumerate(scaling.vector())]).toPandas().to_numpy()
    np.testing.assert_allclose(ellipse.location, clean.mean(axis=0), atol=0.1)
    np.testing.assert_allclose(np.linalg.inv(ellipse.precision), np.cov(clean.T), rtol=0.35, atol=0.05)


def test_single_feature_is_never_flagged(spark, planted):
    out = ml.ml_detect(planted, ml.fit_ml(planted, ["a"]))
    assert out.filter("ml_flag OR ml_score > 0").count() == 0


def test_scaling_fills_with_the_median(spark):
    df = _column(spark, [1, 2, 3, 4, None])
    out = ml.scale(df, ml.fit_scaling(df, ["x"])).orderBy("id").collect()
    assert out[-1].x_scaled == 0 and out[0].x_scaled == pytest.approx(-1.5)


def test_records(spark):
    rows = [(f"p{i}", "2024-01-01", float(v), float(i % 3)) for i, v in enumerate(SPIKE)]
    df = spark.createDataFrame(rows, "product_id string, d string, total_amount double, quantity double").withColumn("d", F.to_timestamp("d"))
    model = stat.fit_statistics(df, ["quantity", "total_amount"])
    scored = ens.ensemble_score(stat.detect(df, model), {"statistical": "anomaly_score"}, rescale=True)
    (r,) = ens.anomaly_records(scored, model, "product_id", "d").collect()
    assert (r.metric_name, r.entity_id, r.actual_value, r.expected_value) == ("total_amount", "p9", 100, 10)
    assert (r.severity, r.confidence_score, r.deviation_percentage, r.z_score) == ("critical", 1, 100, 3)
    assert r.recommendation.startswith("Investigate unusual transaction amounts.") and r.recommendation.endswith("immediately.")
    assert [f.factor for f in r.contributing_factors] == ["total_amount"] and r.contributing_factors[0].impact == "moderate"


def test_full_weights_do_not_rescale(spark):
    df = spark.createDataFrame([(1.0, 0.5, None)], "s double, m double, t double")
    row = ens.ensemble_score(df, {"statistical": "s", "ml": "m", "timeseries": "t"}).first()
    assert row.ensemble_score == pytest.approx(0.35 + 0.2)


def test_first_row_of_a_series_scores_zero(spark):
    rows = ts.detect_series(_series(spark, [100, 1, 1, 2])).orderBy("ds").collect()
    assert rows[0].anomaly_score == 0 and not rows[0].is_anomaly


class Above:
    """A user detector: everything over a fitted share of the maximum."""

    def fit(self, df):
        return df.agg(F.max("x")).first()[0]

    def score(self, df, model):
        return df.withColumns({"above": F.col("x") > 0.5 * model, "above_score": F.least(F.col("x") / model, F.lit(1.0))})


def test_user_detector_joins_the_ensemble(spark):
    df = _column(spark, SPIKE)
    mine = Above()
    scored = stat.detect(mine.score(df, mine.fit(df)), stat.fit_statistics(df, ["x"]))
    out = ens.ensemble_score(scored, {"statistical": "anomaly_score", "above": "above_score"}, rescale=True)
    assert [r.x for r in out.filter("ensemble_score > 0.5").collect()] == [100]


def test_forest_draws_equal_rows_by_their_count(spark):
    # Two thirds of the rows are equal: every tree still takes about 256 rows, few of them different.
    rng, apart = np.random.default_rng(1), np.arange(60_000) % 3 == 0
    df = spark.createDataFrame(pd.DataFrame({"a": np.where(apart, rng.normal(size=60_000), 5.0), "b": np.where(apart, rng.normal(size=60_000), 7.0)}))
    scaling = ml.fit_scaling(df, ["a", "b"])
    drawn = ml.draw(df, scaling).toPandas()
    taken = drawn.groupby("tree")["many"].sum()
    assert len(taken) == ml.TREES and taken.between(190, 330).all() and abs(taken.mean() - 256) < 4
    repeated = drawn[drawn["many"] > 20].groupby("tree")["many"].sum()
    assert abs(repeated.mean() - 256 * 2 / 3) < 4 and 8 < repeated.std() < 18  # binomial: 171 and 13
    assert drawn.groupby("tree").size().max() < 150


def test_binomial_draws_follow_the_distribution(spark):
    # The inverse distribution at evenly spaced points gives its mean and variance.
    rows = spark.range(4000).selectExpr("(id + 0.5D) / 4000 AS u", "5000L AS copies").withColumn("none", F.exp(F.col("copies") * math.log1p(-0.01)))
    k = rows.select(ml._binomial(F.col("u"), F.col("copies"), F.col("none"), 0.01).alias("k")).toPandas()["k"]
    assert abs(k.mean() - 50) < 0.1 and abs(k.var() - 49.5) < 0.6


def test_ellipse_takes_few_scans(spark, planted, monkeypatch):
    scans = []
    plain = ml._binned
    monkeypatch.setattr(ml, "_binned", lambda *a: scans.append(1) or plain(*a))
    ml.fit_ellipse(planted, ml.fit_scaling(planted, ["a", "b", "c"]))
    assert 2 <= len(scans) <= ml.STEPS + 1


def test_a_record_names_the_five_strongest_factors(spark):
    """Of eight metrics all stand out in one row: five are named, the strongest first, and only they count as high."""
    names = [f"m{i}" for i in range(8)]
    rows = [tuple(float((k * (i + 3)) % 7) for i in range(8)) for k in range(400)] + [tuple(100.0 * (i + 1) for i in range(8))]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], ["id", *names]).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    model = stat.fit_statistics(df, names)
    scored = ens.ensemble_score(stat.detect(df, model, score="s"), {"statistical": "s"}, rescale=True)
    record = ens.anomaly_records(scored, model, "id", "ts").filter("entity_id = '400'").first()
    sigmas = [abs(f.deviation_sigma) for f in record.contributing_factors]
    assert len(sigmas) == 5 and sigmas == sorted(sigmas, reverse=True) and record.severity == "critical"
