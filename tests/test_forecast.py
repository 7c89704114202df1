import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stockflow.operators import forecast as fc

Y = [10, 12, 14, 13, 15, 18, 20, 17, 19, 21, 20, 22, 25, 27]


def _series(spark, **entities):
    rows = [(e, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(v)) for e, values in entities.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "entity_id string, ds date, y double")


def _path(df):
    return [r.predicted for r in df.orderBy("step").collect()]


def test_holt_winters_compat(spark):
    out = fc.forecast_holt_winters(_series(spark, a=Y), 3, compat=True)
    assert _path(out) == [11, 12, 13]
    first = out.orderBy("step").first()
    assert first.ds == dt.date(2024, 1, 15)
    assert first.upper_95 - first.predicted == pytest.approx(1.959963984540054)


def test_holt_winters_recursion(spark):
    """The column recursion equals a direct loop."""
    rng = np.random.default_rng(5)
    y = 100 + np.arange(60) + 10 * np.sin(np.arange(60) * 2 * np.pi / 7) + rng.normal(size=60)
    a, b, g = 0.4, 0.2, 0.3
    level, trend, seasonal, sse = y[0], (y[7] - y[0]) / 7, np.ones(7), 0.0
    for i in range(7, 60):
        base, s = level + trend, seasonal[i % 7]
        sse += (y[i] - base * s) ** 2
        new = a * y[i] / s + (1 - a) * base
        trend = b * (new - level) + (1 - b) * trend
        seasonal[i % 7] = g * y[i] / new + (1 - g) * s
        level = new
    series = _series(spark, a=y)
    row = fc.holt_winters_state(series, (a, b, g)).first()
    assert (row.level, row.trend, row.sse) == (pytest.approx(level), pytest.approx(trend), pytest.approx(sse))
    np.testing.assert_allclose(row.seasonal, seasonal)
    want = [(level + h * trend) * seasonal[(59 + h) % 7] for h in range(1, 9)]
    assert _path(fc.forecast_holt_winters(series, 8, (a, b, g))) == pytest.approx(want)


def test_holt_winters_search_beats_the_start(spark):
    y = 100 + np.arange(80) + 15 * np.sin(np.arange(80) * 2 * np.pi / 7)
    series = _series(spark, a=y, short=y[:10])
    fitted = fc.fit_holt_winters(series).collect()
    assert [r.entity_id for r in fitted] == ["a"]
    assert fitted[0].sse <= fc.holt_winters_state(series).first().sse
    again = fc.holt_winters_state(series, fc.fit_holt_winters(series)).first()
    assert again.sse == pytest.approx(fitted[0].sse)
    assert all(0.01 <= v <= 0.99 for v in (again.alpha, again.beta, again.gamma))


def test_holt_winters_with_zeros(spark):
    assert all(np.isfinite(_path(fc.forecast_holt_winters(_series(spark, a=[0] * 20), 3))))


@pytest.mark.parametrize("weighted, compat, want", [(False, False, 21.571429), (True, False, 23.107143), (True, True, 20.035714)])
def test_moving_average(spark, weighted, compat, want):
    assert _path(fc.forecast_moving_average(_series(spark, a=Y), 2, weighted=weighted, compat=compat)) == pytest.approx([want] * 2, abs=1e-6)


def test_moving_average_of_a_short_series(spark):
    assert _path(fc.forecast_moving_average(_series(spark, a=[3, 6]), 1)) == [pytest.approx(5.0)]


def test_ar1(spark):
    series = _series(spark, a=Y)
    row = fc.fit_ar1(series).first()
    assert row.coefficients == pytest.approx([1.470588, -0.176471], abs=1e-6)
    general = fc.fit_autoregression(series, p=1).first()
    assert general.coefficients == pytest.approx(row.coefficients) and general.sigma == pytest.approx(row.sigma)
    assert _path(fc.forecast_autoregression(series, 1, p=1)) == [pytest.approx(28.117647, abs=1e-6)]
    assert _path(fc.forecast_autoregression(series, 1, p=1, compat=True)) == [pytest.approx(1.117647, abs=1e-6)]


def test_ar3_against_least_squares(spark):
    rng = np.random.default_rng(2)
    y = np.cumsum(rng.normal(size=80)) + 50
    z = np.diff(y)
    x = np.column_stack([np.ones(len(z) - 3), z[2:-1], z[1:-2], z[:-3]])
    beta = np.linalg.lstsq(x, z[3:], rcond=None)[0]
    row = fc.fit_autoregression(_series(spark, a=y)).first()
    assert row.coefficients == pytest.approx(beta.tolist())
    assert row.sigma == pytest.approx(np.std(z[3:] - x @ beta))
    history, level, want = list(z), y[-1], []
    for _ in range(5):
        step = beta @ [1, history[-1], history[-2], history[-3]]
        history.append(step)
        level += step
        want.append(level)
    assert _path(fc.forecast_autoregression(_series(spark, a=y), 5)) == pytest.approx(want)


def test_second_differences(spark):
    y = [float(i * i + (i % 3)) for i in range(30)]
    path = _path(fc.forecast_autoregression(_series(spark, a=y), 2, p=2, d=2))
    assert path == pytest.approx([30 * 30 + 0, 31 * 31 + 1], abs=2.5)


def test_ensemble_renormalises(spark):
    series = _series(spark, a=Y, short=Y[:8])
    out = fc.forecast_ensemble(series, 2, p=1)
    hw, ma, ar = (fc.forecast_holt_winters(series, 2), fc.forecast_moving_average(series, 2), fc.forecast_autoregression(series, 2, 1))
    one = lambda df, e: _path(df.filter(F.col("entity_id") == e))
    want = [0.4 * h + 0.2 * m + 0.4 * a for h, m, a in zip(one(hw, "a"), one(ma, "a"), one(ar, "a"))]
    assert one(out, "a") == pytest.approx(want)
    assert one(out, "short") == pytest.approx([(0.2 * m + 0.4 * a) / 0.6 for m, a in zip(one(ma, "short"), one(ar, "short"))])
    single = fc.ensemble({"moving_average": fc.forecast_moving_average(series, 1)}).filter("entity_id = 'a'").first()
    assert single.upper_80 - single.predicted == pytest.approx(1.2815515655446004 * 0.1 * single.predicted)


def test_autocorrelation_and_records(spark):
    series = _series(spark, a=Y)
    lags = {r.lag: r.acf for r in fc.autocorrelation(series).collect()}
    assert lags[1] == pytest.approx(0.918687, abs=1e-5)
    assert lags == {k: pytest.approx(pd.Series(Y, dtype=float).autocorr(k)) for k in range(1, 7)}
    rows = fc.forecast_records(series, fc.forecast_holt_winters(series, 3, compat=True), "revenue").collect()
    assert {r.trend_direction for r in rows} == {"increasing"} and len(rows) == 3
    flat = fc.forecast_records(series, fc.forecast_moving_average(series, 3), "revenue").first()
    assert flat.trend_direction == "stable" and flat.seasonality_strength == pytest.approx(max(abs(v) for v in lags.values()))


def test_evaluate(spark):
    df = spark.createDataFrame([(100.0, 90.0), (0.0, 5.0), (50.0, 55.0), (None, 1.0)], "actual double, predicted double")
    row = fc.evaluate(df).first()
    assert (row.mape, row.mae, row.rmse) == (10.0, 6.67, 7.07)
