"""Queries: correlation, trend, ABC, group tests, normality, descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockflow.operators import stats as st
from stockflow.plans import views as v
from stockflow.plans.registry import query
from stockflow.plans.views import sql_with
from stockflow.session import materialize, widen

CORRELATED = ["quantity", "unit_price", "discount_amount", "total_amount"]
PAIRS = [(a, b) for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1 :]]
STRENGTH = "CASE WHEN abs(r) >= 0.8 THEN 'very_strong' WHEN abs(r) >= 0.6 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' WHEN abs(r) >= 0.2 THEN 'weak' ELSE 'very_weak' END"
AVERAGE_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
PERIOD_SERIES = """m AS (SELECT warehouse_location AS entity_id, date_trunc('month', order_date)::DATE AS ds, avg(total_amount) AS y FROM sales GROUP BY ALL),
       s AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ds) - 1 AS i FROM m)"""


def _pairs_sql(source: str) -> str:
    rows = " UNION ALL ".join(f"SELECT '{a}' AS variable_1, '{b}' AS variable_2, corr({a}, {b}) AS r, count(*) AS n FROM {source}" for a, b in PAIRS)
    return f"SELECT variable_1, variable_2, round(r, 4) AS correlation, {STRENGTH} AS strength, n AS sample_size FROM ({rows}) WHERE abs(r) >= 0.3"


@query("correlation_pairs", sql_with("sales", _pairs_sql("sales")))
def correlation_pairs(spark, d):
    return st.correlation_analysis(v.sales(spark, d, *CORRELATED)).drop("p_value", "significant")


@query(
    "spearman",
    sql_with("sales", f"WITH ranked AS (SELECT {', '.join(AVERAGE_RANK.format(c=c) + f' AS {c}' for c in CORRELATED)} FROM sales) {_pairs_sql('ranked')}"),
)
def spearman(spark, d):
    return st.correlation_analysis(widen(v.sales(spark, d, *CORRELATED)), method="spearman").drop("p_value", "significant")


# Tails by numeric integration (midpoints): Student's t with t = sqrt(df) tan(angle), and the normal's centre.  Inputs are rows of (id, t, df) and (id, z).
STEPS = 20000
T_TAIL = f"""angles AS (SELECT id, df, least(atan(abs(t) / sqrt(df)), 40 / sqrt(df)) AS top FROM t_in),
       t_p AS (SELECT id, greatest(0, 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * sum(pow(cos(top * (s + 0.5) / {STEPS}), df - 1)) * any_value(top) / {STEPS}) AS p
               FROM angles, generate_series(0, {STEPS - 1}) AS g(s) GROUP BY id, df)"""
Z_TAIL = f"""z_p AS (SELECT id, greatest(0, 1 - 2 / sqrt(2 * pi()) * sum(exp(-0.5 * pow(least(abs(z), 40) * (s + 0.5) / {STEPS}, 2))) * any_value(least(abs(z), 40)) / {STEPS}) AS p
               FROM z_in, generate_series(0, {STEPS - 1}) AS g(s) GROUP BY id)"""


def _significance_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT '{a}' AS variable_1, '{b}' AS variable_2, corr({a}, {b}) AS r, count(*) AS n FROM sales" for a, b in PAIRS)
    return f"""WITH pairs AS ({rows}), t_in AS (SELECT variable_1 || variable_2 AS id, r * sqrt(n - 2) / sqrt(1 - r * r) AS t, (n - 2)::DOUBLE AS df FROM pairs), {T_TAIL}
        SELECT variable_1, variable_2, round(r, 4) AS correlation, round(p, 6) AS p_value, p < 0.05 AS significant, {STRENGTH} AS strength, n AS sample_size
        FROM pairs JOIN t_p ON id = variable_1 || variable_2"""


@query("correlation_significance", sql_with("sales", _significance_sql()))
def correlation_significance(spark, d):
    return st.correlation_analysis(v.sales(spark, d, *CORRELATED), min_correlation=0.0)


ABC_SQL = """items AS (SELECT product_id AS item, round(sum(total_amount), 4) AS total_value FROM sales GROUP BY 1),
       placed AS (SELECT item, total_value, total_value / sum(total_value) OVER () * 100 AS value_pct,
                  sum(total_value) OVER (ORDER BY total_value DESC, item ROWS UNBOUNDED PRECEDING) / sum(total_value) OVER () * 100 AS cumulative_pct FROM items),
       abc AS (SELECT *, CASE WHEN cumulative_pct <= 80 THEN 'A' WHEN cumulative_pct <= 95 THEN 'B' ELSE 'C' END AS abc_class FROM placed)"""


@query("abc", sql_with("sales", f"WITH {ABC_SQL} SELECT item, total_value, round(value_pct, 6) AS value_pct, round(cumulative_pct, 6) AS cumulative_pct, abc_class FROM abc"))
def abc(spark, d):
    out = st.abc_analysis(v.sales(spark, d, "product_id", "total_amount"), "total_amount", "product_id", digits=4)
    return out.withColumns({c: F.round(c, 6) for c in ("value_pct", "cumulative_pct")})


@query("abc_summary", sql_with("sales", f"WITH {ABC_SQL} SELECT abc_class, count(*) AS n_items, round(sum(value_pct), 4) AS value_pct FROM abc GROUP BY 1"))
def abc_summary(spark, d):
    out = st.abc_summary(st.abc_analysis(v.sales(spark, d, "product_id", "total_amount"), "total_amount", "product_id", digits=4))
    return out.withColumn("value_pct", F.round("value_pct", 4))


def _monthly(spark, d):
    return st.period_means(v.sales(spark, d, "warehouse_location", "order_date", "total_amount"), "warehouse_location", "order_date", "total_amount")


KENDALL = """pairs AS (SELECT a.entity_id, sum(sign(b.y - a.y)) AS s FROM s a JOIN s b ON a.entity_id = b.entity_id AND a.i < b.i GROUP BY 1),
       ties AS (SELECT entity_id, sum(c * (c - 1) * (2 * c + 5)) AS t, sum(c) AS n FROM (SELECT entity_id, y, count(*) AS c FROM s GROUP BY ALL) GROUP BY 1),
       mk AS (SELECT entity_id, n::BIGINT AS n, s::DOUBLE AS statistic, ((n * (n - 1) * (2 * n + 5) - t) / 18.0)::DOUBLE AS variance FROM pairs JOIN ties USING (entity_id))"""


@query(
    "mann_kendall",
    sql_with(
        "sales",
        f"""WITH {PERIOD_SERIES}, {KENDALL} SELECT entity_id, n, statistic, round(variance, 6) AS variance,
            round(CASE WHEN variance > 0 THEN (statistic - sign(statistic)) / sqrt(variance) ELSE 0 END, 6) AS z_score FROM mk""",
    ),
)
def mann_kendall(spark, d):
    out = st.mann_kendall(_monthly(spark, d)).drop("p_value", "trend")
    return out.withColumns({c: F.round(c, 6) for c in ("variance", "z_score")})


STRENGTH_CTE = """c AS (SELECT *, count(*) OVER w AS k, avg(y) OVER w AS cm, count(*) OVER (PARTITION BY entity_id) AS n FROM s WINDOW w AS (PARTITION BY entity_id ORDER BY ds ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)),
       dt AS (SELECT entity_id, n, i % 12 AS p, CASE WHEN k = 12 THEN y - cm END AS dv FROM c),
       sv AS (SELECT *, avg(dv) OVER (PARTITION BY entity_id, p) AS sp FROM dt),
       strength AS (SELECT entity_id, CASE WHEN any_value(n) >= 24 THEN greatest(0, 1 - var_pop(dv - sp) / nullif(var_pop(dv), 0)) ELSE 0 END AS seasonal_strength FROM sv GROUP BY 1)"""


@query("seasonal_strength", sql_with("sales", f"WITH {PERIOD_SERIES}, {STRENGTH_CTE} SELECT entity_id, round(seasonal_strength, 6) AS seasonal_strength FROM strength"))
def seasonal_strength(spark, d):
    return st.seasonal_strength(_monthly(spark, d)).withColumn("seasonal_strength", F.round("seasonal_strength", 6))


@query(
    "trend",
    sql_with(
        "sales",
        f"""WITH {PERIOD_SERIES}, {KENDALL}, {STRENGTH_CTE},
        t AS (SELECT *, avg(y) OVER (PARTITION BY entity_id ORDER BY ds ROWS 2 PRECEDING) AS ma3, avg(y) OVER (PARTITION BY entity_id ORDER BY ds ROWS 5 PRECEDING) AS ma6,
              y / lag(y) OVER (PARTITION BY entity_id ORDER BY ds) - 1 AS pct FROM s),
        g AS (SELECT entity_id, regr_slope(y, i) AS slope, regr_intercept(y, i) AS intercept, regr_r2(y, i) AS r2, stddev_samp(pct) AS vol, arg_min(y, ds) AS first, arg_max(y, ds) AS last,
              arg_max(ma3, ds) AS ma3, arg_max(ma6, ds) AS ma6, count(*) AS n FROM t GROUP BY 1)
        SELECT entity_id, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r2, 4) AS r_squared, CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS trend_direction,
               round((last - first) / first * 100, 2) AS growth_rate_pct, statistic AS mann_kendall_stat, round(vol, 4) AS volatility, round(seasonal_strength, 4) AS seasonal_strength,
               round(ma3, 2) AS last_moving_avg_3, round(ma6, 2) AS last_moving_avg_6, g.n AS data_points, round(first, 2) AS start_value, round(last, 2) AS end_value
        FROM g JOIN mk USING (entity_id) JOIN strength USING (entity_id)""",
    ),
)
def trend(spark, d):
    sales = v.sales(spark, d, "warehouse_location", "order_date", "total_amount")
    out = st.trend_analysis(sales, "warehouse_location", "order_date", "total_amount")
    return out.drop("p_value", "trend_significant", "mann_kendall_p_value", "mann_kendall_trend", "error")


@query(
    "trend_significance",
    sql_with(
        "sales",
        f"""WITH {PERIOD_SERIES}, {KENDALL}, fit AS (SELECT entity_id AS id, corr(y, i) AS r, (count(*) - 2)::DOUBLE AS df FROM s GROUP BY 1),
        t_in AS (SELECT id, r * sqrt(df) / sqrt(1 - r * r) AS t, df FROM fit), {T_TAIL},
        z_in AS (SELECT entity_id AS id, CASE WHEN variance > 0 THEN (statistic - sign(statistic)) / sqrt(variance) ELSE 0 END AS z FROM mk), {Z_TAIL}
        SELECT entity_id, round(t_p.p, 6) AS p_value, t_p.p < 0.05 AS trend_significant, round(z_p.p, 6) AS mann_kendall_p_value,
               CASE WHEN z_p.p >= 0.05 THEN 'no_trend' WHEN statistic > 0 THEN 'increasing' ELSE 'decreasing' END AS mann_kendall_trend
        FROM mk JOIN t_p ON t_p.id = entity_id JOIN z_p ON z_p.id = entity_id""",
    ),
)
def trend_significance(spark, d):
    sales = v.sales(spark, d, "warehouse_location", "order_date", "total_amount")
    return st.trend_analysis(sales, "warehouse_location", "order_date", "total_amount").select(
        "entity_id", "p_value", "trend_significant", "mann_kendall_p_value", "mann_kendall_trend"
    )


MOMENTS = "g AS (SELECT {g} AS g, count(*) AS n, avg(total_amount) AS m, var_samp(total_amount) AS vs, var_pop(total_amount) AS vp FROM sales GROUP BY 1)"
MEANS = "(SELECT array_to_string(list(g || '=' || printf('%.2f', round(m, 2)) ORDER BY g), ';') FROM g) AS group_means"


def _flat_means(out):
    pairs = F.transform(F.array_sort(F.map_entries("group_means")), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.2f", e["value"])))
    return out.withColumn("group_means", F.array_join(pairs, ";")).drop("p_value", "significant", "error")


@query(
    "ttest",
    sql_with(
        "sales",
        f"""WITH {MOMENTS.format(g="is_b2b::VARCHAR")},
        ab AS (SELECT a.m - b.m AS gap, a.n AS na, b.n AS nb, ((a.n - 1) * a.vs + (b.n - 1) * b.vs) / (a.n + b.n - 2) AS pooled, sqrt((a.vp + b.vp) / 2) AS ps
               FROM g a JOIN g b ON a.g = 'false' AND b.g = 'true')
        SELECT 'Independent t-test' AS test, round(gap / sqrt(pooled * (1.0 / na + 1.0 / nb)), 4) AS statistic, round(abs(gap) / (ps + 1e-10), 4) AS effect_size, 2::BIGINT AS groups_tested, {MEANS} FROM ab""",
    ),
)
def ttest(spark, d):
    return _flat_means(st.hypothesis_test(v.sales(spark, d, "is_b2b", "total_amount"), "is_b2b", "total_amount", "ttest"))


@query(
    "anova",
    sql_with(
        "sales",
        f"""WITH {MOMENTS.format(g="channel")},
        x AS (SELECT *, (SELECT sum(n * m) / sum(n) FROM g) AS gm FROM g),
        t AS (SELECT count(*) AS k, sum(n) AS nn, sum(n * (m - gm) * (m - gm)) AS ssb, sum(n * vp) AS ssw FROM x)
        SELECT 'One-way ANOVA' AS test, round((ssb / (k - 1)) / (ssw / (nn - k)), 4) AS statistic, round(ssb / (ssb + ssw + 1e-10), 4) AS effect_size, k AS groups_tested, {MEANS} FROM t""",
    ),
)
def anova(spark, d):
    return _flat_means(st.hypothesis_test(v.sales(spark, d, "channel", "total_amount"), "channel", "total_amount", "anova"))


# Far more groups than a row should hold: the test and the means of each part.
@query(
    "anova_parts",
    sql_with(
        "sales",
        f"""WITH {MOMENTS.format(g="product_id::VARCHAR")},
        x AS (SELECT *, (SELECT sum(n * m) / sum(n) FROM g) AS gm FROM g),
        t AS (SELECT count(*) AS k, sum(n) AS nn, sum(n * (m - gm) * (m - gm)) AS ssb, sum(n * vp) AS ssw FROM x)
        SELECT 'One-way ANOVA' AS test, round((ssb / (k - 1)) / (ssw / (nn - k)), 4) AS statistic, round(ssb / (ssb + ssw + 1e-10), 4) AS effect_size, k AS groups_tested FROM t""",
    ),
)
def anova_parts(spark, d):
    test, _ = st.group_test(v.sales(spark, d, "product_id", "total_amount"), "product_id", "total_amount")
    return test.select("test", "statistic", "effect_size", "groups_tested")


@query("anova_part_means", sql_with("sales", "SELECT product_id::VARCHAR AS g, count(*) AS n, round(avg(total_amount), 2) AS mean FROM sales GROUP BY 1"))
def anova_part_means(spark, d):
    return st.group_test(v.sales(spark, d, "product_id", "total_amount"), "product_id", "total_amount")[1]


def _group_tests_sql() -> str:
    # Five channels: with four degrees of freedom above, the F tail is x^a (1 + a (1 - x)) for a = df2 / 2.
    two, many = (MOMENTS.format(g=g).removeprefix("g AS ") for g in ("is_b2b::VARCHAR", "channel"))
    return f"""WITH g2 AS {two}, g5 AS {many},
        ab AS (SELECT a.m - b.m AS gap, a.n AS na, b.n AS nb, ((a.n - 1) * a.vs + (b.n - 1) * b.vs) / (a.n + b.n - 2) AS pooled, sqrt((a.vp + b.vp) / 2) AS ps
               FROM g2 a JOIN g2 b ON a.g = 'false' AND b.g = 'true'),
        t_in AS (SELECT 't' AS id, gap / sqrt(pooled * (1.0 / na + 1.0 / nb)) AS t, (na + nb - 2)::DOUBLE AS df, abs(gap) / (ps + 1e-10) AS effect FROM ab), {T_TAIL},
        x AS (SELECT *, (SELECT sum(n * m) / sum(n) FROM g5) AS gm FROM g5),
        f AS (SELECT count(*) AS k, sum(n) AS nn, sum(n * (m - gm) * (m - gm)) AS ssb, sum(n * vp) AS ssw FROM x),
        ft AS (SELECT *, (ssb / (k - 1)) / (ssw / (nn - k)) AS stat, (nn - k)::DOUBLE AS d2 FROM f),
        fp AS (SELECT *, pow(d2 / (d2 + 4 * stat), d2 / 2) * (1 + d2 / 2 * (4 * stat / (d2 + 4 * stat))) AS p FROM ft)
        SELECT 'Independent t-test' AS test, round(t, 4) AS statistic, round(p, 6) AS p_value, p < 0.05 AS significant, round(effect, 4) AS effect_size, 2::BIGINT AS groups_tested, NULL::VARCHAR AS error
        FROM t_in JOIN t_p USING (id)
        UNION ALL SELECT 'One-way ANOVA', round(stat, 4), round(p, 6), p < 0.05, round(ssb / (ssb + ssw + 1e-10), 4), k, NULL FROM fp"""


@query("group_test_pvalues", sql_with("sales", _group_tests_sql()))
def group_test_pvalues(spark, d):
    two = st.hypothesis_test(v.sales(spark, d, "is_b2b", "total_amount"), "is_b2b", "total_amount", "ttest")
    many = st.hypothesis_test(v.sales(spark, d, "channel", "total_amount"), "channel", "total_amount", "anova")
    return two.unionByName(many).drop("group_means")


K2 = """k AS (SELECT *, n::DOUBLE AS f FROM (SELECT warehouse_location, count(*) AS n,
              sqrt(avg(total_amount)) * 0 + (avg(pow(total_amount - mu, 3)) / pow(avg(pow(total_amount - mu, 2)), 1.5)) AS g1, kurtosis_pop(total_amount) AS g2
              FROM (SELECT *, avg(total_amount) OVER (PARTITION BY warehouse_location) AS mu FROM sales) GROUP BY 1)),
       a AS (SELECT *, g1 * sqrt((f + 1) * (f + 3) / (6.0 * (f - 2))) AS y, 3.0 * (f * f + 27 * f - 70) * (f + 1) * (f + 3) / ((f - 2) * (f + 5) * (f + 7) * (f + 9)) AS b2,
              (g2 + 3 - 3.0 * (f - 1) / (f + 1)) / sqrt(24.0 * f * (f - 2) * (f - 3) / ((f + 1) * (f + 1) * (f + 3) * (f + 5))) AS x,
              6.0 * (f * f - 5 * f + 2) / ((f + 7) * (f + 9)) * sqrt(6.0 * (f + 3) * (f + 5) / (f * (f - 2) * (f - 3))) AS rb FROM k),
       b AS (SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w2, 6.0 + 8.0 / rb * (2.0 / rb + sqrt(1 + 4.0 / (rb * rb))) AS aa FROM a),
       z AS (SELECT *, asinh(y / sqrt(2.0 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, (1 - 2 / (9 * aa) - cbrt((1 - 2 / aa) / (1 + x * sqrt(2 / (aa - 4))))) / sqrt(2 / (9 * aa)) AS z2 FROM b)"""


@query(
    "normality",
    sql_with(
        "sales",
        f"""WITH {K2} SELECT warehouse_location, round(z1 * z1 + z2 * z2, 2) AS dagostino_statistic, round(exp(-(z1 * z1 + z2 * z2) / 2), 6) AS dagostino_p_value,
            exp(-(z1 * z1 + z2 * z2) / 2) > 0.05 AS is_normal, round(g1, 4) AS skewness, round(g2, 4) AS kurtosis,
            CASE WHEN abs(g1) < 0.5 THEN 'approximately_symmetric' WHEN g1 > 0 AND g1 < 1 THEN 'right_skewed' WHEN g1 > 0 THEN 'highly_right_skewed'
                 WHEN g1 > -1 THEN 'left_skewed' ELSE 'highly_left_skewed' END AS skewness_interpretation, n AS sample_size FROM z""",
    ),
)
def normality(spark, d):
    out = st.normality_test(v.sales(spark, d, "warehouse_location", "total_amount"), "total_amount", ["warehouse_location"])
    return out.drop("error").withColumn("dagostino_statistic", F.round("dagostino_statistic", 2))


def _poly_sql(coefficients, x: str) -> str:
    """A polynomial, highest power first, by Horner's rule."""
    out = "0.0::DOUBLE"
    for c in coefficients:
        out = f"({out} * ({x}) + ({float(c)!r})::DOUBLE)"
    return out


# Acklam's rational approximation of the normal quantile (centre, then tails), right to nine digits.
CENTRE_OVER = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
CENTRE_UNDER = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
TAIL_OVER = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
TAIL_UNDER = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
TAIL_FROM = 0.02425


def shapiro_sql(source: str, key: str, value: str) -> str:
    """CTEs up to ``sw`` ({key}, n, w, p): Shapiro-Wilk for groups of 8 to 5,000 values; p by numeric integration of the normal."""
    gamma = _poly_sql(st.ROYSTON_GAMMA, "n")
    tail = f"{_poly_sql(TAIL_OVER, 't')} / {_poly_sql(TAIL_UNDER, 't')}"
    return f"""placed AS (SELECT {key} AS id, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {value}) AS i, count(*) OVER (PARTITION BY {key}) AS n
              FROM {source} WHERE {value} IS NOT NULL),
       shares AS (SELECT *, (i - 0.375) / (n + 0.25) AS share FROM placed WHERE n BETWEEN 8 AND 5000),
       parts AS (SELECT *, share - 0.5 AS q, pow(share - 0.5, 2) AS r, sqrt(-2 * ln(least(share, 1 - share))) AS t FROM shares),
       scores AS (SELECT id, v, i, n, CASE WHEN share < {TAIL_FROM} THEN {tail} WHEN share > 1 - {TAIL_FROM} THEN -({tail})
              ELSE q * {_poly_sql(CENTRE_OVER, "r")} / {_poly_sql(CENTRE_UNDER, "r")} END AS m FROM parts),
       ends AS (SELECT id, any_value(n) AS n, sum(m * m) AS norm, max(m) FILTER (i = n) AS m1, max(m) FILTER (i = n - 1) AS m2, avg(v) AS mu, var_pop(v) * count(*) AS squares FROM scores GROUP BY 1),
       outer_w AS (SELECT *, m1 / sqrt(norm) + {_poly_sql(st.ROYSTON_LAST, "1 / sqrt(n)")} AS a1, m2 / sqrt(norm) + {_poly_sql(st.ROYSTON_NEXT, "1 / sqrt(n)")} AS a2 FROM ends),
       weights AS (SELECT *, sqrt((norm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) AS phi FROM outer_w),
       sw_w AS (SELECT s.id, any_value(s.n) AS n, pow(sum((v - mu) * CASE WHEN i = 1 THEN -a1 WHEN i = 2 THEN -a2 WHEN i = s.n THEN a1 WHEN i = s.n - 1 THEN a2 ELSE m / phi END), 2) / any_value(squares) AS w
              FROM scores s JOIN weights USING (id) GROUP BY s.id),
       z_in AS (SELECT id, CASE WHEN n > 11 THEN (ln(1 - w) - {_poly_sql(st.ROYSTON_MEAN_LARGE, "ln(n)")}) / exp({_poly_sql(st.ROYSTON_SD_LARGE, "ln(n)")})
              WHEN ln(1 - w) >= {gamma} THEN 40 ELSE (-ln({gamma} - ln(1 - w)) - {_poly_sql(st.ROYSTON_MEAN_SMALL, "n")}) / exp({_poly_sql(st.ROYSTON_SD_SMALL, "n")}) END AS z FROM sw_w), {Z_TAIL},
       sw AS (SELECT id AS {key}, n, w, CASE WHEN z > 0 THEN p / 2 ELSE 1 - p / 2 END AS p FROM sw_w JOIN z_in USING (id) JOIN z_p USING (id))"""


@query(
    "shapiro",
    sql_with("daily", f"WITH {shapiro_sql('daily', 'entity_id', 'y')} SELECT entity_id, round(w, 4) AS shapiro_statistic, round(p, 6) AS shapiro_p_value, n, 'shapiro' AS method FROM sw"),
)
def shapiro(spark, d):
    return st.shapiro_test(materialize(v.daily(spark, d)), "y", ["entity_id"])


def _describe_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, count({c}) AS count, count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct, round(avg({c}), 4) AS mean,
        round(median({c}), 4) AS median, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.75), 4) AS q3,
        round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr, round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis, round(var_samp({c}), 4) AS variance,
        round(round(stddev_samp({c}), 4) / nullif(round(avg({c}), 4), 0) * 100, 2) AS cv_pct FROM inventory"""


@query("describe", sql_with("inventory", " UNION ALL ".join(_describe_sql(c) for c in ("quantity_on_hand", "quantity_allocated", "quantity_in_transit"))))
def describe(spark, d):
    return st.describe(materialize(v.inventory(spark, d)), ["quantity_on_hand", "quantity_allocated", "quantity_in_transit"])
