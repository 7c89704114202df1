"""SQL for the machine-learned detectors, as lists of CTEs over a table ``x`` of row ids and scaled columns.

``x`` has ``id``, the scaled columns ``x1``, ``x2``, ... and ``code``, the text that draws are hashed from.  The constants are those of
``operators.anomaly_ml``.
"""

from __future__ import annotations

import math

from stockflow.operators.anomaly_ml import CONTAMINATION, EULER, LAST_BIN, NORMAL_QUARTILE, SEED, STEPS


def _u(text: str) -> str:
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5) / 4503599627370496)"


def scaled(source: str, columns: list[str], keys: str) -> str:
    """CTEs ``x`` and ``rows_of_x``: values as steps from the median in interquartile ranges (no value is missing)."""
    fits = ", ".join(f"median({c}) AS m_{c}, coalesce(nullif(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 0), 1) AS s_{c}" for c in columns)
    x = ", ".join(f"({c} - m_{c}) / s_{c} AS x{i}" for i, c in enumerate(columns, 1))
    code = " || ',' || ".join(
        f"floor(greatest(least({c}::DOUBLE / pow(2, ceil(log2(s_{c})) - 40), pow(2, 62)), -pow(2, 62)))::BIGINT" for c in columns
    )
    return f"""fits AS (SELECT {fits} FROM {source}),
        x AS MATERIALIZED (SELECT row_number() OVER () AS id, {keys}, {x}, {code} AS code FROM {source}, fits),
        rows_of_x AS (SELECT count(*) AS n FROM x)"""


def forest(p: int, trees: int, sample: int, depth: int) -> str:
    """CTE ``isolation`` (id, score) of a forest of ``trees`` trees of ``depth`` levels on some ``sample`` rows (fewer than the table has)."""
    xs = [f"x{i}" for i in range(1, p + 1)]
    names, seed = ", ".join(xs), SEED
    pick = lambda f: "CASE f " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(xs, 1)) + " END" if f else ""
    varying = "list_filter([" + ", ".join(f"CASE WHEN hi{i} > lo{i} THEN {i} END" for i in range(1, p + 1)) + "], lambda v: v IS NOT NULL)"
    low, high = ("[" + ", ".join(f"{side}{i}" for i in range(1, p + 1)) + "][f]" for side in ("lo", "hi"))
    path = lambda level: f"{level} + CASE WHEN size <= 1 THEN 0 WHEN size = 2 THEN 1 ELSE 2 * (ln(size - 1) + {EULER}) - 2 * (size - 1) / size END"
    parts = [
        # Draws: the first tree of a row by a geometric distance, then a binomial share of its copies in each tree from there on.
        f"kinds AS MATERIALIZED (SELECT {names}, code, count(*) AS copies, {sample} / any_value(n)::DOUBLE AS rate FROM x, rows_of_x GROUP BY {names}, code)",
        f"taken AS (SELECT *, floor(ln({_u(f"'{seed}:' || code")}) / (copies * ln(1 - rate))) AS first, pow(1 - rate, copies) AS none FROM kinds)",
        f"""spread AS MATERIALIZED (SELECT *, CASE WHEN tree = first THEN none + (1 - none) * h ELSE h END AS u
            FROM (SELECT taken.*, t.tree, {_u(f"'{seed}:' || t.tree || ':' || code")} AS h FROM taken JOIN (SELECT unnest(range({trees})) AS tree) t ON t.tree >= first))""",
        """shares AS (SELECT tree, code, count(*) FILTER (WHERE upto <= any_u) AS many FROM (
            SELECT tree, code, u AS any_u, sum(exp(lgamma(copies + 1) - lgamma(j + 1) - lgamma(copies - j + 1) + j * ln(rate) + (copies - j) * ln(1 - rate)))
                   OVER (PARTITION BY tree, code ORDER BY j) AS upto
            FROM (SELECT *, unnest(range(least(copies, ceil(copies * rate + 12 * sqrt(copies * rate) + 30))::BIGINT)) AS j FROM spread)) GROUP BY tree, code)""",
        f"s0 AS MATERIALIZED (SELECT tree, 0 AS node, {names}, many FROM spread JOIN shares USING (tree, code) WHERE many > 0)",
        "r0 AS MATERIALIZED (SELECT k.id, t.tree, 0 AS node FROM (SELECT min(id) AS id FROM x GROUP BY code) k, (SELECT unnest(range(%d)) AS tree) t)" % trees,
    ]
    for level in range(depth + 1):
        ends = ", ".join(f"min(x{i}) AS lo{i}, max(x{i}) AS hi{i}" for i in range(1, p + 1))
        parts.append(f"n{level} AS MATERIALIZED (SELECT tree, node, sum(many) AS size, {ends} FROM s{level} GROUP BY tree, node)")
        if level < depth:
            feature = f"{varying}[1 + floor({_u(f"'{seed}:' || tree || ':' || node || ':feature'")} * len({varying}))::INT]"
            cut = f"{low} + {_u(f"'{seed}:' || tree || ':' || node || ':cut'")} * ({high} - {low})"
            parts += [
                f"c{level} AS MATERIALIZED (SELECT tree, node, f, {cut} AS cut FROM (SELECT *, {feature} AS f FROM n{level} WHERE size > 1 AND len({varying}) > 0))",
                f"s{level + 1} AS MATERIALIZED (SELECT tree, 2 * node + 1 + ({pick(1)} > cut)::INT AS node, {names}, many FROM s{level} JOIN c{level} USING (tree, node))",
                f"r{level + 1} AS MATERIALIZED (SELECT id, tree, 2 * node + 1 + ({pick(1)} > cut)::INT AS node FROM r{level} JOIN c{level} USING (tree, node) JOIN x USING (id))",
            ]
    ends = [
        f"SELECT id, {path(level)} AS path FROM r{level} JOIN n{level} USING (tree, node)" + (f" ANTI JOIN c{level} USING (tree, node)" if level < depth else "")
        for level in range(depth + 1)
    ]
    norm = 1.0 if sample == 2 else 2 * (math.log(sample - 1) + EULER) - 2 * (sample - 1) / sample
    paths = " UNION ALL ".join(ends)
    parts += [
        f"paths AS (SELECT id, avg(path) AS path FROM ({paths}) GROUP BY id)",
        f"of_code AS (SELECT code, round(pow(2, -path / {norm!r}), 7) AS score FROM paths JOIN x USING (id))",
        "isolation AS MATERIALIZED (SELECT x.id, score FROM x JOIN of_code USING (code))",
        f"forest AS (SELECT id, score, score > (SELECT quantile_cont(score, {1 - CONTAMINATION}) FROM isolation) AS forest_flag, "
        "1 - ((SELECT max(score) FROM isolation) - score) / (SELECT max(score) - min(score) + 1e-10 FROM isolation) AS ml_score FROM isolation)",
    ]
    return ",\n".join(parts)


def ellipse() -> str:
    """CTE ``ellipse`` (id, d2, ellipse_flag) for two columns."""
    d2 = "paa * (x1 - ma) * (x1 - ma) + 2 * pab * (x1 - ma) * (x2 - mb) + pbb * (x2 - mb) * (x2 - mb)"
    sums = "sum(n) AS n, sum(sa) AS sa, sum(sb) AS sb, sum(saa) AS saa, sum(sab) AS sab, sum(sbb) AS sbb"

    def bins(k: str, model: str) -> str:
        grid = f"floor(least(100 * ln(1 + greatest({d2}, 0)), {LAST_BIN}))::INT"
        return f"""{k} AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY start ORDER BY bin) - n AS before FROM (
            SELECT start, {grid} AS bin, count(*) AS n, sum(x1) AS sa, sum(x2) AS sb, sum(x1 * x1) AS saa, sum(x1 * x2) AS sab, sum(x2 * x2) AS sbb
            FROM x, {model} GROUP BY 1, 2))"""

    def model(source: str) -> str:
        """Mean, covariance and its inverse from sums."""
        means = f"SELECT start, sa / n AS ma, sb / n AS mb, saa / n - sa / n * sa / n AS va, sab / n - sa / n * sb / n AS c, sbb / n - sb / n * sb / n AS vb FROM {source}"
        return f"SELECT start, ma, mb, vb / det AS paa, -c / det AS pab, va / det AS pbb, det FROM (SELECT *, va * vb - c * c AS det FROM ({means}))"

    first = "count(*) AS n, sum(x1) AS sa, sum(x2) AS sb, sum(x1 * x1) AS saa, sum(x1 * x2) AS sab, sum(x2 * x2) AS sbb"
    normal = (2 * NORMAL_QUARTILE) ** 2
    parts = [
        f"""m0 AS MATERIALIZED (SELECT 0 AS start, 0.0 AS ma, 0.0 AS mb, {normal!r} AS paa, 0.0 AS pab, {normal!r} AS pbb, 0.0 AS det
            UNION ALL {model(f"(SELECT 1 AS start, {first} FROM x)")}
            UNION ALL {model(f"(SELECT 2 AS start, {first} FROM x WHERE abs(x1) <= 1 AND abs(x2) <= 1)")})"""
    ]
    for k in range(STEPS):
        half = f"(SELECT start, {sums} FROM b{k}, (SELECT n AS rows FROM rows_of_x) WHERE 2 * before < rows GROUP BY start)"
        parts += [bins(f"b{k}", f"m{k}"), f"m{k + 1} AS MATERIALIZED ({model(half)})"]
    parts += [
        f"best AS MATERIALIZED (SELECT * FROM m{STEPS} ORDER BY printf('%.8e', det)::DOUBLE, start LIMIT 1)",
        bins("last", "best"),
        "middle AS (SELECT (exp((max(bin) + 1) / 100.0) - 1) / (2 * ln(2)) AS factor FROM last, rows_of_x WHERE 2 * before < rows_of_x.n)",
        f"""chosen AS MATERIALIZED ({model(f"(SELECT start, {sums} FROM last, middle WHERE exp((bin + 1) / 100.0) - 1 <= factor * 2 * ln(40) GROUP BY start)")})""",
        f"distances AS MATERIALIZED (SELECT id, {d2} AS d2 FROM x, chosen)",
        f"ellipse AS (SELECT id, d2, d2 > (SELECT quantile_cont(d2, {1 - CONTAMINATION}) FROM distances) AS ellipse_flag FROM distances)",
    ]
    return ",\n".join(parts)


def residual() -> str:
    """CTE ``residual`` (id, pca_error, pca_flag) for two columns: the squared distance from the main axis."""
    return """moments AS (SELECT avg(x1) AS ma, avg(x2) AS mb, var_pop(x1) AS va, var_pop(x2) AS vb, covar_pop(x1, x2) AS c FROM x),
        axis AS (SELECT *, c / sqrt(c * c + (top - va) * (top - va)) AS u, (top - va) / sqrt(c * c + (top - va) * (top - va)) AS w
            FROM (SELECT *, (va + vb) / 2 + sqrt((va - vb) * (va - vb) / 4 + c * c) AS top FROM moments)),
        errors AS (SELECT id, pow((x1 - ma) * w - (x2 - mb) * u, 2) / 2 AS pca_error FROM x, axis),
        residual AS (SELECT *, pca_error > (SELECT quantile_cont(pca_error, 0.95) FROM errors) AS pca_flag FROM errors)"""
