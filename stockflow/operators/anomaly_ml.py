"""Isolation forest, robust covariance and PCA reconstruction error, with a 2-of-3 vote.

Fitted state is small and bounded (a forest of 200 trees of at most 256 rows, a p x p covariance, p
eigenvectors); everything that touches all rows is an aggregate or a projection.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockflow.functions.pvalues import chi2_quantile
from stockflow.functions.scalars import numeric_columns
from stockflow.operators.quantiles import exact_quantiles
from stockflow.session import materialize

TREES = 200
SAMPLE = 256
CONTAMINATION = 0.05
SEED = 42
COMPONENTS = 5
EULER = 0.5772156649015329
#: Concentration steps at most, the last bin of squared distances, and the upper quartile of a standard normal variable.
STEPS, LAST_BIN, NORMAL_QUARTILE = 7, 4000, 0.6744897501960817


# ---------------------------------------------------------------- preparation


@dataclass
class Scaling:
    columns: list[str]
    medians: dict[str, float]
    spreads: dict[str, float]
    rows: int  # size of the frame it was fitted on

    def vector(self) -> list[Column]:
        """Missing values at the median, then (x - median) / IQR."""
        return [
            (F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) - F.lit(self.medians[c])) / F.lit(self.spreads[c]) for c in self.columns
        ]


def fit_scaling(df: DataFrame, columns: Sequence[str] | None = None) -> Scaling:
    columns = numeric_columns(df) if columns is None else list(columns)
    rows = df.count()
    medians = {c: (q[0] if q else 0.0) for c, q in exact_quantiles(df, columns, [0.5], rows=rows).first().asDict().items()}
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(medians[c])).alias(c) for c in columns])
    quartiles = exact_quantiles(filled, columns, [0.25, 0.75], rows=rows).first()
    return Scaling(columns, medians, {c: (quartiles[c][1] - quartiles[c][0]) or 1.0 for c in columns}, rows)


def scale(df: DataFrame, scaling: Scaling) -> DataFrame:
    """Add ``{c}_scaled``."""
    return df.withColumns({f"{c}_scaled": v for c, v in zip(scaling.columns, scaling.vector())})


# ---------------------------------------------------------------- isolation forest


def _path_norm(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3)
    general = 2 * (np.log(safe - 1) + EULER) - 2 * (safe - 1) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, general))


def hashed(text: str) -> float:
    """A number between 0 and 1 from the first 52 bits of MD5 of ``text``; ``hashed_column`` is the same in Spark."""
    return (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)


def hashed_column(*parts: Column) -> Column:
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def _grow(tree: int, x: np.ndarray, many: np.ndarray, max_depth: int) -> pd.DataFrame:
    """One tree as a complete binary heap: (feature, cut) per inner node, path length per bottom node.

    ``many`` says how often the tree drew each of the different rows ``x``.  Nodes are cut at a random value of a random feature, both by
    a hash of tree and node, until a single point or the depth limit is left; the nodes below a leaf repeat its path length,
    so scoring needs no test for leaves.
    """
    inner = 2**max_depth - 1
    feature, cut, path = np.zeros(inner, dtype=np.int32), np.full(inner, np.inf), np.zeros(2 * inner + 1)
    pending = [(0, np.arange(len(x)), 0)]
    while pending:
        node, rows, depth = pending.pop()
        low, high, size = x[rows].min(axis=0), x[rows].max(axis=0), int(many[rows].sum())
        varying = np.flatnonzero(high > low)
        if depth >= max_depth or size <= 1 or len(varying) == 0:
            first, width = node, 1
            for _ in range(max_depth - depth):
                first, width = 2 * first + 1, 2 * width
            path[first : first + width] = depth + float(_path_norm(size))
            continue
        f = feature[node] = varying[int(hashed(f"{SEED}:{tree}:{node}:feature") * len(varying))]
        cut[node] = low[f] + hashed(f"{SEED}:{tree}:{node}:cut") * (high[f] - low[f])
        left = x[rows, f] <= cut[node]
        pending += [(2 * node + 1, rows[left], depth + 1), (2 * node + 2, rows[~left], depth + 1)]
    return pd.DataFrame({"tree": [tree], "feature": [feature.tolist()], "cut": [cut.tolist()], "path": [path[inner:].tolist()]})


@dataclass
class Forest:
    scaling: Scaling
    arrays: tuple[np.ndarray, np.ndarray, np.ndarray]  # feature, cut and path, one row per tree
    depth: int
    psi: int
    offset: float = 0.0
    fitted: DataFrame | None = None  # the rows it was fitted on, and the same rows with their scores
    scored: DataFrame | None = None


def _codes(scaling: Scaling) -> list[Column]:
    """Each value, missing ones at the median, as a whole number of steps of 2 ** -40 of its spread or finer.

    The step is a power of two, so a code does not depend on the last digit of the spread; codes end at 2 ** 62.
    """
    out = []
    for c in scaling.columns:
        step = 2.0 ** (math.ceil(math.log2(scaling.spreads[c])) - 40)
        steps = F.floor(F.greatest(F.least(F.coalesce(F.col(c).cast("double"), F.lit(scaling.medians[c])) / F.lit(step), F.lit(2.0**62)), F.lit(-(2.0**62))))
        out.append(steps.cast("string"))
    return out


def _binomial(u: Column, copies: Column, none: Column, rate: float) -> Column:
    """How many of ``copies`` are drawn, each with chance ``rate``, where ``none`` is the chance of none: the inverse distribution at ``u``."""
    mean = copies * rate
    most = F.least(copies, F.ceil(mean + 12 * F.sqrt(mean) + 30)).cast("int")
    start = F.struct(none.alias("p"), none.alias("upto"), F.lit(0).alias("k"))

    def step(at: Column, j: Column) -> Column:
        p = at["p"] * (copies - j + 1) / j * (rate / (1 - rate))
        return F.struct(p.alias("p"), (at["upto"] + p).alias("upto"), F.when(u >= at["upto"], j.cast("int")).otherwise(at["k"]).alias("k"))

    single = (u >= none).cast("int")
    return F.when(copies == 1, single).otherwise(F.aggregate(F.sequence(F.lit(1), most), start, step, lambda at: at["k"]))


def draw(df: DataFrame, scaling: Scaling, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """(tree, x, many): the rows that each tree takes, equal ones counted; about ``min(sample, n)`` rows a tree.

    Equal rows are counted first.  Each of their copies has the same chance in every tree, so a tree takes a binomial share of the count,
    by a hash of row and tree: a row that half of the table repeats is one row of a tree, with a count.  The first tree that
    takes a row is drawn at once, its distance from the start being geometric, so rows that no tree takes cost one hash.
    """
    n = scaling.rows
    rate = min(sample, n) / max(n, 1)
    counted = df.select(F.array(*scaling.vector()).alias("x"), F.concat_ws(",", *_codes(scaling)).alias("code"))
    counted = counted.groupBy("x", "code").agg(F.count(F.lit(1)).alias("copies"))
    if rate >= 1:
        every = counted.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        return every.select("tree", "x", F.col("copies").cast("int").alias("many"))
    seed = F.lit(str(SEED))
    log = math.log1p(-rate)
    first = F.floor(F.log(hashed_column(seed, F.col("code"))) / (F.col("copies") * log))
    taken = counted.withColumn("first", F.least(first, F.lit(trees)).cast("int")).filter(F.col("first") < trees)
    taken = taken.withColumn("none", F.exp(F.col("copies") * log)).withColumn("tree", F.explode(F.sequence(F.col("first"), F.lit(trees - 1))))
    u = hashed_column(seed, F.col("tree").cast("string"), F.col("code"))
    u = F.when(F.col("tree") == F.col("first"), F.col("none") + (1 - F.col("none")) * u).otherwise(u)
    taken = taken.withColumn("u", u).withColumn("many", _binomial(F.col("u"), F.col("copies"), F.col("none"), rate))
    return taken.filter("many > 0").select("tree", "x", "many")


def fit_forest(df: DataFrame, scaling: Scaling, trees: int = TREES, sample: int = SAMPLE, contamination: float = CONTAMINATION) -> Forest:
    """Grow ``trees`` trees in parallel, each on a sample of about ``min(sample, n)`` rows (``draw``).

    A tree's rows meet in one group of known size, however often a row repeats; at most ``trees`` small trees reach the driver.
    """
    n = scaling.rows
    psi = min(sample, n)
    max_depth = int(np.ceil(np.log2(max(psi, 2))))

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        return _grow(int(rows["tree"].iloc[0]), np.array(rows["x"].tolist(), dtype=float), rows["many"].to_numpy(), max_depth)

    schema = "tree int, feature array<int>, cut array<double>, path array<double>"
    grown = draw(df, scaling, trees, sample).groupBy("tree").applyInPandas(grow, schema).toPandas().sort_values("tree")
    arrays = tuple(np.array(grown[c].tolist(), dtype=t) for c, t in (("feature", np.intp), ("cut", float), ("path", float)))
    forest = Forest(scaling, arrays, max_depth, psi)
    forest.fitted, forest.scored = df, _scored(df, forest)  # scoring is the costly pass: once
    forest.offset = exact_quantiles(forest.scored, ["isolation"], [1 - contamination], rows=n).first()["isolation"][0]
    return forest


def _scored(df: DataFrame, forest: Forest) -> DataFrame:
    return materialize(df.withColumn("isolation", isolation_score(df.sparkSession, forest, F.array(*forest.scaling.vector()))), "scored")


def isolation_score(spark, forest: Forest, vector: Column) -> Column:
    """2^(-E[path] / c(psi)): near 1 for points that are easy to isolate."""
    shared = spark.sparkContext.broadcast((forest.arrays, forest.depth, float(_path_norm(forest.psi))))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        (feature, cut, path), depth, norm = shared.value
        inner = feature.shape[1]
        for batch in batches:
            x = np.vstack(batch.to_numpy()) if len(batch) else np.empty((0, 1))
            # Row-major cells are addressed by one index: taking from flat arrays is the fast form.
            cells, row, total = x.ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x))
            for f, c, p in zip(feature, cut, path):
                node = np.zeros(len(x), dtype=np.intp)
                for _ in range(depth):
                    right = cells.take(row + f.take(node)) > c.take(node)
                    node = 2 * node + 1 + right
                total += p.take(node - inner)
            # The order of a sum does not show in seven decimals, so equal paths have equal scores.
            yield pd.Series(np.round(np.power(2.0, -total / len(feature) / (norm or 1.0)), 7))

    return score(vector)


# ---------------------------------------------------------------- robust covariance


@dataclass
class Ellipse:
    scaling: Scaling
    location: np.ndarray
    precision: np.ndarray
    offset: float = float("inf")

    def distance(self) -> Column:
        """Squared Mahalanobis distance as a plain column expression."""
        return _squared(self.scaling.vector(), self.location, self.precision)


def _moments(df: DataFrame, vector: list[Column]) -> tuple[int, np.ndarray, np.ndarray]:
    """Size, mean and population covariance in one aggregate of p + p(p+1)/2 numbers."""
    p = len(vector)
    named = df.select(*[v.alias(f"v{i}") for i, v in enumerate(vector)])
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = named.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f"v{i}").alias(f"m{i}") for i in range(p)],
        *[F.covar_pop(f"v{i}", f"v{j}").alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    cov = np.zeros((p, p))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    return row["n"], np.array([row[f"m{i}"] or 0.0 for i in range(p)]), cov


def _squared(x: list[Column], centre: np.ndarray, precision: np.ndarray) -> Column:
    """Squared Mahalanobis distance as a plain column expression."""
    away = [v - F.lit(float(m)) for v, m in zip(x, centre)]
    total = F.lit(0.0)
    for i, a in enumerate(away):
        for j in range(i, len(away)):
            total = total + a * away[j] * F.lit(float(precision[i, j]) * (1 if i == j else 2))
    return total


def bin_of(d2: Column) -> Column:
    """The bin of a squared distance on a fixed grid: a step is one hundredth of ln(1 + d2), the last bin is open."""
    return F.floor(F.least(100 * F.log1p(F.greatest(d2, F.lit(0.0))), F.lit(float(LAST_BIN)))).cast("int")


def edge_of(bins: np.ndarray) -> np.ndarray:
    """Where a bin ends."""
    return np.expm1((np.asarray(bins) + 1) / 100)


def _binned(df: DataFrame, vector: list[Column], models: dict[int, tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """Size and sums of values and products for each start and bin of its distance, of all ``models`` in one scan.

    At most ``LAST_BIN`` + 1 rows for each start reach the driver.
    """
    p = len(vector)
    names = [f"v{i}" for i in range(p)]
    x = df.select(*[v.alias(c) for v, c in zip(vector, names)])
    bins = [F.struct(F.lit(k).alias("start"), bin_of(_squared([F.col(c) for c in names], *m)).alias("bin")) for k, m in models.items()]
    spread = x.withColumn("at", F.explode(F.array(*bins))).select("at.start", "at.bin", *names)
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(names)]
    products = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]
    return spread.groupBy("start", "bin").agg(F.count(F.lit(1)).alias("n"), *sums, *products).toPandas().sort_values(["start", "bin"])


def _of_bins(bins: pd.DataFrame, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population covariance of the rows in ``bins``."""
    total = bins.drop(columns=["start", "bin"]).sum()
    n, mean, cov = max(total["n"], 1), np.array([total[f"s{i}"] for i in range(p)], float), np.zeros((p, p))
    mean = mean / n
    for i in range(p):
        for j in range(i, p):
            cov[i, j] = cov[j, i] = total[f"s{i}_{j}"] / n - mean[i] * mean[j]
    return mean, cov


def _half(bins: pd.DataFrame, rows: int) -> pd.DataFrame:
    """The first bins that hold at least half of ``rows``."""
    return bins[(bins["n"].cumsum() - bins["n"]) * 2 < rows]


def fit_ellipse(df: DataFrame, scaling: Scaling, contamination: float = CONTAMINATION, steps: int = STEPS) -> Ellipse:
    """Minimum covariance determinant by concentration steps from three fixed starts.

    Starts are the median with the spread of normal columns, and the moments of all rows and of the rows within one spread of the median.
    A step keeps the half of the rows nearest to the centre, in whole bins of a fixed grid of distances: all starts take it in one scan
    that sums sizes, values and products for each bin.  A start that no longer moves rests; the least determinant wins.  A final
    reweighting drops the bins beyond the 97.5 % chi-squared distance; the flagging threshold is exact.  At most ``steps`` + 2
    scans and one exact quantile.
    """
    p, vector, n = len(scaling.columns), scaling.vector(), scaling.rows
    near = reduce(Column.__and__, [F.abs(v) <= 1 for v in vector])
    first = _all_and_near(df, vector, near)
    spread = np.eye(p) / (1 / (2 * NORMAL_QUARTILE)) ** 2
    models = {0: (np.zeros(p), spread)} | {k + 1: (m, np.linalg.pinv(c)) for k, (m, c) in enumerate(first)}
    moving, kept = dict(models), {}
    for _ in range(steps):
        bins = _binned(df, vector, moving)
        for k in [*moving]:
            half = _half(bins[bins["start"] == k], n)
            mean, cov = _of_bins(half, p)
            counts = half["n"].tolist()
            still = k in kept and kept[k][0] == counts and np.allclose(kept[k][2], cov, rtol=1e-12, atol=0)
            kept[k] = (counts, mean, cov)
            moving[k] = (mean, np.linalg.pinv(cov))
            if still:
                del moving[k]
        if not moving:
            break
    # Determinants that agree to nine digits are the same ellipse; of these the first start is taken.
    best = min(kept, key=lambda k: (float(f"{np.linalg.det(kept[k][2]):.9g}"), k))
    _, centre, cov = kept[best]
    bins = _binned(df, vector, {0: (centre, np.linalg.pinv(cov))})
    factor = edge_of(_half(bins, n)["bin"].max()) / chi2_quantile(0.5, p)
    centre, cov = _of_bins(bins[edge_of(bins["bin"]) <= factor * chi2_quantile(0.975, p)], p)
    model = Ellipse(scaling, centre, np.linalg.pinv(cov))
    distances = df.select(model.distance().alias("d2"))
    model.offset = exact_quantiles(distances, ["d2"], [1 - contamination], rows=n).first()["d2"][0]
    return model


def _all_and_near(df: DataFrame, vector: list[Column], near: Column) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and covariance of all rows and of the ``near`` ones, in one scan."""
    p = len(vector)
    named = df.select(*[v.alias(f"v{i}") for i, v in enumerate(vector)], near.alias("near"))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    kinds = {"all": lambda c: c, "near": lambda c: F.when(F.col("near"), c)}
    row = named.agg(
        *[F.avg(of(F.col(f"v{i}"))).alias(f"{k}_m{i}") for k, of in kinds.items() for i in range(p)],
        *[F.avg(of(F.col(f"v{i}") * F.col(f"v{j}"))).alias(f"{k}_c{i}_{j}") for k, of in kinds.items() for i, j in pairs],
    ).first()
    out = []
    for k in kinds:
        mean, cov = np.array([row[f"{k}_m{i}"] or 0.0 for i in range(p)]), np.zeros((p, p))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = (row[f"{k}_c{i}_{j}"] or 0.0) - mean[i] * mean[j]
        out.append((mean, cov))
    return out


# ---------------------------------------------------------------- PCA


@dataclass
class Components:
    scaling: Scaling
    mean: np.ndarray
    axes: np.ndarray  # k x p

    def error(self) -> Column:
        """Mean squared residual after projecting on the kept axes, as a plain column expression."""
        x = [v - F.lit(float(m)) for v, m in zip(self.scaling.vector(), self.mean)]
        p = len(x)
        residual = np.eye(p) - self.axes.T @ self.axes
        total = F.lit(0.0)
        for i in range(p):
            part = F.lit(0.0)
            for j in range(p):
                part = part + x[j] * F.lit(float(residual[i, j]))
            total = total + part * part
        return total / p


def fit_components(df: DataFrame, scaling: Scaling) -> Components:
    _, mean, cov = _moments(df, scaling.vector())
    _, vectors = np.linalg.eigh(cov)
    keep = min(len(scaling.columns) - 1, COMPONENTS)
    return Components(scaling, mean, vectors[:, ::-1][:, :keep].T)


def pca_detect(df: DataFrame, model: Components, quantile: float = 0.95) -> DataFrame:
    """Add ``pca_error`` and ``pca_flag``: above the 95th percentile of the scored rows."""
    scored = df.withColumn("pca_error", model.error())
    cut = exact_quantiles(scored, ["pca_error"], [quantile]).first()["pca_error"][0]
    return scored.withColumn("pca_flag", F.col("pca_error") > F.lit(cut))


# ---------------------------------------------------------------- vote


@dataclass
class MlModel:
    forest: Forest | None
    ellipse: Ellipse | None
    components: Components | None


def fit_ml(df: DataFrame, columns: Sequence[str] | None = None, contamination: float = CONTAMINATION) -> MlModel:
    columns = numeric_columns(df) if columns is None else list(columns)
    if len(columns) < 2:
        return MlModel(None, None, None)
    scaling = fit_scaling(df, columns)  # df is read some twenty times below: pass a materialised frame
    return MlModel(fit_forest(df, scaling, contamination=contamination), fit_ellipse(df, scaling, contamination), fit_components(df, scaling))


def forest_detect(df: DataFrame, forest: Forest) -> DataFrame:
    """Add ``isolation`` (2^-path score), ``forest_flag`` and ``ml_score`` (min-max of the score over the rows).

    The scored rows are written once, as their extremes are needed before the first result row; rows that the forest was fitted
    on have been scored already.
    """
    scored = forest.scored if df is forest.fitted else _scored(df, forest)
    ends = scored.agg(F.min("isolation").alias("lo"), F.max("isolation").alias("hi")).first()
    lo, hi = ends["lo"] or 0.0, ends["hi"] or 0.0
    return scored.withColumns(
        {
            "forest_flag": F.col("isolation") > F.lit(forest.offset),
            "ml_score": 1 - (F.lit(hi) - F.col("isolation")) / F.lit(hi - lo + 1e-10),
        }
    )


def ellipse_detect(df: DataFrame, ellipse: Ellipse) -> DataFrame:
    """Add ``mahalanobis2`` and ``ellipse_flag``."""
    return df.withColumn("mahalanobis2", ellipse.distance()).withColumn("ellipse_flag", F.col("mahalanobis2") > F.lit(ellipse.offset))


def ml_detect(df: DataFrame, model: MlModel) -> DataFrame:
    """All three detectors, ``ml_votes`` and ``ml_flag`` (at least two agree); below two features nothing is flagged."""
    if model.forest is None:
        return df.withColumns({"ml_score": F.lit(0.0), "ml_votes": F.lit(0), "ml_flag": F.lit(False)})
    out = pca_detect(ellipse_detect(forest_detect(df, model.forest), model.ellipse), model.components)
    votes = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ("forest_flag", "ellipse_flag", "pca_flag")), F.lit(0))
    return out.withColumn("ml_votes", votes).withColumn("ml_flag", F.col("ml_votes") >= 2)
