"""Weighted ensemble of the detectors and the anomaly records made from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.functions.scalars import recommendation, severity
from stockflow.operators import anomaly_statistical as stat
from stockflow.operators.protocols import Detector
from stockflow.plans.schemas import FACTOR

# Detector weights, and the weight of a detector that is not listed.
WEIGHTS = {"statistical": 0.35, "ml": 0.40, "timeseries": 0.25}
OTHER_WEIGHT = 0.3
MIN_CONFIDENCE = 0.5
TOP_FACTORS = 5


def ensemble_score(df: DataFrame, scores: dict[str, str], rescale: bool = False) -> DataFrame:
    """Add ``ensemble_score`` from the named detector score columns; a missing score counts as 0.

    ``rescale`` divides by the weights present, for ensembles other than the three standard detectors.
    """
    total, present = F.lit(0.0), 0.0
    for name, column in scores.items():
        weight = WEIGHTS.get(name, OTHER_WEIGHT)
        total = total + F.coalesce(F.col(column), F.lit(0.0)) * weight
        present += weight
    return df.withColumn("ensemble_score", total / present if rescale else total)


def user_ensemble(df: DataFrame, detectors: dict[str, Detector], rescale: bool = True) -> DataFrame:
    """Fit and score each detector on ``df`` and add ``{name}_score`` and ``ensemble_score``.

    A detector's ``score`` adds ``is_anomaly`` and ``anomaly_score``; names of the standard detectors carry their weights.
    """
    out, scores = df, {}
    for name, detector in detectors.items():
        out = detector.score(out, detector.fit(df)).drop("is_anomaly").withColumnRenamed("anomaly_score", f"{name}_score")
        scores[name] = f"{name}_score"
    return ensemble_score(out, scores, rescale)


def contributing_factors(columns: Sequence[str], stats: dict[str, dict[str, Column]], top: int = TOP_FACTORS) -> Column:
    """The ``top`` of the columns that deviate by more than 1.5 sigma, the strongest first; no shuffle."""
    candidates = []
    for i, c in enumerate(columns):
        value, mean, std = F.col(c).cast("double"), stats[c]["mean"], stats[c]["std"]
        sigma = F.when(std > 0, (value - mean) / std)
        factor = F.struct(
            F.lit(c).alias("factor"),
            value.alias("value"),
            mean.alias("expected"),
            sigma.alias("deviation_sigma"),
            F.when(F.abs(sigma) > 3, "high").otherwise("moderate").alias("impact"),
        )
        ranked = F.struct((-F.abs(sigma)).alias("k"), F.lit(i).alias("i"), factor.alias("f"))
        candidates.append(F.when(F.abs(sigma) > 1.5, ranked))
    ordered = F.array_sort(F.filter(F.array(*candidates), lambda s: s.isNotNull()))
    return F.transform(F.slice(ordered, 1, top), lambda s: s["f"]).cast(f"array<{FACTOR.lower()}>")


def anomaly_records(
    scored: DataFrame,
    model: stat.StatModel,
    entity: str,
    timestamp: str,
    score: str = "ensemble_score",
    algorithm: str = "ensemble_statistical_ml_timeseries",
    min_confidence: float = MIN_CONFIDENCE,
    threshold: float = 3.0,
) -> DataFrame:
    """One record per row whose score exceeds ``min_confidence``.

    The metric is the column that deviates most (the first among ties); its median is the expected value.
    """
    rows, stats = model.attach(scored.filter(F.col(score) > min_confidence))
    columns = list(stats)
    options = F.array(
        *[
            F.struct(
                (-stat.column_score(F.col(c), s, threshold)).alias("k"),
                F.lit(i).alias("i"),
                F.lit(c).alias("metric"),
                F.col(c).cast("double").alias("actual"),
                s["median"].alias("expected"),
            )
            for i, (c, s) in enumerate(stats.items())
        ]
    )
    rows = rows.withColumns({"_top": F.get(F.array_sort(options), F.lit(0)), "contributing_factors": contributing_factors(columns, stats)})
    confidence = F.col(score)
    level = severity(confidence, F.col("contributing_factors"))
    return rows.withColumn("severity", level).select(
        F.col("_top.metric").alias("metric_name"),
        F.col(entity).cast("string").alias("entity_id"),
        F.col(timestamp).cast("timestamp").alias("timestamp"),
        F.col("_top.actual").alias("actual_value"),
        F.col("_top.expected").alias("expected_value"),
        (confidence * 100).alias("deviation_percentage"),
        (confidence * threshold).alias("z_score"),
        "severity",
        F.lit(algorithm).alias("algorithm_used"),
        confidence.alias("confidence_score"),
        "contributing_factors",
        recommendation(F.col("_top.metric"), F.col("severity")).alias("recommendation"),
        F.lit(False).alias("is_acknowledged"),
        F.lit(False).alias("is_resolved"),
    )
