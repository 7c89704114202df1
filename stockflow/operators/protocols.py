"""What a user-supplied detector or forecaster has to offer to work with the ensembles."""

from __future__ import annotations

from typing import Any, Protocol

from pyspark.sql import DataFrame


class Detector(Protocol):
    """``fit`` reads history once; ``score`` adds ``is_anomaly`` and ``anomaly_score`` (0 to 1) to rows, without changing them."""

    def fit(self, df: DataFrame) -> Any: ...

    def score(self, df: DataFrame, model: Any) -> DataFrame: ...


class Forecaster(Protocol):
    """``forecast`` turns a series (entity_id, ds, y) into rows (entity_id, step, ds, predicted)."""

    def forecast(self, series: DataFrame, horizon: int) -> DataFrame: ...
