"""From wide metric rows to one long row per observation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from pyrewatch.config import DetectorSettings
from pyrewatch.schemas import METRICS

SERIES = ["incident_id", "service", "metric_name"]


def long_series(metrics: DataFrame, names: Iterable[str] = METRICS) -> DataFrame:
    """Unpivot the metric columns; observations that do not apply (null) are dropped."""
    return (
        metrics.unpivot(["incident_id", "timestamp", "service"], list(names), "metric_name", "value")
        .where(F.col("value").isNotNull())
    )


def series_counts(metrics: DataFrame, settings: DetectorSettings | None = None) -> DataFrame:
    """Per incident: how many series and observations the detector reads."""
    settings = settings or DetectorSettings()
    per_series = long_series(metrics, settings.active_rules).groupBy(*SERIES).count()
    return per_series.groupBy("incident_id").agg(
        F.count("*").alias("series_analyzed"), F.sum("count").alias("observations_analyzed")
    )
