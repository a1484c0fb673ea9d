"""Gap sessions of anomaly points, and one summary row per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pyrewatch.functions.times import day_of, minutes, minutes_between
from pyrewatch.operators.ordered import with_session_number
from pyrewatch.operators.scoring import severity_name, severity_rank


def with_window_number(points: DataFrame, max_gap_minutes: float = 2.0) -> DataFrame:
    """Number the sessions of each incident: a gap of more than ``max_gap_minutes`` opens the next one.

    Borders depend only on the distinct instants of an incident, so the scan runs on those and the numbers
    are joined back on (incident, instant).
    """
    instants = points.select("incident_id", "timestamp").distinct()
    numbered = with_session_number(
        instants, ["incident_id"], day_of(F.col("timestamp")), "timestamp", "timestamp", minutes(max_gap_minutes),
        "window_no",
    )
    return points.join(numbered, ["incident_id", "timestamp"])


def _sorted_set(column: Column) -> Column:
    return F.array_sort(F.collect_set(column))


def anomaly_windows(points: DataFrame, max_gap_minutes: float = 2.0) -> DataFrame:
    """One row per window. The peak has the largest |z|, then the highest severity, then comes first."""
    size = F.coalesce(F.abs("z_score"), F.lit(-1.0))
    rank = severity_rank(F.col("severity"))
    peak = F.min_by(
        F.struct("z_score", "metric_name", "service", "timestamp"),
        F.struct((-size).alias("a"), (-rank).alias("b"), "timestamp", "service", "metric_name"),
    )
    grouped = with_window_number(points, max_gap_minutes).groupBy("incident_id", "window_no").agg(
        F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"),
        severity_name(F.max(rank)).alias("severity"), F.count("*").alias("anomaly_count"),
        _sorted_set(F.col("service")).alias("affected_services"),
        _sorted_set(F.col("metric_name")).alias("affected_metrics"),
        _sorted_set(F.concat_ws(":", "service", "metric_name")).alias("affected_series"),
        _sorted_set(F.col("detection_method")).alias("detection_methods"),
        peak.alias("_peak"),
    )
    return grouped.select(
        "incident_id", "window_no", "start_time", "end_time",
        minutes_between(F.col("start_time"), F.col("end_time")).alias("duration_minutes"),
        "severity", "anomaly_count", "affected_services", "affected_metrics", "affected_series",
        "detection_methods", F.abs("_peak.z_score").alias("peak_deviation"),
        F.col("_peak.z_score").alias("peak_z_score"), F.col("_peak.metric_name").alias("peak_metric"),
        F.col("_peak.service").alias("peak_service"), F.col("_peak.timestamp").alias("peak_timestamp"),
    )
