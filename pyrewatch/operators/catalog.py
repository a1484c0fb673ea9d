"""Incident catalog: list, filter, facets and one wide record per incident."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pyrewatch.operators.dataset import log_profile, metric_profile
from pyrewatch.schemas import SEVERITIES

_SUMMARY = ("incident_id", "title", "service", "severity", "start_time", "end_time", "duration_minutes", "description")


def listing(incidents: DataFrame) -> DataFrame:
    return incidents.select(*_SUMMARY)


def matching(incidents: DataFrame, text: str = "", service: str = "", severity: str = "") -> DataFrame:
    """Exact service and severity, and a case-insensitive substring of id, title, service and description."""
    out = incidents
    if service:
        out = out.where(F.col("service") == service)
    if severity:
        out = out.where(F.col("severity") == severity)
    needle = text.strip().lower()
    if needle:
        out = out.where(F.lower(F.concat_ws(" ", "incident_id", "title", "service", "description")).contains(needle))
    return out


def facets(incidents: DataFrame) -> DataFrame:
    """Distinct services and severities in display order; severities by rank, unknown ones after them."""
    pairs = F.explode(F.array(
        F.struct(F.lit("service").alias("facet"), F.col("service").alias("value")),
        F.struct(F.lit("severity").alias("facet"), F.col("severity").alias("value"))))
    rank = F.lit(0)
    order = F.when(F.col("facet") == "severity", len(SEVERITIES)).otherwise(rank)
    for i, name in enumerate(SEVERITIES):
        order = F.when((F.col("facet") == "severity") & (F.col("value") == name), i).otherwise(order)
    distinct = incidents.select(pairs.alias("p")).select("p.*").distinct()
    return distinct.withColumn("place", order)


def records(incidents: DataFrame, logs: DataFrame, metrics: DataFrame, windows: DataFrame, evidence: DataFrame,
            points: DataFrame) -> DataFrame:
    """Summary, log and metric profile, anomaly and timeline counts; flags where a derived table has no row."""
    anomalies = windows.groupBy("incident_id").agg(
        F.count("*").alias("window_count"), F.sum("anomaly_count").alias("point_count"))
    scored = points.groupBy("incident_id").agg(F.array_sort(F.collect_set("metric_name")).alias("anomalous_metrics"))
    timeline = evidence.groupBy("incident_id").agg(
        F.count("*").alias("timeline_events"), F.array_sort(F.collect_set("service")).alias("observed_services"))
    out = incidents.select(*_SUMMARY, "window_start", "window_end")
    for side in (log_profile(logs), metric_profile(metrics), anomalies, scored, timeline):
        out = out.join(side, "incident_id", "left")
    return out.withColumns({
        "anomalies_available": F.col("window_count").isNotNull(),
        "timeline_available": F.col("timeline_events").isNotNull(),
    }).na.fill(0, ["line_count", "row_count", "window_count", "point_count", "timeline_events"])
