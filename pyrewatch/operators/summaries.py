"""Counts and sanity figures over anomaly points and windows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pyrewatch.config import DetectorSettings
from pyrewatch.operators.detector import detect
from pyrewatch.operators.scoring import severity_name, severity_rank
from pyrewatch.operators.series import SERIES, long_series
from pyrewatch.operators.windows import anomaly_windows
from pyrewatch.schemas import METRICS, METRIC_LABELS, NORMAL
from pyrewatch.session import cut_lineage


def point_totals(points: DataFrame) -> DataFrame:
    """Points by metric, severity, method and incident, from one small pre-aggregate."""
    scopes = {"metric": "metric_name", "severity": "severity", "method": "detection_method", "incident": "incident_id"}
    small = points.groupBy(*scopes.values()).agg(F.count("*").alias("_n"))
    entries = F.explode(F.array(*[
        F.struct(F.lit(scope).alias("scope"), F.col(column).alias("name")) for scope, column in scopes.items()]))
    return small.select("_n", entries.alias("e")).groupBy("e.scope", "e.name").agg(F.sum("_n").alias("points"))


def metric_summary(points: DataFrame, windows: DataFrame) -> DataFrame:
    """Per incident and metric: points, windows that list the metric, and the peak severity."""
    by_point = points.groupBy("incident_id", "metric_name").agg(
        F.count("*").alias("point_count"), severity_name(F.max(severity_rank(F.col("severity")))).alias("peak_severity"))
    by_window = windows.select("incident_id", F.explode("affected_metrics").alias("metric_name")).groupBy(
        "incident_id", "metric_name").agg(F.count("*").alias("window_count"))
    order = F.create_map(*[x for i, m in enumerate(METRICS) for x in (F.lit(m), F.lit(i))])
    label = F.create_map(*[x for m, text in METRIC_LABELS.items() for x in (F.lit(m), F.lit(text))])
    name = F.col("metric_name")
    return by_point.join(by_window, ["incident_id", "metric_name"], "full").select(
        "incident_id", "metric_name", F.coalesce(label[name], name).alias("label"),
        F.coalesce(order[name], F.lit(len(METRICS))).alias("place"),
        F.coalesce("point_count", F.lit(0)).alias("point_count"),
        F.coalesce("window_count", F.lit(0)).alias("window_count"), "peak_severity")


def upper_middle(column: str) -> Column:
    """The element at n // 2 of the sorted values. Read from the top, that is the discrete 50% point."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)")


def counts_per_incident(points: DataFrame, windows: DataFrame, incidents: DataFrame) -> DataFrame:
    def rows(df, name):
        return df.groupBy("incident_id").agg(F.count("*").alias(name))
    out = incidents.select("incident_id").join(rows(points, "points"), "incident_id", "left").join(
        rows(windows, "windows"), "incident_id", "left")
    return out.na.fill(0, ["points", "windows"])


def group_extremes(points: DataFrame, windows: DataFrame, incidents: DataFrame, labels: DataFrame) -> DataFrame:
    """Smallest, middle and largest number of points and windows for normal and failure cases."""
    kind = F.when(F.col("scenario") == NORMAL, "NORMAL").otherwise("FAILURE").alias("kind")
    rows = counts_per_incident(points, windows, incidents).join(labels.select("incident_id", kind), "incident_id")
    figures = []
    for c in ("points", "windows"):
        figures += [F.min(c).alias(f"min_{c}"), upper_middle(c).cast("long").alias(f"middle_{c}"), F.max(c).alias(f"max_{c}")]
    return rows.groupBy("kind").agg(F.count("*").alias("cases"), *figures)


def quiet_failures(windows: DataFrame, incidents: DataFrame, labels: DataFrame) -> DataFrame:
    """Failure cases without a window that overlaps the alert."""
    failures = incidents.join(labels.where(F.col("scenario") != NORMAL).select("incident_id", "scenario"), "incident_id")
    seen = _overlapping(windows, incidents, F.col("alert_start"), F.col("alert_end"))
    return failures.select("incident_id", "scenario").join(seen, "incident_id", "left_anti")


def _overlapping(windows: DataFrame, cases: DataFrame, start: Column, end: Column) -> DataFrame:
    bounds = cases.withColumnsRenamed({"start_time": "alert_start", "end_time": "alert_end"}).select(
        "incident_id", "alert_start", "alert_end", *[c for c in ("fault_start_time",) if c in cases.columns])
    joined = windows.join(bounds, "incident_id")
    return joined.where((F.col("start_time") <= end) & (F.col("end_time") >= start)).select("incident_id").distinct()


def with_phases(rows: DataFrame, incidents: DataFrame, labels: DataFrame) -> DataFrame:
    """Where a row lies: before the fault, in the fault period, in the alert, after its end."""
    bounds = incidents.select("incident_id", F.col("start_time").alias("_start"), F.col("end_time").alias("_end")).join(
        labels.select("incident_id", "scenario", F.col("fault_start_time").alias("_fault")), "incident_id")
    at = F.col("timestamp")
    return rows.join(bounds, "incident_id").withColumns({
        "before_fault": F.coalesce(at < F.col("_fault"), F.lit(False)),
        "in_fault_period": F.coalesce(at.between(F.col("_fault"), F.col("_end")), F.lit(False)),
        "in_alert": at.between(F.col("_start"), F.col("_end")), "after_end": at > F.col("_end"),
    }).drop("_start", "_end", "_fault")


def rate(points: Column, observations: Column) -> Column:
    """Points per 1,000 observations, three digits."""
    return F.coalesce(F.round(F.try_divide(points * 1000, observations), 3), F.lit(0.0))


def phase_counts(points: DataFrame, incidents: DataFrame, labels: DataFrame) -> DataFrame:
    """Points per scenario and metric in every phase."""
    rows = with_phases(points, incidents, labels)
    return rows.groupBy("scenario", "metric_name").agg(*[
        F.count_if(c).alias(c) for c in ("before_fault", "in_fault_period", "in_alert", "after_end")])


def after_end_counts(points: DataFrame, incidents: DataFrame, labels: DataFrame) -> DataFrame:
    heading = F.concat_ws(":", "metric_name", F.coalesce("direction", F.lit("none")))
    return with_phases(points, incidents, labels).where("after_end").groupBy(heading.alias("name")).agg(
        F.count("*").alias("points"))


def top_series(points: DataFrame, metrics: DataFrame, n: int = 5) -> DataFrame:
    """The series with most points and the share of their observations; equal counts go by key."""
    counted = points.groupBy(*SERIES).agg(F.count("*").alias("points"))
    most = counted.orderBy(F.desc("points"), *SERIES).limit(n)
    lengths = long_series(metrics).groupBy(*SERIES).agg(F.count("*").alias("_length"))
    # At most n rows on the right.
    return lengths.join(F.broadcast(most), SERIES).select(
        *SERIES, "points", F.round(F.col("points") / F.col("_length"), 3).alias("share_of_series"))


def alert_minutes(points: DataFrame, metrics: DataFrame, incidents: DataFrame) -> DataFrame:
    """Per incident: distinct metric instants inside the alert, and those with a point."""
    instants = metrics.select("incident_id", "timestamp").distinct()
    flagged = points.select("incident_id", "timestamp", F.lit(True).alias("_hit")).distinct()
    bounds = incidents.select("incident_id", "start_time", "end_time")
    inside = instants.join(bounds, "incident_id").where(F.col("timestamp").between(F.col("start_time"), F.col("end_time")))
    return inside.join(flagged, ["incident_id", "timestamp"], "left").groupBy("incident_id").agg(
        F.count("*").alias("alert_minutes"), F.count("_hit").alias("flagged_minutes"))


def detector_sanity(points: DataFrame, windows: DataFrame, metrics: DataFrame, incidents: DataFrame,
                    labels: DataFrame) -> DataFrame:
    """One row of figures: totals, normal cases, the time before faults, and coverage of the alerts."""
    observed = with_phases(long_series(metrics), incidents, labels)
    normal = F.col("scenario") == NORMAL
    seen = observed.agg(
        F.count("*").alias("observations"), F.count_if(normal).alias("normal_observations"),
        F.count_if(F.col("before_fault")).alias("early_observations"))
    found = with_phases(points, incidents, labels).agg(
        F.count("*").alias("points"), F.countDistinct("incident_id").alias("incidents_with_anomaly"),
        F.count_if(normal).alias("normal_points"), F.count_if(normal & (F.col("severity") == "HIGH")).alias("normal_high"),
        F.count_if(normal & F.col("in_alert")).alias("normal_in_alert"),
        F.count_if(F.col("before_fault")).alias("early_points"))
    failures = incidents.join(labels.where(F.col("scenario") != NORMAL).select("incident_id", "fault_start_time"), "incident_id")
    covered = _overlapping(windows, failures, F.col("fault_start_time"), F.col("alert_end"))
    shares = alert_minutes(points, metrics, failures).agg(
        F.coalesce(F.sum("alert_minutes"), F.lit(0)).alias("alert_minutes"),
        F.coalesce(F.sum("flagged_minutes"), F.lit(0)).alias("flagged_minutes"))
    figures = (seen, found, shares, windows.agg(F.count("*").alias("windows")), incidents.agg(F.count("*").alias("incidents")),
               failures.agg(F.count("*").alias("failures")), covered.agg(F.count("*").alias("failures_covered")))
    names = [c for figure in figures for c in figure.columns]
    out = reduce(DataFrame.unionByName, [_as_pairs(figure) for figure in figures]).agg(*[
        F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in names])
    return out.withColumns({
        "normal_rate": rate(F.col("normal_points"), F.col("normal_observations")),
        "early_rate": rate(F.col("early_points"), F.col("early_observations")),
        "share_of_alert_minutes": F.round(F.try_divide("flagged_minutes", "alert_minutes"), 3),
    })


def _as_pairs(figure: DataFrame) -> DataFrame:
    """One aggregate row as (name, value) rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("value")) for c in figure.columns]))
    return figure.select(pairs.alias("p")).select("p.name", "p.value")


# The three settings compared by the ablation.
ABLATION = {
    "default": DetectorSettings(),
    "no drift check": DetectorSettings(lag=0),
    "plain rolling": DetectorSettings(lag=0, exclude_flagged=False),
}


def ablation(metrics: DataFrame, incidents: DataFrame, labels: DataFrame,
             settings: dict[str, DetectorSettings] | None = None,
             summarize: Callable[..., DataFrame] = detector_sanity) -> DataFrame:
    """The same figures under several detector settings."""
    out = None
    for name, chosen in (settings or ABLATION).items():
        points = cut_lineage(detect(long_series(metrics), chosen))
        windows = cut_lineage(anomaly_windows(points, chosen.max_gap_minutes))
        row = summarize(points, windows, metrics, incidents, labels).withColumn("config", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
