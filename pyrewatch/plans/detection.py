"""Queries on series, anomaly points and anomaly windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pyrewatch.config import DetectorSettings
from pyrewatch.operators.detector import flag_with_feedback
from pyrewatch.operators.scoring import flag_without_feedback, score_all, with_baselines
from pyrewatch.operators.series import series_counts
from pyrewatch.operators.windows import anomaly_windows, with_window_number
from pyrewatch.plans import tables as t
from pyrewatch.plans.duck import block, frames, scored, sql
from pyrewatch.plans.registry import query

_POINT = """incident_id, timestamp, service, metric_name, value, round(baseline_mean, 6) AS baseline_mean,
round(baseline_std, 6) AS baseline_std, baseline_points, round(z_score, 6) AS z_score,
round(deviation, 6) AS deviation, direction, severity, detection_method, absolute_threshold_exceeded"""


def rounded(points):
    return points.withColumns({
        c: F.round(c, 6) for c in ("baseline_mean", "baseline_std", "z_score", "deviation")
    })


@query("series_observations", "D3", sql("""
SELECT incident_id, count(*) AS series_analyzed, cast(sum(n) AS bigint) AS observations_analyzed
FROM (SELECT incident_id, service, metric_name, count(*) AS n FROM series GROUP BY ALL) GROUP BY incident_id""", "series"))
def _(spark, sf):
    return series_counts(t.metrics(spark, sf))


@query("causal_baselines", "E1 E2", sql("""
SELECT incident_id, timestamp, service, metric_name, round(rm, 6) AS recent_mean, round(rs, 6) AS recent_std,
       rn AS recent_points, round(lm, 6) AS lagged_mean, round(ls, 6) AS lagged_std, ln AS lagged_points FROM frames""",
                                        "frames"))
def _(spark, sf):
    out = with_baselines(t.series(spark, sf), DetectorSettings())
    means = ("recent_mean", "recent_std", "lagged_mean", "lagged_std")
    return out.withColumns({c: F.round(c, 6) for c in means}).drop("value")


@query("observation_scores", "E3 E4", sql(f"SELECT {_POINT} FROM plain_scores", "plain_scores"))
def _(spark, sf):
    return rounded(score_all(t.series(spark, sf), DetectorSettings()))


@query("sequential_detector", "E5 F2", sql(f"SELECT {_POINT} FROM points", "points"))
def _(spark, sf):
    return rounded(flag_with_feedback(t.series(spark, sf)))


block("frames_no_lag", "series_rows", frames(lag=0))
block("scores_no_lag", "frames_no_lag", scored("frames_no_lag"))


@query("plain_rolling_detector", "E6", sql(f"SELECT {_POINT} FROM scores_no_lag WHERE detection_method IS NOT NULL",
                                           "scores_no_lag"))
def _(spark, sf):
    return rounded(flag_without_feedback(t.series(spark, sf), DetectorSettings(lag=0, exclude_flagged=False)))


@query("gap_sessions", "E7", sql("""
SELECT incident_id, timestamp, service, metric_name, cast(window_no AS bigint) AS window_no FROM numbered""", "numbered"))
def _(spark, sf):
    return with_window_number(t.points(spark, sf)).select(
        "incident_id", "timestamp", "service", "metric_name", "window_no")


@query("anomaly_windows", "D4", sql("""
SELECT incident_id, window_no, start_time, end_time, duration_minutes, severity, anomaly_count,
       array_to_string(affected_services, '|') AS affected_services,
       array_to_string(affected_metrics, '|') AS affected_metrics,
       array_to_string(affected_series, '|') AS affected_series,
       array_to_string(detection_methods, '|') AS detection_methods, round(abs(peak_z_score), 6) AS peak_deviation,
       round(peak_z_score, 6) AS peak_z_score, peak_metric, peak_service, peak_timestamp FROM windows""", "windows"))
def _(spark, sf):
    out = anomaly_windows(t.points(spark, sf))
    lists = ("affected_services", "affected_metrics", "affected_series", "detection_methods")
    return out.withColumns({c: F.array_join(c, "|") for c in lists}).withColumns(
        {c: F.round(c, 6) for c in ("peak_deviation", "peak_z_score")})
