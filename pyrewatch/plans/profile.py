"""Queries on profiles, features, templates and dataset checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pyrewatch.config import DetectorSettings
from pyrewatch.functions.text import DESCRIPTION_WORDS, HEX_RUN, KEYWORDS, NUMBER_RUN, TIMEOUT_WORDS
from pyrewatch.operators import dataset as d, features as f, quality as q, summaries as s, templates as tp
from pyrewatch.operators.detector import detect
from pyrewatch.operators.windows import anomaly_windows
from pyrewatch.plans import ingest, tables as t
from pyrewatch.plans.duck import block, fold, in_list, literal, matches, sql, SEVERITY_RANK
from pyrewatch.plans.ingest import _flat, _suite
from pyrewatch.plans.registry import REGISTRY, query
from pyrewatch.schemas import FAILURES, METRIC_LABELS, METRICS

# The test tables have one row per ten minutes, so levels before an incident are taken over four hours.
BEFORE = 240


def minutes_sql(a: str, b: str) -> str:
    return f"date_diff('microsecond', {a}, {b}) / 6e7"


block("cases", "incidents labels_of", f"""
SELECT i.*, l.* EXCLUDE (incident_id), coalesce(fault_start_time, start_time) AS ref,
  CASE WHEN scenario IN {in_list(FAILURES[:2])} THEN root_cause_service ELSE service END AS focus
FROM incidents i JOIN labels_of l ON l.incident_id = i.incident_id""")
block("case_metrics", "metrics cases", f"""
SELECT m.*, c.scenario, c.service AS reported, c.focus, c.ref, c.start_time, c.end_time,
  m.timestamp BETWEEN c.ref - INTERVAL '{BEFORE}' MINUTE AND c.ref - INTERVAL '1' MINUTE AS in_base,
  m.timestamp BETWEEN c.start_time AND c.end_time AS in_alert, m.timestamp BETWEEN c.ref AND c.end_time AS in_fault
FROM metrics m JOIN cases c ON c.incident_id = m.incident_id""")
_long_case = " UNION ALL ".join(
    f"SELECT incident_id, service, timestamp, scenario, focus, in_base, in_alert, '{m}' AS metric_name, {m} AS value "
    f"FROM case_metrics WHERE {m} IS NOT NULL" for m in METRICS)
block("long_case", "case_metrics", _long_case)
_FIGURES = ("count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, "
            "max(value) AS max")


def cases(spark, sf):
    return f.case_table(t.incidents(spark, sf), t.labels(spark, sf))


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("log_profiles", "D1", sql("""
SELECT incident_id, count(*) AS line_count, count(*) FILTER (level = 'INFO') AS info_lines,
  count(*) FILTER (level = 'WARN') AS warn_lines, count(*) FILTER (level = 'ERROR') AS error_lines,
  string_agg(DISTINCT service, '|' ORDER BY service) AS log_services,
  (SELECT string_agg(event_type || '=' || n, '|' ORDER BY n DESC, event_type) FROM (
     SELECT event_type, count(*) AS n FROM logs x WHERE x.incident_id = l.incident_id GROUP BY event_type)) AS event_types
FROM logs l GROUP BY incident_id""", "logs"))
def _(spark, sf):
    out = d.log_profile(t.logs(spark, sf))
    types = F.transform("event_types", lambda e: F.concat_ws("=", e["name"], e["count"].cast("string")))
    return out.withColumns({"log_services": F.array_join("log_services", "|"), "event_types": F.array_join(types, "|")})


_ORDER = " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(METRICS))


@query("metric_profiles", "D2", sql(f"""
SELECT m.incident_id, count(*) AS row_count, string_agg(DISTINCT service, '|' ORDER BY service) AS metric_services,
  (SELECT string_agg(service || ':' || metric_name, '|' ORDER BY service, CASE metric_name {_ORDER} END)
   FROM (SELECT DISTINCT service, metric_name FROM series s WHERE s.incident_id = m.incident_id)) AS series
FROM metrics m GROUP BY m.incident_id""", "metrics series"))
def _(spark, sf):
    out = d.metric_profile(t.metrics(spark, sf))
    return out.withColumns({c: F.array_join(c, "|") for c in ("metric_services", "series")})


@query("anomaly_totals", "D8", sql("""
SELECT 'metric' AS scope, metric_name AS name, count(*) AS points FROM points GROUP BY metric_name
UNION ALL SELECT 'severity', severity, count(*) FROM points GROUP BY severity
UNION ALL SELECT 'method', detection_method, count(*) FROM points GROUP BY detection_method
UNION ALL SELECT 'incident', incident_id, count(*) FROM points GROUP BY incident_id""", "points"))
def _(spark, sf):
    return s.point_totals(t.points(spark, sf))


_LABEL_CASE = " ".join(f"WHEN '{m}' THEN {literal(text)}" for m, text in METRIC_LABELS.items())


@query("anomaly_metric_summary", "D9", sql(f"""
SELECT coalesce(p.incident_id, w.incident_id) AS incident_id, coalesce(p.metric_name, w.metric_name) AS metric_name,
  CASE coalesce(p.metric_name, w.metric_name) {_LABEL_CASE} END AS label,
  CASE coalesce(p.metric_name, w.metric_name) {_ORDER} END AS place, coalesce(point_count, 0) AS point_count,
  coalesce(window_count, 0) AS window_count, CASE top WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' END AS peak_severity
FROM (SELECT incident_id, metric_name, count(*) AS point_count, max({SEVERITY_RANK}) AS top FROM points GROUP BY ALL) p
FULL JOIN (SELECT incident_id, metric_name, count(*) AS window_count FROM (
  SELECT incident_id, unnest(affected_metrics) AS metric_name FROM windows) GROUP BY ALL) w
ON w.incident_id = p.incident_id AND w.metric_name = p.metric_name""", "points windows"))
def _(spark, sf):
    points = t.points(spark, sf)
    return s.metric_summary(points, t.windows_of(points))


block("per_case", "points windows labels_of", """
SELECT l.incident_id, scenario, CASE WHEN scenario = 'NORMAL' THEN 'NORMAL' ELSE 'FAILURE' END AS kind,
  (SELECT count(*) FROM points p WHERE p.incident_id = l.incident_id) AS points,
  (SELECT count(*) FROM windows w WHERE w.incident_id = l.incident_id) AS windows FROM labels_of l""")


@query("case_extremes", "D10", sql("""
SELECT kind, count(*) AS cases, min(points) AS min_points, list_sort(list(points))[count(*) // 2 + 1] AS middle_points,
  max(points) AS max_points, min(windows) AS min_windows, list_sort(list(windows))[count(*) // 2 + 1] AS middle_windows,
  max(windows) AS max_windows FROM per_case GROUP BY kind""", "per_case"))
def _(spark, sf):
    points = t.points(spark, sf)
    return s.group_extremes(points, t.windows_of(points), t.incidents(spark, sf), t.labels(spark, sf))


block("point_phases", "points cases", """
SELECT p.*, c.scenario, coalesce(p.timestamp < c.fault_start_time, false) AS before_fault,
  coalesce(p.timestamp BETWEEN c.fault_start_time AND c.end_time, false) AS in_fault_period,
  p.timestamp BETWEEN c.start_time AND c.end_time AS in_alert, p.timestamp > c.end_time AS after_end
FROM points p JOIN cases c ON c.incident_id = p.incident_id""")


@query("phase_counts", "C4 C6", sql("""
SELECT scenario, metric_name, count(*) FILTER (before_fault) AS before_fault, count(*) FILTER (in_fault_period)
  AS in_fault_period, count(*) FILTER (in_alert) AS in_alert, count(*) FILTER (after_end) AS after_end
FROM point_phases GROUP BY ALL""", "point_phases"))
def _(spark, sf):
    return s.phase_counts(t.points(spark, sf), t.incidents(spark, sf), t.labels(spark, sf))


@query("quiet_failures", "C5", sql("""
SELECT incident_id, scenario FROM cases c WHERE scenario <> 'NORMAL' AND NOT EXISTS (SELECT 1 FROM windows w
  WHERE w.incident_id = c.incident_id AND w.severity = 'HIGH' AND w.start_time <= c.end_time AND w.end_time >= c.start_time)""",
                               "cases windows"))
def _(spark, sf):
    loud = t.windows(spark, sf).where("severity = 'HIGH'")
    return s.quiet_failures(loud, t.incidents(spark, sf), t.labels(spark, sf))


@query("points_after_alert", "D11", sql("""
SELECT metric_name || ':' || coalesce(direction, 'none') AS name, count(*) AS points FROM point_phases
WHERE after_end GROUP BY ALL""", "point_phases"))
def _(spark, sf):
    return s.after_end_counts(t.points(spark, sf), t.incidents(spark, sf), t.labels(spark, sf))


@query("busiest_series", "D11 F4", sql("""
SELECT incident_id, service, metric_name, points, round(points / n, 3) AS share_of_series FROM (
  SELECT p.*, (SELECT count(*) FROM series s WHERE s.incident_id = p.incident_id AND s.service = p.service
               AND s.metric_name = p.metric_name) AS n
  FROM (SELECT incident_id, service, metric_name, count(*) AS points FROM points GROUP BY ALL
        ORDER BY points DESC, incident_id, service, metric_name LIMIT 5) p)""", "points series"))
def _(spark, sf):
    return s.top_series(t.points(spark, sf), t.metrics(spark, sf))


block("alert_times", "metrics cases points", """
SELECT m.incident_id, m.timestamp, scenario, EXISTS (SELECT 1 FROM points p WHERE p.incident_id = m.incident_id
  AND p.timestamp = m.timestamp) AS hit
FROM (SELECT DISTINCT incident_id, timestamp FROM metrics) m JOIN cases c ON c.incident_id = m.incident_id
AND m.timestamp BETWEEN c.start_time AND c.end_time""")


@query("alert_minutes", "D12", sql("""
SELECT incident_id, count(*) AS alert_minutes, count(*) FILTER (hit) AS flagged_minutes FROM alert_times GROUP BY incident_id""",
                               "alert_times"))
def _(spark, sf):
    return s.alert_minutes(t.points(spark, sf), t.metrics(spark, sf), t.incidents(spark, sf))


def _sanity(points: str, windows: str, config: str) -> str:
    return f"""
SELECT '{config}' AS config, (SELECT count(*) FROM incidents) AS incidents, points, windows, observations,
  incidents_with_anomaly, normal_points, normal_high, normal_in_alert, normal_observations,
  round(1000.0 * normal_points / normal_observations, 3) AS normal_rate, early_points, early_observations,
  round(1000.0 * early_points / early_observations, 3) AS early_rate, failures, failures_covered, alert_minutes,
  flagged_minutes, round(flagged_minutes / alert_minutes, 3) AS share_of_alert_minutes
FROM (SELECT count(*) AS points, count(DISTINCT p.incident_id) AS incidents_with_anomaly,
    count(*) FILTER (scenario = 'NORMAL') AS normal_points,
    count(*) FILTER (scenario = 'NORMAL' AND p.severity = 'HIGH') AS normal_high,
    count(*) FILTER (scenario = 'NORMAL' AND p.timestamp BETWEEN start_time AND end_time) AS normal_in_alert,
    count(*) FILTER (p.timestamp < fault_start_time) AS early_points
  FROM {points} p JOIN cases c ON c.incident_id = p.incident_id),
 (SELECT count(*) AS windows FROM {windows}),
 (SELECT count(*) AS observations, count(*) FILTER (scenario = 'NORMAL') AS normal_observations,
    count(*) FILTER (x.timestamp < fault_start_time) AS early_observations
  FROM series x JOIN cases c ON c.incident_id = x.incident_id),
 (SELECT count(*) AS failures, count(*) FILTER (EXISTS (SELECT 1 FROM {windows} w WHERE w.incident_id = c.incident_id
    AND w.start_time <= c.end_time AND w.end_time >= c.fault_start_time)) AS failures_covered
  FROM cases c WHERE scenario <> 'NORMAL'),
 (SELECT count(*) AS alert_minutes, count(*) FILTER (EXISTS (SELECT 1 FROM {points} p WHERE p.incident_id = m.incident_id
    AND p.timestamp = m.timestamp)) AS flagged_minutes
  FROM (SELECT DISTINCT m.incident_id, m.timestamp FROM metrics m JOIN cases c ON c.incident_id = m.incident_id
        AND scenario <> 'NORMAL' AND m.timestamp BETWEEN c.start_time AND c.end_time) m)"""


@query("detector_sanity", "D11", sql(_sanity("points", "windows", "default"), "points windows series cases metrics"))
def _(spark, sf):
    points = t.points(spark, sf)
    out = s.detector_sanity(points, t.windows_of(points), t.metrics(spark, sf), t.incidents(spark, sf), t.labels(spark, sf))
    return out.withColumn("config", F.lit("default"))


def _spans(points: str) -> str:
    return f"""
SELECT incident_id, no, min(timestamp) AS start_time, max(timestamp) AS end_time FROM (
  SELECT *, sum(opens) OVER (PARTITION BY incident_id ORDER BY timestamp, service, metric_name) AS no FROM (
    SELECT *, CASE WHEN timestamp <= lag(timestamp) OVER (PARTITION BY incident_id ORDER BY timestamp, service, metric_name)
      + INTERVAL '2' MINUTE THEN 0 ELSE 1 END AS opens FROM {points})) GROUP BY incident_id, no"""


block("fold_no_lag", "series_rows", fold(lag=0).replace("fold f JOIN", "fold_no_lag f JOIN"))
block("points_no_lag", "fold_no_lag", "SELECT * EXCLUDE (i, hist) FROM fold_no_lag WHERE detection_method IS NOT NULL")
block("windows_no_lag", "points_no_lag", _spans("points_no_lag"))
block("points_plain", "scores_no_lag", "SELECT * FROM scores_no_lag WHERE detection_method IS NOT NULL")
block("windows_plain", "points_plain", _spans("points_plain"))


@query("settings_ablation", "D13 E6", sql(
    _sanity("points", "windows", "default") + " UNION ALL " + _sanity("points_no_lag", "windows_no_lag", "no drift check")
    + " UNION ALL " + _sanity("points_plain", "windows_plain", "plain rolling"),
    "points windows points_no_lag windows_no_lag points_plain windows_plain series cases metrics"))
def _(spark, sf):
    return s.ablation(t.metrics(spark, sf), t.incidents(spark, sf), t.labels(spark, sf))


@query("dataset_summary", "D16", sql(f"""
SELECT 'cases' AS section, scenario AS name, count(*) AS value FROM labels_of GROUP BY scenario
UNION ALL SELECT 'cases', 'all', count(*) FROM incidents
UNION ALL SELECT 'log level', CASE WHEN raw_level IN ('INFO', 'WARN', 'ERROR') THEN raw_level ELSE 'other' END, count(*)
  FROM raw_logs GROUP BY ALL
UNION ALL SELECT 'blank', 'rows', count(*) FROM metrics
{' '.join(f"UNION ALL SELECT 'blank', '{m}', count(*) FILTER ({m} IS NULL) FROM metrics" for m in METRICS)}""",
                                "labels_of incidents raw_logs metrics"))
def _(spark, sf):
    return d.dataset_summary(t.incidents(spark, sf), t.labels(spark, sf), t.metrics(spark, sf), t.raw_logs(spark, sf))


@query("blank_services", "D16", sql(f"""
SELECT metric_name, string_agg(DISTINCT service, '|' ORDER BY service) AS services FROM (
{' UNION ALL '.join(f"SELECT '{m}' AS metric_name, service FROM metrics WHERE {m} IS NULL" for m in METRICS)}) GROUP BY ALL""",
                               "metrics"))
def _(spark, sf):
    return d.blank_services(t.metrics(spark, sf)).withColumn("services", F.array_join("services", "|"))


@query("date_range", "D16", sql("SELECT min(window_start) AS first, max(window_end) AS last FROM incidents", "incidents"))
def _(spark, sf):
    return d.date_range(t.incidents(spark, sf))


@query("phase_metric_stats", "D17 E15", sql(f"""
SELECT scenario, phase, metric_name, {_FIGURES} FROM (
  SELECT *, 'baseline' AS phase FROM long_case WHERE in_base AND service = focus
  UNION ALL SELECT *, 'incident' FROM long_case WHERE in_alert AND service = focus) GROUP BY ALL""", "long_case"))
def _(spark, sf):
    return rounded(f.phase_stats(t.metrics(spark, sf), cases(spark, sf), BEFORE), "mean", "std")


@query("scenario_metric_stats", "D18 C3", sql(f"""
SELECT scenario, metric_name, {_FIGURES} FROM long_case GROUP BY ALL""", "long_case"))
def _(spark, sf):
    return rounded(f.scenario_stats(t.metrics(spark, sf), cases(spark, sf)), "mean", "std")


def _med(name, who="focus"):
    return f"median(CASE WHEN in_base AND service = {who} THEN {name} END)"


def _top(name, who="focus", phase="in_alert"):
    return f"max(CASE WHEN {phase} AND service = {who} THEN {name} END)"


block("signals", "cases case_metrics", f"""
SELECT c.incident_id, s.* EXCLUDE (incident_id, memory_top, rb_lat, rp_lat, rb_err, rp_err, rb_ds, rp_ds, rb_mem, rp_mem),
  memory_top - base_memory_usage AS mem_rise, peak_latency_ms / nullif(base_latency_ms, 0) AS latency_ratio,
  peak_error_rate - base_error_rate AS error_delta, peak_cpu_usage / nullif(base_cpu_usage, 0) AS cpu_ratio,
  peak_request_rate / nullif(base_request_rate, 0) AS request_rate_ratio,
  peak_db_connection_utilization / nullif(base_db_connection_utilization, 0) AS db_ratio,
  rp_ds / nullif(rb_ds, 0) AS reported_ds_ratio, rp_lat / nullif(rb_lat, 0) AS reported_latency_ratio,
  rp_err - rb_err AS reported_error_delta, rp_mem - rb_mem AS reported_memory_delta
FROM cases c LEFT JOIN (
  SELECT incident_id, {', '.join(f"{_med(m)} AS base_{m}, {_top(m)} AS peak_{m}" for m in METRICS)},
    {_top('memory_usage', phase='in_fault')} AS memory_top, max(CASE WHEN in_alert THEN error_rate END) AS max_error_any_service,
    {_med('latency_ms', 'reported')} AS rb_lat, {_top('latency_ms', 'reported')} AS rp_lat,
    {_med('error_rate', 'reported')} AS rb_err, {_top('error_rate', 'reported')} AS rp_err,
    {_med('downstream_latency_ms', 'reported')} AS rb_ds, {_top('downstream_latency_ms', 'reported')} AS rp_ds,
    {_med('memory_usage', 'reported')} AS rb_mem, {_top('memory_usage', 'reported')} AS rp_mem
  FROM case_metrics GROUP BY incident_id) s ON s.incident_id = c.incident_id""")
_SIGNALS = [f"{p}_{m}" for m in METRICS for p in ("base", "peak")] + [
    "max_error_any_service", "mem_rise", "latency_ratio", "error_delta", "cpu_ratio", "request_rate_ratio", "db_ratio",
    "reported_ds_ratio", "reported_latency_ratio", "reported_error_delta", "reported_memory_delta"]


@query("incident_signals", "D19", sql(f"""
SELECT incident_id, {', '.join(f'round({c}, 6) AS {c}' for c in _SIGNALS)} FROM signals""", "signals"))
def _(spark, sf):
    return rounded(f.signals(t.metrics(spark, sf), cases(spark, sf), BEFORE), *_SIGNALS).select("incident_id", *_SIGNALS)


_RATES = ("warn", "error", "timeout")
_tests = {"warn": "level = 'WARN'", "error": "level = 'ERROR'",
          "timeout": f"({matches('message', TIMEOUT_WORDS)} AND level IN ('WARN', 'ERROR'))"}
block("log_rates", "cases logs", f"""
SELECT c.incident_id, count(l.seq) AS log_records, count(l.seq) FILTER (level = 'INFO') AS info_logs,
  count(l.seq) FILTER (level = 'WARN') AS warn_logs, count(l.seq) FILTER (level = 'ERROR') AS error_logs,
  count(l.seq) FILTER (level = 'INFO') / greatest(1, count(l.seq)) AS info_share,
  count(l.seq) FILTER ({_tests['timeout']} AND l.timestamp BETWEEN c.start_time AND c.end_time) AS timeout_logs_incident,
  {', '.join(f'''count(l.seq) FILTER ({_tests[r]} AND l.timestamp BETWEEN c.ref - INTERVAL '{BEFORE}' MINUTE
     AND c.ref - INTERVAL '1' MINUTE) / {float(BEFORE - 1)} AS {r}_per_min_baseline,
  count(l.seq) FILTER ({_tests[r]} AND l.timestamp BETWEEN c.start_time AND c.end_time)
     / greatest(1.0, {minutes_sql('c.start_time', 'c.end_time')}) AS {r}_per_min_incident''' for r in _RATES)},
  round({minutes_sql('c.ref', f"min(l.timestamp) FILTER ({_tests['timeout']} AND l.timestamp >= c.ref - INTERVAL '5' MINUTE)")}, 1)
    AS onset_timeout_log
FROM cases c LEFT JOIN logs l ON l.incident_id = c.incident_id GROUP BY c.incident_id, c.ref, c.start_time, c.end_time""")
_RATE_COLUMNS = ["info_share"] + [f"{r}_per_min_{w}" for r in _RATES for w in ("baseline", "incident")]


@query("incident_log_rates", "D20 D42", sql(f"""
SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _RATE_COLUMNS)}) FROM log_rates""", "log_rates"))
def _(spark, sf):
    return rounded(f.log_rates(t.logs(spark, sf), cases(spark, sf), BEFORE), *_RATE_COLUMNS)


block("minute_rows", "logs incidents", f"""
SELECT l.incident_id, cast(floor({minutes_sql('window_start', 'timestamp')}) AS bigint) AS minute, level, count(*) AS lines
FROM logs l JOIN incidents i ON i.incident_id = l.incident_id GROUP BY ALL""")


@query("minute_histogram", "D42 E15", sql("SELECT * FROM minute_rows", "minute_rows"))
def _(spark, sf):
    return d.minute_histogram(t.logs(spark, sf), t.incidents(spark, sf))


# Fault periods run to the end of the day here, so that sparse test series have a shape.
def long_cases(spark, sf):
    return cases(spark, sf).withColumn("end_time", F.col("window_end"))


block("fault_rows", "metrics cases", """
SELECT m.*, ref FROM metrics m JOIN cases c ON c.incident_id = m.incident_id AND c.focus = m.service
AND m.timestamp BETWEEN c.ref AND c.window_end""")
block("shape_steps", "fault_rows", """
SELECT incident_id, timestamp, memory_usage AS value,
  memory_usage - lag(memory_usage) OVER (PARTITION BY incident_id ORDER BY timestamp) AS step FROM fault_rows""")
block("shapes", "shape_steps", f"""
SELECT incident_id, max(x) AS minutes_to_peak, CASE WHEN var_pop(x) > 0 THEN regr_slope(value, x) END AS slope,
  CASE WHEN var_pop(value) > 0 THEN regr_r2(value, x) END AS linear_r2,
  CASE WHEN max(value) - arg_min(value, timestamp) > 0 THEN max(step) / (max(value) - arg_min(value, timestamp)) END
    AS max_step_share
FROM (SELECT k.*, {minutes_sql('min(k.timestamp) OVER (PARTITION BY k.incident_id)', 'k.timestamp')} AS x FROM (
  SELECT *, first_value(timestamp) OVER (PARTITION BY incident_id ORDER BY value DESC, timestamp) AS top FROM (
    SELECT a.* FROM shape_steps a LEFT JOIN (SELECT incident_id, min(timestamp) AS at_drop FROM shape_steps
      WHERE step < -15 GROUP BY incident_id) b ON b.incident_id = a.incident_id
    WHERE at_drop IS NULL OR timestamp <= at_drop - INTERVAL '1' MINUTE)) k WHERE timestamp <= top) GROUP BY incident_id""")


@query("growth_shapes", "D21 E11", sql("""
SELECT incident_id, minutes_to_peak, round(slope, 6) AS slope, round(linear_r2, 6) AS linear_r2,
  round(max_step_share, 6) AS max_step_share FROM shapes""", "shapes"))
def _(spark, sf):
    return rounded(f.growth_shape(t.metrics(spark, sf), long_cases(spark, sf)), "slope", "linear_r2", "max_step_share")


@query("series_steps", "E11", sql("""
SELECT incident_id, service, metric_name, round(max(step), 6) AS largest_step, min(timestamp) FILTER (step < -15) AS first_drop
FROM (SELECT *, value - lag(value) OVER (PARTITION BY incident_id, service, metric_name ORDER BY timestamp) AS step
      FROM series) GROUP BY ALL""", "series"))
def _(spark, sf):
    return rounded(f.steps(t.series(spark, sf), ["incident_id", "service", "metric_name"]), "largest_step")


block("spearman", "fault_rows", """
SELECT incident_id, corr(rm, rl) AS spearman FROM (
  SELECT incident_id, rank() OVER (PARTITION BY incident_id ORDER BY memory_usage)
      + (count(*) OVER (PARTITION BY incident_id, memory_usage) - 1) / 2 AS rm,
    rank() OVER (PARTITION BY incident_id ORDER BY latency_ms)
      + (count(*) OVER (PARTITION BY incident_id, latency_ms) - 1) / 2 AS rl
  FROM fault_rows WHERE memory_usage IS NOT NULL AND latency_ms IS NOT NULL) GROUP BY incident_id""")


@query("rank_correlation", "D22", sql("SELECT incident_id, round(spearman, 6) AS spearman FROM spearman", "spearman"))
def _(spark, sf):
    return rounded(f.rank_correlation(t.metrics(spark, sf), long_cases(spark, sf), "memory_usage", "latency_ms"), "spearman")


def _runs(where: str, over: str) -> str:
    return f"""
SELECT incident_id, service, max(n) AS longest_run FROM (
  SELECT incident_id, service, island, count(*) FILTER (over_it) AS n FROM (
    SELECT *, sum(CASE WHEN over_it THEN 0 ELSE 1 END) OVER (PARTITION BY incident_id, service ORDER BY timestamp) AS island
    FROM (SELECT incident_id, service, timestamp, coalesce({over}, false) AS over_it FROM metrics {where}))
  GROUP BY ALL) GROUP BY ALL"""


@query("longest_error_runs", "E10", sql(_runs("", "error_rate > 2"), "metrics"))
def _(spark, sf):
    return f.longest_run(t.metrics(spark, sf), ["incident_id", "service"], F.col("error_rate") > 2)


block("normals", "metrics cases logs signals", f"""
SELECT c.incident_id, max(error_rate) AS max_error_rate, max(db_connection_utilization) AS max_db_util,
  stddev_samp(latency_ms) FILTER (m.service = focus) / avg(latency_ms) FILTER (m.service = focus) AS latency_cv,
  max(memory_usage) FILTER (m.service = focus) - min(memory_usage) FILTER (m.service = focus) AS memory_range,
  (SELECT max(longest_run) FROM ({_runs('', 'error_rate > 2')}) r WHERE r.incident_id = c.incident_id) AS longest_error_run,
  (SELECT count(*) FROM logs l WHERE l.incident_id = c.incident_id AND level = 'WARN') AS warn_logs,
  (SELECT count(*) FROM logs l WHERE l.incident_id = c.incident_id AND level = 'ERROR') AS error_logs,
  (SELECT latency_ratio FROM signals g WHERE g.incident_id = c.incident_id) AS latency_peak_ratio
FROM cases c JOIN metrics m ON m.incident_id = c.incident_id WHERE scenario = 'NORMAL' GROUP BY c.incident_id""")


@query("normal_profiles", "D23", sql("""
SELECT * REPLACE (round(latency_cv, 6) AS latency_cv, round(memory_range, 6) AS memory_range, round(latency_peak_ratio, 6)
  AS latency_peak_ratio), round(warn_logs / 1440.0, 6) AS warn_per_min FROM normals""", "normals"))
def _(spark, sf):
    table = cases(spark, sf)
    metrics = t.metrics(spark, sf)
    out = f.normal_profile(metrics, t.logs(spark, sf), table, f.signals(metrics, table, BEFORE))
    return rounded(out, "latency_cv", "memory_range", "latency_peak_ratio", "warn_per_min")


def _hits(column: str, threshold: str, signal: str, where: str = "true") -> str:
    return f"""
SELECT incident_id, '{signal}' AS signal, round({minutes_sql('ref', "min(timestamp) - INTERVAL '1' MINUTE")}, 1) AS onset
FROM (SELECT *, over_it AND lag(over_it) OVER (PARTITION BY incident_id ORDER BY timestamp) AS hit
      FROM (SELECT c.incident_id, ref, m.timestamp, coalesce({column} > {threshold}, false) AS over_it
            FROM metrics m JOIN cases c ON c.incident_id = m.incident_id AND c.focus = m.service
            JOIN signals s ON s.incident_id = m.incident_id
            WHERE m.timestamp >= ref - INTERVAL '5' MINUTE AND {where})) WHERE hit GROUP BY incident_id, ref"""


block("signal_onsets", "metrics cases signals", " UNION ALL ".join([
    _hits("latency_ms", "2 * base_latency_ms", "latency"), _hits("error_rate", "base_error_rate + 1", "error"),
    _hits("db_connection_utilization", "85", "primary", f"scenario = '{FAILURES[0]}'"),
    _hits("memory_usage", "base_memory_usage + 10", "primary", f"scenario = '{FAILURES[1]}'"),
    _hits("downstream_latency_ms", "2 * base_downstream_latency_ms", "primary", f"scenario = '{FAILURES[2]}'")]))


def onsets(spark, sf):
    table = cases(spark, sf)
    metrics = t.metrics(spark, sf)
    return f.signal_onsets(metrics, table, f.signals(metrics, table, BEFORE))


@query("signal_onsets", "E9", sql("SELECT incident_id, signal, onset FROM signal_onsets", "signal_onsets"))
def _(spark, sf):
    return onsets(spark, sf)


block("orderings", "signal_onsets", """
SELECT incident_id, string_agg(names, ' < ' ORDER BY onset) ||
  CASE WHEN sum(n) = 3 THEN '' ELSE ' (not all signals crossed)' END AS ordering
FROM (SELECT incident_id, onset, string_agg(signal, '=' ORDER BY signal) AS names, count(*) AS n FROM signal_onsets
      GROUP BY incident_id, onset) GROUP BY incident_id""")


@query("signal_orderings", "D27", sql("""
SELECT scenario, ordering, count(*) AS cases FROM orderings o JOIN labels_of l ON l.incident_id = o.incident_id GROUP BY ALL""",
                                 "orderings labels_of"))
def _(spark, sf):
    orders = f.signal_order(onsets(spark, sf)).join(t.labels(spark, sf).select("incident_id", "scenario"), "incident_id")
    return orders.groupBy("scenario", "ordering").agg(F.count("*").alias("cases"))


@query("onset_lags", "D27 D28", sql("""
SELECT scenario, signal, count(*) AS n, round(min(lag_min), 6) AS min, round(max(lag_min), 6) AS max,
  round(avg(lag_min), 6) AS mean, round(stddev_samp(lag_min), 6) AS std
FROM (SELECT l.scenario, a.signal, a.onset - p.onset AS lag_min FROM signal_onsets a
  JOIN signal_onsets p ON p.incident_id = a.incident_id AND p.signal = 'primary'
  JOIN labels_of l ON l.incident_id = a.incident_id WHERE a.signal <> 'primary') GROUP BY ALL""", "signal_onsets labels_of"))
def _(spark, sf):
    wide = onsets(spark, sf).groupBy("incident_id").pivot("signal", ["primary", "latency", "error"]).agg(F.first("onset"))
    lags = wide.select("incident_id", *[(F.col(c) - F.col("primary")).alias(c) for c in ("latency", "error")])
    lags = lags.join(t.labels(spark, sf).select("incident_id", "scenario"), "incident_id")
    out = d.describe(lags, ["scenario"], ["latency", "error"]).withColumnRenamed("name", "signal").drop("cv")
    return rounded(out, "min", "max", "mean", "std")


def _templates(levels: str) -> str:
    return f"""SELECT DISTINCT l.incident_id, scenario, regexp_replace(regexp_replace(message, {literal(HEX_RUN)}, '#', 'g'),
  {literal(NUMBER_RUN)}, '#', 'g') AS template FROM logs l JOIN labels_of g ON g.incident_id = l.incident_id
WHERE level IN {levels}"""


block("loud_templates", "logs labels_of", _templates("('WARN', 'ERROR')"))
block("error_templates", "logs labels_of", _templates("('ERROR')"))
block("coverage", "loud_templates labels_of", f"""
SELECT s.scenario, template, count(*) FILTER (p.scenario = s.scenario) / s.size AS coverage_in,
  count(*) FILTER (p.scenario <> s.scenario) AS cases_outside
FROM loud_templates p, (SELECT scenario, count(*) AS size FROM labels_of WHERE scenario IN {in_list(FAILURES)}
  GROUP BY scenario) s GROUP BY s.scenario, s.size, template""")


@query("template_coverage", "C11 F8", sql("""
SELECT scenario, template, round(coverage_in, 6) AS coverage_in, cases_outside FROM coverage""", "coverage"))
def _(spark, sf):
    return rounded(tp.template_coverage(t.logs(spark, sf), t.labels(spark, sf)), "coverage_in")


@query("best_templates", "D24", sql("""
SELECT kind, scenario, template, round(coverage_in, 6) AS coverage_in, cases_outside, place FROM (
  SELECT *, row_number() OVER (PARTITION BY kind, scenario ORDER BY coverage_in DESC, cases_outside, template) AS place
  FROM (SELECT *, 'common' AS kind FROM coverage UNION ALL SELECT *, 'exclusive' FROM coverage WHERE cases_outside = 0))
WHERE place <= 3""", "coverage"))
def _(spark, sf):
    coverage = tp.template_coverage(t.logs(spark, sf), t.labels(spark, sf))
    return rounded(tp.best_templates(coverage), "coverage_in")


@query("template_totals", "D24", sql("""
SELECT c.scenario, in_every_case, in_every_case_and_nowhere_else, coalesce(n, 0) AS unique_error_templates FROM (
  SELECT scenario, count(*) FILTER (coverage_in = 1) AS in_every_case,
    count(*) FILTER (coverage_in = 1 AND cases_outside = 0) AS in_every_case_and_nowhere_else FROM coverage GROUP BY scenario) c
LEFT JOIN (SELECT scenario, count(DISTINCT template) AS n FROM error_templates GROUP BY scenario) e ON e.scenario = c.scenario""",
                                "coverage error_templates"))
def _(spark, sf):
    return tp.template_totals(t.logs(spark, sf), t.labels(spark, sf))


@query("template_similarity", "C10", sql(f"""
SELECT scenario, round(avg(score), 5) AS mean_similarity, round(max(score), 5) AS max_similarity, count(*) AS pairs FROM (
  SELECT a.scenario, len(list_intersect(a.set, b.set)) / len(list_distinct(list_concat(a.set, b.set))) AS score
  FROM (SELECT scenario, incident_id, list(template) AS set FROM error_templates GROUP BY ALL) a
  JOIN (SELECT scenario, incident_id, list(template) AS set FROM error_templates GROUP BY ALL) b
  ON b.scenario = a.scenario AND b.incident_id > a.incident_id WHERE a.scenario IN {in_list(FAILURES)}) GROUP BY scenario""",
                                   "error_templates"))
def _(spark, sf):
    return rounded(tp.template_similarity(t.logs(spark, sf), t.labels(spark, sf)), "mean_similarity", "max_similarity", digits=5)


@query("keyword_presence", "D25", sql(" UNION ALL ".join(f"""
SELECT scenario, {literal(k)} AS keyword, round(avg(hit), 6) AS share FROM (
  SELECT g.scenario, g.incident_id, max(CASE WHEN level IN ('WARN', 'ERROR') AND {matches('message', p)} THEN 1 ELSE 0 END) AS hit
  FROM labels_of g LEFT JOIN logs l ON l.incident_id = g.incident_id GROUP BY ALL) GROUP BY scenario"""
                                                         for k, p in KEYWORDS.items()), "labels_of logs"))
def _(spark, sf):
    return rounded(tp.keyword_presence(t.logs(spark, sf), t.labels(spark, sf)), "share")


@query("shared_metric_rows", "D26", sql(f"""
SELECT l_returnflag AS service, l_quantity AS cpu_usage, l_discount AS memory_usage, l_tax AS request_rate,
  count(DISTINCT l_linenumber) AS incidents FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_linenumber) > 1"""))
def _(spark, sf):
    empty = {m: F.lit(None).cast("double") for m in METRICS[3:]}
    rows = t.read(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("incident_id"), F.col("l_returnflag").alias("service"),
        F.col("l_quantity").alias("cpu_usage"), F.col("l_discount").alias("memory_usage"), F.col("l_tax").alias("request_rate"))
    return tp.shared_metric_rows(rows.withColumns(empty)).drop(*empty)


@query("description_words", "D26", sql(f"""
SELECT scenario, word, count(*) FILTER (contains(lower(title || ' ' || description), word)) AS cases
FROM incidents i JOIN labels_of l ON l.incident_id = i.incident_id,
  (VALUES {', '.join(f"({literal(w)})" for w in DESCRIPTION_WORDS)}) v(word) GROUP BY ALL""", "incidents labels_of"))
def _(spark, sf):
    return tp.description_words(t.incidents(spark, sf), t.labels(spark, sf))


def measured(spark, sf):
    table = cases(spark, sf)
    return table, f.signals(t.metrics(spark, sf), table, BEFORE)


def checks(spark, sf):
    table, found = measured(spark, sf)
    metrics, logs = t.metrics(spark, sf), t.logs(spark, sf)
    return d.scenario_checks(
        found, table, f.log_rates(logs, table, BEFORE), f.growth_shape(metrics, long_cases(spark, sf)),
        f.rank_correlation(metrics, long_cases(spark, sf), "memory_usage", "latency_ms"),
        f.signal_onsets(metrics, table, found), f.normal_profile(metrics, logs, table, found))


_PATTERNS = {
    FAILURES[0]: {
        "db util baseline <= 75% and peak >= 90%": "base_db_connection_utilization <= 75 AND peak_db_connection_utilization >= 90",
        "latency peak >= 2x baseline": "latency_ratio >= 2", "error rate rises >= 1 pp": "error_delta >= 1",
        "timeout-related WARN/ERROR rate higher than baseline": "timeout_per_min_incident > timeout_per_min_baseline",
        "CPU ratio smaller than DB-util ratio and latency ratio": "cpu_ratio < db_ratio AND cpu_ratio < latency_ratio",
        "CPU peak/baseline >= 2 (CPU strongly elevated)": "cpu_ratio >= 2", "memory change within +/-5 pp": "abs(peak_memory_usage - base_memory_usage) <= 5"},
    FAILURES[1]: {
        "memory rises >= 15 pp": "mem_rise >= 15", "leak phase linear-fit R^2 >= 0.9 (gradual trend)": "linear_r2 >= 0.9",
        "largest 1-min step < 10% of total rise (no single jump)": "max_step_share < 0.1", "latency peak >= 1.5x baseline": "latency_ratio >= 1.5",
        "Spearman(memory, latency) >= 0.5 during fault..end": "spearman >= 0.5", "error rate rises >= 1 pp": "error_delta >= 1",
        "error onset after memory onset": "onset_error > onset_primary", "db util peak < 60%": "peak_db_connection_utilization < 60"},
    FAILURES[2]: {
        "reported service downstream p95 >= 2.5x baseline": "reported_ds_ratio >= 2.5",
        "timeout-related WARN/ERROR rate higher than baseline": "timeout_per_min_incident > timeout_per_min_baseline",
        "reported service error rate rises >= 1 pp": "reported_error_delta >= 1", "focus CPU peak/baseline < 1.3": "cpu_ratio < 1.3",
        "focus memory change < 5 pp": "peak_memory_usage - base_memory_usage < 5",
        "focus db util peak < 90% (no pool saturation)": "coalesce(peak_db_connection_utilization, 0) < 90"},
    "NORMAL": {
        "no service with error rate > 2% for >= 1 min": "longest_error_run = 0", "no DB utilization >= 90%": "max_db_util < 90",
        "WARN logs present": "warn_logs > 0", "latency fluctuates (CV > 0.05 on alerting service)": "latency_cv > 0.05"},
}
block("all_features", "cases signals log_rates shapes spearman signal_onsets normals", """
SELECT c.scenario, s.*, r.* EXCLUDE (incident_id), h.* EXCLUDE (incident_id), p.spearman,
  n.* EXCLUDE (incident_id, warn_logs, error_logs),
  (SELECT onset FROM signal_onsets o WHERE o.incident_id = c.incident_id AND signal = 'primary') AS onset_primary,
  (SELECT onset FROM signal_onsets o WHERE o.incident_id = c.incident_id AND signal = 'error') AS onset_error
FROM cases c LEFT JOIN signals s ON s.incident_id = c.incident_id LEFT JOIN log_rates r ON r.incident_id = c.incident_id
LEFT JOIN shapes h ON h.incident_id = c.incident_id LEFT JOIN spearman p ON p.incident_id = c.incident_id
LEFT JOIN normals n ON n.incident_id = c.incident_id""")


@query("scenario_checks", "D29", sql(" UNION ALL ".join(
    f"SELECT '{sc}' AS scenario, {literal(name)} AS pattern, count(*) FILTER ({test}) || '/' || count(*) AS share "
    f"FROM all_features WHERE scenario = '{sc}'" for sc, tests in _PATTERNS.items() for name, test in tests.items()),
    "all_features"))
def _(spark, sf):
    return checks(spark, sf)


@query("severity_by_scenario", "D30", sql("""
SELECT scenario, count(*) FILTER (severity = 'LOW') AS "LOW", count(*) FILTER (severity = 'MEDIUM') AS "MEDIUM",
  count(*) FILTER (severity = 'HIGH') AS "HIGH", count(*) FILTER (severity = 'CRITICAL') AS "CRITICAL" FROM cases GROUP BY scenario""",
                                     "cases"))
def _(spark, sf):
    return d.severity_mix(cases(spark, sf))


_META = {"duration_minutes": "duration_minutes", "window_min": minutes_sql("window_start", "window_end"),
         "fault_offset_min": minutes_sql("window_start", "ref"), "alert_lag_min": minutes_sql("ref", "start_time"),
         "minutes_before_start": minutes_sql("window_start", "start_time")}


@query("position_ranges", "D30 D31 E15 D28", sql(" UNION ALL ".join(
    f"SELECT scenario, '{n}' AS name, round(min({e}), 6) AS min, round(max({e}), 6) AS max, round(avg({e}), 6) AS mean, "
    f"round(stddev_samp({e}), 6) AS std, count({e}) AS n, round(stddev_samp({e}) / nullif(avg({e}), 0), 6) AS cv "
    f"FROM cases GROUP BY scenario" for n, e in _META.items()), "cases"))
def _(spark, sf):
    out = d.describe(cases(spark, sf), ["scenario"], list(_META))
    return rounded(out, "min", "max", "mean", "std", "cv")


@query("start_variation", "D31", sql("""
SELECT scenario, min(cast(start_time AS date)) AS first_date, max(cast(start_time AS date)) AS last_date,
  count(DISTINCT start_time) AS unique_starts,
  (SELECT string_agg(h, ',' ORDER BY h) FROM (SELECT DISTINCT hour(start_time) AS h FROM cases y
   WHERE y.scenario = c.scenario)) AS start_hours FROM cases c GROUP BY scenario""", "cases"))
def _(spark, sf):
    out = d.start_variation(cases(spark, sf))
    return out.withColumn("start_hours", F.array_join(F.col("start_hours").cast("array<string>"), ","))


@query("case_value_counts", "D31", sql(" UNION ALL ".join(
    f"SELECT scenario, '{c}' AS field, {c} AS value, count(*) AS cases FROM cases WHERE {c} IS NOT NULL GROUP BY ALL"
    for c in ("severity", "service", "root_cause_service", "root_cause_variant")), "cases"))
def _(spark, sf):
    return d.value_counts(cases(spark, sf), ["severity", "service", "root_cause_service", "root_cause_variant"])


_FEATURES = ["base_cpu_usage", "base_memory_usage", "base_request_rate", "base_latency_ms", "latency_ratio", "error_delta",
             "peak_latency_ms", "peak_error_rate"]


@query("feature_variation", "D31 D28", sql(" UNION ALL ".join(
    f"SELECT scenario, '{n}' AS name, round(min({n}), 6) AS min, round(max({n}), 6) AS max, round(avg({n}), 6) AS mean, "
    f"round(stddev_samp({n}), 6) AS std, count({n}) AS n, round(stddev_samp({n}) / nullif(avg({n}), 0), 6) AS cv "
    f"FROM signals s JOIN labels_of l ON l.incident_id = s.incident_id WHERE {n} IS NOT NULL GROUP BY scenario"
    for n in _FEATURES).replace(", 6)", ", 9)"), "signals labels_of"))
def _(spark, sf):
    table, found = measured(spark, sf)
    rows = found.join(table.select("incident_id", "scenario"), "incident_id")
    return rounded(d.describe(rows, ["scenario"], _FEATURES), "min", "max", "mean", "std", "cv", digits=9)


block("error_runs", "metrics", f"""
SELECT r.incident_id, max(longest_run) AS longest_run, max(db) AS max_db_util FROM ({_runs('', 'error_rate > 5')}) r
JOIN (SELECT incident_id, max(db_connection_utilization) AS db FROM metrics GROUP BY ALL) m ON m.incident_id = r.incident_id
GROUP BY r.incident_id""")
block("top_steps", "fault_rows", """
SELECT incident_id, max(step) AS largest_step FROM (SELECT incident_id, memory_usage - lag(memory_usage) OVER (
  PARTITION BY incident_id ORDER BY timestamp) AS step FROM fault_rows) GROUP BY ALL""")
_db, _leak, _down = FAILURES
_SIGNATURES = {
    "sustained errors": "scenario = 'NORMAL' AND longest_run >= 3",
    "saturated pool": "scenario = 'NORMAL' AND max_db_util >= 90",
    "no visible impact": "scenario <> 'NORMAL' AND reported_error_delta < 0.5 AND reported_latency_ratio < 1.5",
    "pool does not saturate": f"scenario = '{_db}' AND (peak_db_connection_utilization < 90 OR base_db_connection_utilization > 75)",
    "memory does not grow": f"scenario = '{_leak}' AND (base_memory_usage + mem_rise < 80 OR mem_rise < 15)",
    "memory jumps": f"scenario = '{_leak}' AND base_memory_usage + mem_rise >= 80 AND mem_rise >= 15 AND largest_step > 0.3 * mem_rise",
    "downstream latency flat": f"scenario = '{_down}' AND coalesce(reported_ds_ratio < 2.5, true)",
    "local memory moves": f"scenario = '{_down}' AND reported_memory_delta > 10",
}
block("signature_rows", "signals cases error_runs top_steps", """
SELECT g.*, c.scenario, e.longest_run, e.max_db_util, p.largest_step FROM signals g JOIN cases c ON c.incident_id = g.incident_id
LEFT JOIN error_runs e ON e.incident_id = g.incident_id LEFT JOIN top_steps p ON p.incident_id = g.incident_id""")


@query("signature_checks", "D32", sql(_suite(" UNION ALL ".join(
    f"SELECT {literal(n)} AS name, incident_id AS problem FROM signature_rows WHERE {test}" for n, test in _SIGNATURES.items()),
    d.SIGNATURE_CHECKS), "signature_rows"))
def _(spark, sf):
    table, found = measured(spark, sf)
    metrics = t.metrics(spark, sf)
    top = metrics.groupBy("incident_id").agg(F.max("db_connection_utilization").alias("max_db_util"))
    runs = f.longest_run(metrics, ["incident_id", "service"], F.col("error_rate") > 5).groupBy("incident_id").agg(
        F.max("longest_run").alias("longest_run")).join(top, "incident_id")
    fault = f._fault_rows(metrics, long_cases(spark, sf), "memory_usage")
    shapes = f.steps(fault, ["incident_id"])
    return _flat(q.report(d.signature_problems(found, shapes, table, runs), d.SIGNATURE_CHECKS))


@query("level_mix", "D33", sql("""
SELECT l.incident_id, n, info, warn, error, scenario, concat_ws('|', CASE WHEN info = 0 THEN 'no INFO' END,
  CASE WHEN scenario <> 'NORMAL' AND (error = 0 OR warn = 0) THEN 'failure without WARN or ERROR' END,
  CASE WHEN scenario <> 'NORMAL' AND info / n < 0.4 THEN 'too few INFO' END,
  CASE WHEN scenario = 'NORMAL' AND warn = 0 THEN 'normal without WARN' END) AS problems
FROM (SELECT incident_id, count(*) AS n, count(*) FILTER (level = 'INFO') AS info, count(*) FILTER (level = 'WARN') AS warn,
  count(*) FILTER (level = 'ERROR') AS error FROM logs GROUP BY incident_id) l
JOIN labels_of g ON g.incident_id = l.incident_id""", "logs labels_of"))
def _(spark, sf):
    return tp.level_mix(t.logs(spark, sf), t.labels(spark, sf)).withColumn("problems", F.array_join("problems", "|"))


_FAILS = f"scenario IN {in_list(FAILURES)}"
block("variation", "cases metrics logs error_templates", f"""
SELECT scenario, count(*) AS cases, count(DISTINCT (service, root_cause_service)) AS pairs, count(DISTINCT severity) AS severities,
  count(DISTINCT duration_minutes) AS durations, count(DISTINCT start_time) AS starts,
  coalesce(stddev_pop(err) / nullif(avg(err), 0), 0) AS error_cv, coalesce(stddev_pop(lat) / nullif(avg(lat), 0), 0) AS latency_cv,
  coalesce(stddev_pop(lines) / nullif(avg(lines), 0), 0) AS lines_cv, count(DISTINCT coalesce(set, 'none')) / count(*) AS unique_sets
FROM (SELECT c.*, (SELECT coalesce(max(error_rate), 0) FROM metrics m WHERE m.incident_id = c.incident_id AND m.service = c.service
    AND m.timestamp BETWEEN c.start_time AND c.end_time) AS err,
  (SELECT coalesce(max(latency_ms), 0) FROM metrics m WHERE m.incident_id = c.incident_id AND m.service = c.service
    AND m.timestamp BETWEEN c.start_time AND c.end_time) AS lat,
  (SELECT count(*) FROM logs l WHERE l.incident_id = c.incident_id) AS lines,
  (SELECT string_agg(template, '~' ORDER BY template) FROM error_templates e WHERE e.incident_id = c.incident_id) AS set
  FROM cases c WHERE {_FAILS}) GROUP BY scenario""")
_VARIATION = {
    "same services": "pairs < 2", "same severity": "severities < 2", "same durations": "durations < 0.8 * cases",
    "same starts": "starts <> cases", "error_cv too even": "error_cv < 0.1", "latency_cv too even": "latency_cv < 0.1",
    "lines_cv too even": "lines_cv < 0.1", "same error sets": "unique_sets < 0.8"}


@query("variation_checks", "D34", sql(_suite(" UNION ALL ".join(
    f"SELECT {literal(n)} AS name, scenario AS problem FROM variation WHERE {test}" for n, test in _VARIATION.items()),
    d.VARIATION_CHECKS), "variation"))
def _(spark, sf):
    found = d.variation_problems(cases(spark, sf), t.metrics(spark, sf), t.logs(spark, sf))
    return _flat(q.report(found, d.VARIATION_CHECKS))


def _verdict(*suites: str) -> str:
    rows = " UNION ALL ".join(f"SELECT ok FROM ({suite})" for suite in suites)
    return f"SELECT bool_and(ok) AS ok, count(*) FILTER (ok) AS passed, count(*) AS total FROM ({rows})"


@query("dataset_verdict", "A19 D32 D34", sql(_verdict(
    _suite(ingest._LOG_FOUND, q.LOG_CHECKS), _suite(ingest._METRIC_FOUND, q.METRIC_CHECKS),
    _suite(ingest._CASE_FOUND, q.CASE_CHECKS),
    _suite(" UNION ALL ".join(f"SELECT {literal(n)} AS name, incident_id AS problem FROM signature_rows WHERE {test}"
                              for n, test in _SIGNATURES.items()), d.SIGNATURE_CHECKS),
    _suite(" UNION ALL ".join(f"SELECT {literal(n)} AS name, scenario AS problem FROM variation WHERE {test}"
                              for n, test in _VARIATION.items()), d.VARIATION_CHECKS)),
    "raw_logs incidents metrics labels_of signature_rows variation"))
def _(spark, sf):
    """The whole check suite with one verdict: rows, cases, signatures and variation together."""
    names = ("log_row_checks", "metric_row_checks", "case_checks", "signature_checks", "variation_checks")
    reports = [REGISTRY[name].run(spark, sf) for name in names]
    return q.verdict(reduce(DataFrame.unionByName, reports))


block("impact", "case_metrics", """
SELECT incident_id, service, be, pe, bl, pl, coalesce(pe - be >= 1 OR (pl >= 2 * bl AND pl - bl > 50), false) AS affected FROM (
  SELECT incident_id, service, median(error_rate) FILTER (in_base) AS be, max(error_rate) FILTER (in_alert) AS pe,
    median(latency_ms) FILTER (in_base) AS bl, max(latency_ms) FILTER (in_alert) AS pl
  FROM case_metrics WHERE in_base OR in_alert GROUP BY ALL)""")


@query("service_impact", "D36", sql("""
SELECT incident_id, service, round(be, 6) AS base_error_rate, pe AS peak_error_rate, round(bl, 6) AS base_latency_ms,
  pl AS peak_latency_ms, affected FROM impact""", "impact"))
def _(spark, sf):
    out = f.service_impact(t.metrics(spark, sf), cases(spark, sf), BEFORE)
    return rounded(out, "base_error_rate", "base_latency_ms")


@query("impact_severity", "D37", sql("""
SELECT incident_id, round(rise, 6) AS error_rise, round(ratio, 6) AS latency_ratio,
  CASE WHEN rise >= 25 OR (rise >= 15 AND mins >= 40) THEN 'CRITICAL' WHEN rise >= 8 OR (rise >= 5 AND mins >= 45) THEN 'HIGH'
       WHEN rise >= 2.5 OR ratio >= 6 THEN 'MEDIUM' ELSE 'LOW' END AS impact_severity
FROM (SELECT i.incident_id, c.duration_minutes AS mins,
    max(pe - be) FILTER (i.service = c.service OR i.service = 'api-gateway' OR i.service = c.root_cause_service) AS rise,
    max(pl / nullif(bl, 0)) FILTER (i.service = c.service) AS ratio
  FROM impact i JOIN cases c ON c.incident_id = i.incident_id GROUP BY ALL)""", "impact cases"))
def _(spark, sf):
    table = cases(spark, sf)
    out = f.impact_severity(f.service_impact(t.metrics(spark, sf), table, BEFORE), table)
    return rounded(out, "error_rise", "latency_ratio")


_SERIES_SQL = """
SELECT metric_name AS incident_id, metric_name AS service, 'latency_ms' AS metric_name, timestamp, value FROM (
  SELECT event_type AS metric_name, date_trunc('hour', ts) AS timestamp, round(sum(value), 2) AS value FROM events GROUP BY ALL)"""
block("hourly", "", _SERIES_SQL)
block("hourly_rows", "hourly rules", "SELECT s.*, r.* EXCLUDE (metric_name), row_number() OVER (PARTITION BY incident_id "
                                     "ORDER BY timestamp) AS i FROM hourly s JOIN rules r ON r.metric_name = s.metric_name")
block("hourly_fold", "hourly_rows", fold().replace("fold f JOIN series_rows", "hourly_fold f JOIN hourly_rows").replace(
    "FROM series_rows", "FROM hourly_rows"))


@query("long_series_detector", "E5", sql("""
SELECT incident_id, timestamp, value, detection_method, severity, round(z_score, 6) AS z_score FROM hourly_fold
WHERE detection_method IS NOT NULL""", "hourly_fold"))
def _(spark, sf):
    """A month-long hourly series per event type, its weeks walked at once."""
    hour = F.col("ts").cast("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour("ts"))
    hourly = t.read(spark, sf, "events").groupBy(F.col("event_type").alias("incident_id"), hour.alias("timestamp")).agg(
        F.round(F.sum("value"), 2).alias("value")).select(
        "incident_id", F.col("incident_id").alias("service"), F.lit("latency_ms").alias("metric_name"), "timestamp", "value")
    out = detect(hourly, DetectorSettings(), rows_per_block=7 * 24)
    return out.select("incident_id", "timestamp", "value", "detection_method", "severity", F.round("z_score", 6).alias("z_score"))


@query("windows_at_wider_gap", "E7 D4", sql("""
SELECT incident_id, no AS window_no, min(timestamp) AS start_time, max(timestamp) AS end_time, count(*) AS anomaly_count FROM (
  SELECT *, sum(opens) OVER (PARTITION BY incident_id ORDER BY timestamp, service, metric_name)::BIGINT AS no FROM (
    SELECT *, CASE WHEN timestamp <= lag(timestamp) OVER (PARTITION BY incident_id ORDER BY timestamp, service, metric_name)
      + INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS opens FROM points)) GROUP BY ALL""", "points"))
def _(spark, sf):
    return anomaly_windows(t.points(spark, sf), 30).select(
        "incident_id", "window_no", "start_time", "end_time", "anomaly_count")

