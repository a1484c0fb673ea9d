"""Queries on evidence selection, collapsing, ids, links and the timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from pyrewatch import schemas as S
from pyrewatch.functions.events import evidence_type, is_change, is_rare, is_relevant
from pyrewatch.functions.text import template_of
from pyrewatch.functions.times import iso_text
from pyrewatch.operators import correlate as c
from pyrewatch.operators import timelines as tl
from pyrewatch.plans import tables as t
from pyrewatch.plans.duck import block, in_list, literal, matches, sql
from pyrewatch.plans.registry import query

RELEVANT = (f"(event_type IN {in_list(S.RARE_EVENTS)} OR (level IN ('WARN', 'ERROR') "
            f"AND event_type IN {in_list(S.RELEVANT_EVENTS)}))")
EVIDENCE_TYPE = f"""CASE WHEN event_type IN {in_list(S.DEPLOY_EVENTS)} THEN 'DEPLOYMENT_EVENT'
WHEN event_type IN {in_list(S.RESTART_EVENTS)} THEN 'RESTART_EVENT'
WHEN event_type IN {in_list(S.CHANGE_ONLY_EVENTS)} THEN 'CHANGE_EVENT'
WHEN event_type IN {in_list(S.TIMEOUT_EVENTS)} THEN 'TIMEOUT_EVENT'
WHEN event_type IN {in_list(S.HEALTH_EVENTS)} THEN 'HEALTH_EVENT'
WHEN event_type IN {in_list(S.ERROR_EVENTS)} OR level = 'ERROR' THEN 'ERROR_EVENT' ELSE 'LOG_EVENT' END"""


def iso(ts: str) -> str:
    return (f"CASE WHEN microsecond({ts}) % 1000000 = 0 THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S') "
            f"ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') END")


def squeezed(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def clipped(text: str, limit: int) -> str:
    flat = squeezed(text)
    return f"CASE WHEN length({flat}) > {limit} THEN {flat}[1:{limit - 3}] || '...' ELSE {flat} END"


block("spans", "incidents", """
SELECT *, greatest(start_time - INTERVAL '30' MINUTE, window_start) AS inv_start,
       least(end_time + INTERVAL '10' MINUTE, window_end) AS inv_end,
       greatest(start_time - INTERVAL '90' MINUTE, window_start) AS chg_start FROM incidents""")
block("picked_windows", "windows spans", """
SELECT w.* FROM windows w JOIN spans s ON s.incident_id = w.incident_id
AND w.start_time <= s.inv_end AND w.end_time >= s.inv_start""")
block("picked_points", "points spans", """
SELECT p.* FROM points p JOIN spans s ON s.incident_id = p.incident_id AND p.timestamp BETWEEN s.inv_start AND s.inv_end""")
block("flagged_logs", "logs spans picked_windows", f"""
SELECT l.*, s.service AS alerting, l.timestamp BETWEEN s.inv_start AND s.inv_end AS in_span,
  l.timestamp BETWEEN s.chg_start AND s.inv_end AS in_change_span,
  EXISTS (SELECT 1 FROM picked_windows w WHERE w.incident_id = l.incident_id AND l.timestamp BETWEEN
          w.start_time - INTERVAL '5' MINUTE AND w.end_time + INTERVAL '5' MINUTE) AS near_window,
  NOT EXISTS (SELECT 1 FROM picked_windows w WHERE w.incident_id = l.incident_id)
    OR EXISTS (SELECT 1 FROM picked_windows w WHERE w.incident_id = l.incident_id
               AND list_contains(w.affected_services, l.service)) OR l.service = s.service AS on_service
FROM logs l JOIN spans s ON s.incident_id = l.incident_id""")
block("picked_logs", "flagged_logs", f"""
SELECT * FROM flagged_logs WHERE {RELEVANT} AND (
  (event_type IN {in_list(S.CHANGE_EVENTS)} AND in_change_span) OR (event_type IN {in_list(S.RARE_EVENTS)} AND in_span)
  OR near_window OR (in_span AND on_service))""")
block("collapsed", "picked_logs", f"""
SELECT incident_id, service, event_type, timestamp, level, message, seq, 1::BIGINT AS occurrence_count,
       NULL::TIMESTAMP AS last_timestamp, false AS collapsed
FROM picked_logs WHERE event_type NOT IN {in_list(S.COLLAPSED_EVENTS)}
UNION ALL
SELECT incident_id, service, event_type, timestamp, level, message, seq, n, CASE WHEN n > 1 THEN last_ts END, true
FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, service, event_type ORDER BY timestamp, message, seq) AS place,
        count(*) OVER (PARTITION BY incident_id, service, event_type) AS n,
        max(timestamp) OVER (PARTITION BY incident_id, service, event_type) AS last_ts
      FROM picked_logs WHERE event_type IN {in_list(S.COLLAPSED_EVENTS)}) g WHERE place = 1""")
block("log_items", "collapsed", f"""
SELECT incident_id, format('LOG-{{:06d}}', row_number() OVER (PARTITION BY incident_id
         ORDER BY timestamp, service, event_type, collapsed, seq)) AS evidence_id,
       timestamp, service, 'LOG' AS source_type, {EVIDENCE_TYPE} AS evidence_type,
       'Observed ' || level || ' ' || replace(event_type, '_', ' ') || ' on ' || service ||
         CASE WHEN occurrence_count > 1 THEN ' (' || occurrence_count || ' records, last at ' || {iso('last_timestamp')}
              || ')' ELSE '' END || ': ' || {clipped('message', 180)} AS summary,
       'log:' || service || ':' || {iso('timestamp')} || ':' || event_type AS source_reference,
       event_type, NULL::VARCHAR AS metric_name, level AS severity, occurrence_count, last_timestamp FROM collapsed""")
block("onsets", "picked_points picked_windows incidents", """
SELECT p.* FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, service, metric_name ORDER BY timestamp) AS place
                 FROM picked_points) p JOIN incidents i ON i.incident_id = p.incident_id
WHERE place = 1 AND (p.service = i.service OR p.severity = 'HIGH' OR EXISTS (
  SELECT 1 FROM picked_windows w WHERE w.incident_id = p.incident_id AND w.peak_service = p.service
  AND w.peak_metric = p.metric_name))""")
block("point_items", "onsets", f"""
SELECT incident_id, format('ANOM-{{:06d}}', row_number() OVER (PARTITION BY incident_id
         ORDER BY timestamp, service, metric_name)) AS evidence_id,
       timestamp, service, 'METRIC_ANOMALY' AS source_type, 'ANOMALY' AS evidence_type,
       'Observed ' || metric_name || '=' || printf('%.1f', value) || ' on ' || service || ' (' ||
       coalesce('|z|=' || printf('%.1f', abs(z_score)), 'z-score unavailable') || ', ' ||
       coalesce('baseline ' || printf('%.1f', baseline_mean), 'no baseline yet') || coalesce(', ' || direction, '') ||
       '; ' || detection_method || ')' AS summary,
       'anomaly:' || service || ':' || metric_name || ':' || {iso('timestamp')} AS source_reference,
       NULL::VARCHAR AS event_type, metric_name, severity, 1::BIGINT AS occurrence_count,
       NULL::TIMESTAMP AS last_timestamp FROM onsets""")
block("window_items", "picked_windows", f"""
SELECT incident_id, format('ANOMWIN-{{:06d}}', row_number() OVER (PARTITION BY incident_id ORDER BY start_time)) AS evidence_id,
       start_time AS timestamp, peak_service AS service, 'ANOMALY_WINDOW' AS source_type,
       'ANOMALY_WINDOW' AS evidence_type,
       'Observed anomaly window on ' || array_to_string(affected_services, ', ') || ' (' || anomaly_count ||
       ' points, peak ' || peak_service || ' ' || peak_metric || ' ' ||
       coalesce('|z|=' || printf('%.1f', abs(peak_z_score)), 'no z-score') || ', ' ||
       printf('%.1f', duration_minutes) || ' min)' AS summary,
       'anomaly_window:' || {iso('start_time')} || ':' || {iso('end_time')} || ':' || peak_service || ':' || peak_metric
         AS source_reference,
       NULL::VARCHAR AS event_type, peak_metric AS metric_name, severity, anomaly_count AS occurrence_count,
       end_time AS last_timestamp FROM picked_windows""")
block("evidence", "log_items point_items window_items",
      "SELECT * FROM log_items UNION ALL SELECT * FROM point_items UNION ALL SELECT * FROM window_items")
block("titled", "evidence", """
SELECT *, CASE source_type WHEN 'LOG' THEN 0 WHEN 'METRIC_ANOMALY' THEN 1 ELSE 2 END AS source_rank,
  CASE WHEN evidence_type = 'ANOMALY_WINDOW' THEN 'anomaly window (' || metric_name || ') on ' || service
       WHEN evidence_type = 'ANOMALY' THEN metric_name || ' anomaly on ' || service
       ELSE replace(event_type, '_', ' ') || ' on ' || service ||
            CASE WHEN occurrence_count > 1 THEN ' x' || occurrence_count ELSE '' END END AS title
FROM evidence""")
block("timeline", "titled", """
SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY timestamp, source_rank, service, evidence_id) AS position
FROM titled""")


def evidence(spark, sf):
    points = t.points(spark, sf)
    return c.correlate(t.reached_logs(spark, sf), t.incidents(spark, sf), points, t.windows_of(points))


def selected(spark, sf):
    incidents = c.cut_lineage(t.incidents(spark, sf))
    picked = c.cut_lineage(c.select_windows(t.windows(spark, sf), incidents))
    return c.select_logs(t.reached_logs(spark, sf), incidents, picked)


@query("log_levels", "B1", sql("""
SELECT raw_level, level, count(*) AS lines FROM leveled_logs GROUP BY raw_level, level""", "leveled_logs"))
def _(spark, sf):
    raw = t.raw_logs(spark, sf)
    return raw.groupBy("raw_level", t.normalize_level(F.col("raw_level")).alias("level")).agg(F.count("*").alias("lines"))


@query("event_types", "B2 B3", sql("SELECT seq, level, event_type FROM logs", "logs"))
def _(spark, sf):
    return t.logs(spark, sf).select("seq", "level", "event_type")


@query("log_templates", "B4", sql(f"""
SELECT incident_id, regexp_replace(regexp_replace(message, {literal(t.HEX_RUN)}, '#', 'g'), {literal(t.NUMBER_RUN)}, '#', 'g')
       AS template, count(*) AS lines FROM logs GROUP BY ALL""", "logs"))
def _(spark, sf):
    logs = t.logs(spark, sf)
    return logs.groupBy("incident_id", template_of(F.col("message")).alias("template")).agg(F.count("*").alias("lines"))


@query("log_roles", "B5 B6", sql(f"""
SELECT level, event_type, event_type IN {in_list(S.CHANGE_EVENTS)} AS is_change, event_type IN {in_list(S.RARE_EVENTS)} AS is_rare,
       {RELEVANT} AS is_relevant, {EVIDENCE_TYPE} AS evidence_type, count(*) AS lines FROM logs GROUP BY ALL""", "logs"))
def _(spark, sf):
    event, level = F.col("event_type"), F.col("level")
    counts = t.logs(spark, sf).groupBy("level", "event_type").agg(F.count("*").alias("lines"))
    return counts.withColumns({
        "is_change": is_change(event), "is_rare": is_rare(event), "is_relevant": is_relevant(event, level),
        "evidence_type": evidence_type(event, level),
    })


@query("investigation_spans", "B7", sql("SELECT incident_id, inv_start, inv_end, chg_start FROM spans", "spans"))
def _(spark, sf):
    return c.with_spans(t.incidents(spark, sf)).select(
        "incident_id", F.col("investigation_start").alias("inv_start"), F.col("investigation_end").alias("inv_end"),
        F.col("change_start").alias("chg_start"))


@query("selected_windows", "B8 B9", sql("""
SELECT incident_id, window_no, start_time, end_time FROM picked_windows""", "picked_windows"))
def _(spark, sf):
    return c.select_windows(t.windows(spark, sf), t.incidents(spark, sf)).select(
        "incident_id", "window_no", "start_time", "end_time")


@query("selected_points", "B8 B10", sql("""
SELECT incident_id, timestamp, service, metric_name, detection_method FROM picked_points""", "picked_points"))
def _(spark, sf):
    return c.select_points(t.points(spark, sf), t.incidents(spark, sf)).select(
        "incident_id", "timestamp", "service", "metric_name", "detection_method")


@query("selected_logs", "B11", sql("SELECT seq, incident_id, service, event_type, level FROM picked_logs", "picked_logs"))
def _(spark, sf):
    return selected(spark, sf).select("seq", "incident_id", "service", "event_type", "level")


@query("logs_near_windows", "B8 C1", sql("""
SELECT seq, incident_id, timestamp FROM logs l WHERE EXISTS (
  SELECT 1 FROM windows w WHERE w.incident_id = l.incident_id
  AND l.timestamp BETWEEN w.start_time - INTERVAL '5' MINUTE AND w.end_time + INTERVAL '5' MINUTE)""", "logs windows"))
def _(spark, sf):
    near = c.with_near_window(t.logs(spark, sf), t.windows(spark, sf))
    return near.where("near_window").select("seq", "incident_id", "timestamp")


@query("collapsed_logs", "D5", sql("""
SELECT incident_id, service, event_type, timestamp, level, message, seq, occurrence_count, last_timestamp FROM collapsed""",
                                   "collapsed"))
def _(spark, sf):
    return c.collapse_logs(selected(spark, sf)).drop("collapsed")


@query("first_points", "D6", sql("""
SELECT incident_id, service, metric_name, timestamp, severity FROM (SELECT *, row_number() OVER (
  PARTITION BY incident_id, service, metric_name ORDER BY timestamp) AS place FROM points) WHERE place = 1""", "points"))
def _(spark, sf):
    return c.first_points(t.points(spark, sf)).select("incident_id", "service", "metric_name", "timestamp", "severity")


@query("notable_onsets", "D7", sql("""
SELECT incident_id, service, metric_name, timestamp, severity FROM onsets""", "onsets"))
def _(spark, sf):
    incidents, points = t.incidents(spark, sf), t.points(spark, sf)
    picked = c.select_windows(t.windows_of(points), incidents)
    return c.notable_onsets(c.select_points(points, incidents), incidents, picked).select(
        "incident_id", "service", "metric_name", "timestamp", "severity")


@query("evidence_items", "E8 F5 G2", sql("SELECT * FROM evidence", "evidence"))
def _(spark, sf):
    return evidence(spark, sf)


@query("window_links", "C2", sql("""
SELECT w.incident_id, w.evidence_id AS window_id, l.evidence_id FROM window_items w JOIN log_items l
ON l.incident_id = w.incident_id AND l.timestamp <= w.last_timestamp + INTERVAL '5' MINUTE
AND coalesce(l.last_timestamp, l.timestamp) >= w.timestamp - INTERVAL '5' MINUTE""", "window_items log_items"))
def _(spark, sf):
    return c.window_links(evidence(spark, sf))


@query("related_evidence", "C2", sql("""
SELECT w.incident_id, w.evidence_id, coalesce((SELECT string_agg(l.evidence_id, '|' ORDER BY l.evidence_id) FROM log_items l
  WHERE l.incident_id = w.incident_id AND l.timestamp <= w.last_timestamp + INTERVAL '5' MINUTE
  AND coalesce(l.last_timestamp, l.timestamp) >= w.timestamp - INTERVAL '5' MINUTE), '') AS related
FROM window_items w""", "window_items log_items"))
def _(spark, sf):
    found = evidence(spark, sf)
    related = c.with_related(found, c.window_links(found))
    return related.where("source_type = 'ANOMALY_WINDOW'").select(
        "incident_id", "evidence_id", F.array_join("related_evidence_ids", "|").alias("related"))


@query("timeline_events", "F1 G3", sql("""
SELECT incident_id, position, timestamp, title, summary AS description, service, source_type, evidence_id, severity
FROM timeline""", "timeline"))
def _(spark, sf):
    return c.timeline(evidence(spark, sf))


@query("timeline_titles", "C12", sql("""
SELECT incident_id, evidence_id, coalesce(CASE WHEN position % 3 > 0 THEN title END, summary) AS title FROM timeline""", "timeline"))
def _(spark, sf):
    found = evidence(spark, sf)
    events = c.timeline(found).where("position % 3 > 0")
    return tl.with_titles(found, events).select("incident_id", "evidence_id", "title")


@query("timeline_summary", "D15", sql(f"""
SELECT i.incident_id, i.service AS alerting_service, count(e.evidence_id) AS events,
  coalesce(string_agg(DISTINCT e.service, '|' ORDER BY e.service), '') AS involved_services,
  max(CASE WHEN position = 1 THEN e.evidence_id END) AS first_event_id,
  max(CASE WHEN source_type = 'LOG' AND place = 1 THEN e.evidence_id END) AS first_log_id,
  max(CASE WHEN source_type <> 'LOG' AND place = 1 THEN e.evidence_id END) AS first_anomaly_id,
  max(CASE WHEN source_type <> 'LOG' AND place = 1 THEN e.timestamp END) AS first_anomaly_at,
  max(CASE WHEN source_type <> 'LOG' AND place = 1 THEN e.title END) AS first_anomaly_title
FROM incidents i LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY incident_id, source_type = 'LOG' ORDER BY position)
  AS place FROM timeline) e ON e.incident_id = i.incident_id GROUP BY i.incident_id, i.service""", "incidents timeline"))
def _(spark, sf):
    out = c.timeline_summary(evidence(spark, sf), t.incidents(spark, sf))
    return out.select(
        "incident_id", "alerting_service", "events", F.array_join("involved_services", "|").alias("involved_services"),
        F.col("first_event.evidence_id").alias("first_event_id"), F.col("first_log.evidence_id").alias("first_log_id"),
        F.col("first_anomaly.evidence_id").alias("first_anomaly_id"),
        F.col("first_anomaly.timestamp").alias("first_anomaly_at"),
        F.col("first_anomaly.title").alias("first_anomaly_title"))


@query("timeline_totals", "D14", sql("""
SELECT 'all' AS scope, 'items' AS name, count(*) AS items, count(DISTINCT incident_id) AS incidents,
       round(count(*) / (SELECT count(*) FROM incidents), 6) AS per_incident FROM evidence
UNION ALL SELECT 'source', source_type, count(*), count(DISTINCT incident_id),
       round(count(*) / (SELECT count(*) FROM incidents), 6) FROM evidence GROUP BY source_type
UNION ALL SELECT 'service', service, count(*), count(DISTINCT incident_id),
       round(count(*) / (SELECT count(*) FROM incidents), 6) FROM evidence GROUP BY service
UNION ALL SELECT 'empty', incident_id, 0, 0, 0 FROM incidents WHERE incident_id NOT IN (SELECT incident_id FROM evidence)""",
                                "evidence incidents"))
def _(spark, sf):
    out = tl.totals(evidence(spark, sf), t.incidents(spark, sf))
    return out.withColumn("per_incident", F.round("per_incident", 6))


@query("timeline_with_boundaries", "F7 G6", sql(f"""
SELECT incident_id, id, label, timestamp, category, row_number() OVER (PARTITION BY incident_id
       ORDER BY timestamp, side, source_rank, service, id) AS position
FROM (SELECT incident_id, evidence_id AS id, title AS label, timestamp, 1 AS side, source_rank, service,
        CASE WHEN source_type = 'ANOMALY_WINDOW' THEN 'window' WHEN source_type = 'METRIC_ANOMALY' THEN 'anomaly'
             WHEN evidence_type IN ('DEPLOYMENT_EVENT', 'CHANGE_EVENT', 'RESTART_EVENT') THEN 'change' ELSE 'log' END AS category
      FROM titled
      UNION ALL SELECT incident_id, 'alert-start', 'Alert start', start_time, 0, 0, '', 'boundary' FROM incidents
      UNION ALL SELECT incident_id, 'alert-end', 'Alert end', end_time, 2, 0, '', 'boundary' FROM incidents)""",
                                         "titled incidents"))
def _(spark, sf):
    return tl.with_boundaries(evidence(spark, sf), t.incidents(spark, sf))


@query("iso_times", "G9", sql(f"""
SELECT incident_id, {iso('start_time')} AS start_text, {iso('window_start')} AS window_text FROM incidents""", "incidents"))
def _(spark, sf):
    return t.incidents(spark, sf).select(
        "incident_id", iso_text(F.col("start_time")).alias("start_text"), iso_text(F.col("window_start")).alias("window_text"))
