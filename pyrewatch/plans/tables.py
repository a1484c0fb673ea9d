"""Incident-shaped inputs taken from the test tables, as one text for Spark and for the comparison SQL.

``events`` becomes logs, ten-minute metrics and one incident per day; see the README for the mapping. The same
text runs on both sides, so a difference in a result comes from an operator and not from its input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pyrewatch.functions.evaluate import once
from pyrewatch.functions.text import HEX_RUN, NUMBER_RUN, normalize_level  # noqa: F401  (shared with query modules)
from pyrewatch.functions.times import minutes_between
from pyrewatch.operators.detector import flag_with_feedback
from pyrewatch.operators.series import long_series
from pyrewatch.operators.windows import anomaly_windows
from pyrewatch.session import cut_lineage
from pyrewatch.sources import logs as log_source

INCIDENT_ID = "concat('INC-', year(ts) * 10000 + month(ts) * 100 + day(ts))"
DAY = "cast(cast(ts as date) as {ntz})"

BASE = f"""
SELECT event_id, ts, user_id, event_type, value, {{k}} AS k, {INCIDENT_ID} AS incident_id, {DAY} AS day_start,
       concat('svc-', user_id % 6) AS service
FROM {{events}}
"""

# What a line of each event type says; {k} comes from the event's properties.
MESSAGE = """
CASE event_type
WHEN 'error' THEN CASE k % 10
  WHEN 0 THEN concat('database connection timeout after ', k, '0 ms')
  WHEN 1 THEN concat('payments did not respond within ', k, ' ms')
  WHEN 2 THEN concat('container OOMKilled, rss=', k, '12345')
  WHEN 3 THEN concat('Unhandled exception in handler ', k, ' due to bad input')
  WHEN 4 THEN concat('request failed path=/orders/', event_id, ' status=500')
  WHEN 5 THEN concat('health check failed: db ping ', k, ' ms')
  WHEN 6 THEN concat('upstream error 503 from inventory-', k)
  WHEN 7 THEN concat('circuit breaker opened for orders-', k)
  WHEN 8 THEN concat('batch write timed out after ', k, 's token=ab12cd', event_id)
  ELSE concat('order rejected with code ', k) END
WHEN 'click' THEN CASE k % 8
  WHEN 0 THEN concat('retrying call to svc-', k)
  WHEN 1 THEN concat('slow request path=/cart took ', k, ' ms')
  WHEN 2 THEN concat('connection checkout took ', k, ' ms')
  WHEN 3 THEN concat('event loop lag ', k, 'ms')
  WHEN 4 THEN concat('rate limit exceeded for client ', user_id)
  WHEN 5 THEN concat('heap used ', k, '% of limit')
  WHEN 6 THEN concat('call took ', k, 'ms, exceeding budget')
  ELSE concat('calling deprecated endpoint /v1/', k) END
WHEN 'view' THEN CASE k % 7
  WHEN 0 THEN concat('GET /healthz ', CASE WHEN k > 50 THEN '200' ELSE '503' END)
  WHEN 1 THEN concat('"GET /items/', k, ' HTTP/1.1" ', CASE WHEN k > 50 THEN '404' ELSE '200' END, ' upstream=web-1')
  WHEN 2 THEN concat('request completed method=GET path=/v/', k, ' status=200 slow=true')
  WHEN 3 THEN concat('Completed GET /v/', event_id, ' 503 in 12ms')
  WHEN 4 THEN concat('cache hit ratio 0.', k)
  WHEN 5 THEN concat('cluster web: ', k, ' healthy hosts')
  ELSE concat('GET /recommendations/', k, ' 200 ', k, 'ms') END
WHEN 'signup' THEN CASE k % 9
  WHEN 0 THEN concat('rolling update started for build ', k)
  WHEN 1 THEN concat('feature flag ', k, ' set to 10% rollout')
  WHEN 2 THEN 'configuration reloaded'
  WHEN 3 THEN concat('job nightly-', k, ' started')
  WHEN 4 THEN concat('duration: 1.', k, ' ms  statement: select 1')
  WHEN 5 THEN concat('scaled from ', k, ' to ', k + 1, ' replicas')
  WHEN 6 THEN concat('rolling update complete for build ', k)
  WHEN 7 THEN concat('memory leak suspected in pool ', k)
  ELSE concat('token for client ', user_id, ' expires soon') END
ELSE CASE k % 5
  WHEN 0 THEN concat('order ', event_id, ' created')
  WHEN 1 THEN concat('Payment p', event_id, ' captured')
  WHEN 2 THEN concat('db pool stats open=', k)
  WHEN 3 THEN concat('starting, GOMAXPROCS=', k)
  ELSE concat('GC pause ', k, 'ms') END
END
"""

RAW_LEVEL = """
CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN CASE WHEN k < 50 THEN ' warning ' ELSE 'Warn' END
WHEN 'view' THEN 'info' WHEN 'signup' THEN CASE WHEN k < 30 THEN 'warn' ELSE 'INFO' END
ELSE CASE WHEN k >= 90 THEN 'debug' ELSE 'Info' END END
"""

# Raw lines with their level as written; `debug` lines are not valid log events.
RAW_LOGS = f"""
SELECT event_id AS seq, ts AS timestamp, incident_id, service, concat('host-', user_id) AS host,
       {RAW_LEVEL} AS raw_level, concat('app.', event_type) AS logger, {MESSAGE} AS message,
       CASE WHEN k >= 10 THEN concat('t', event_id) END AS trace_id, k, value
FROM ({BASE}) base
"""


def _percent(amount: str) -> str:
    """An amount from 0 up as a share of 100, larger for larger amounts, with two digits."""
    return f"floor(10000e0 * {amount} / (10e0 + {amount}) + 0.5e0) / 100e0"


METRICS = f"""
SELECT incident_id, service,
       day_start + (hour(ts) * 60 + minute(ts) - minute(ts) % 10) * INTERVAL '1' MINUTE AS timestamp,
       {_percent("min(value)")} AS cpu_usage,
       {_percent("(round(sum(value), 2) / 10)")} AS memory_usage,
       cast(count(*) AS double) AS request_rate,
       max(value) AS latency_ms,
       100e0 * sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / count(*) AS error_rate,
       {_percent("max(CASE WHEN event_type = 'purchase' THEN value END)")} AS db_connection_utilization,
       max(CASE WHEN event_type = 'view' THEN value END) AS downstream_latency_ms
FROM ({BASE}) base
GROUP BY incident_id, service, day_start + (hour(ts) * 60 + minute(ts) - minute(ts) % 10) * INTERVAL '1' MINUTE
"""

# One incident per day: the alert starts at that day's largest error value.
INCIDENTS = f"""
SELECT incident_id, concat(service, ' error burst') AS title, service,
       CASE WHEN value >= 250 THEN 'CRITICAL' WHEN value >= 200 THEN 'HIGH' WHEN value >= 150 THEN 'MEDIUM'
            ELSE 'LOW' END AS severity,
       ts AS start_time,
       least(ts + (20 + k) * INTERVAL '1' MINUTE, day_start + INTERVAL '1' DAY) AS end_time,
       day_start AS window_start, day_start + INTERVAL '1' DAY AS window_end,
       concat('Errors  peaked on ', service, CASE WHEN k > 50 THEN ' and checkout timing out' ELSE '' END)
         AS description, k, value
FROM ({{peaks}}) peaks
"""

LABELS = """
SELECT incident_id,
       CASE kind WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'DB_CONNECTION_POOL_EXHAUSTION' WHEN 2 THEN 'MEMORY_LEAK'
            ELSE 'DOWNSTREAM_SERVICE_TIMEOUT' END AS scenario,
       CASE WHEN kind > 0 THEN greatest(start_time - INTERVAL '25' MINUTE, window_start) END AS fault_start_time,
       CASE kind WHEN 0 THEN NULL WHEN 3 THEN concat('svc-', k % 6) ELSE service END AS root_cause_service,
       CASE WHEN kind > 0 THEN concat('variant-', k % 3) END AS root_cause_variant
FROM (SELECT incident_id, start_time, window_start, service, k, day(window_start) % 4 AS kind FROM {incidents}) i
"""

# The peak error of each day: an aggregate on Spark, a ranking in the comparison SQL.
_SPARK_PEAKS = f"""
SELECT peak.* FROM (
  SELECT max_by(struct(base.*), struct(value, -event_id)) AS peak FROM ({BASE}) base
  WHERE event_type = 'error' GROUP BY incident_id)
"""
_DUCK_PEAKS = f"""
SELECT * FROM (
  SELECT base.*, row_number() OVER (PARTITION BY incident_id ORDER BY value DESC, event_id) AS place
  FROM ({BASE}) base WHERE event_type = 'error') WHERE place = 1
"""
_SPARK_NAMES = {
    "peaks": _SPARK_PEAKS, "ntz": "timestamp_ntz", "k": "cast(get_json_object(props, '$.k') AS int)",
}
_DUCK_NAMES = {
    "peaks": _DUCK_PEAKS, "ntz": "timestamp", "k": "cast(json_extract_string(props, '$.k') AS int)",
}


def duck(text: str) -> str:
    for key, value in {**_DUCK_NAMES, "events": "events", "incidents": "incidents"}.items():
        text = text.replace("{" + key + "}", value)
    return text


def _spark(text: str) -> str:
    for key, value in _SPARK_NAMES.items():
        text = text.replace("{" + key + "}", value)
    return text


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def raw_logs(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    rows = spark.sql(_spark(RAW_LOGS), events=read(spark, sf_dir, "events") if events is None else events)
    return once(rows, "message", F.col("message"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid log events: level normalized, event type added."""
    return log_source.typed_logs(raw_logs(spark, sf_dir))


def untyped_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid log events whose type is still to be told."""
    return log_source.leveled_logs(raw_logs(spark, sf_dir))


def reached_logs(spark: SparkSession, sf_dir: str) -> Callable[[DataFrame], DataFrame]:
    """``untyped_logs`` as a function of the reach of incidents; an event out of reach is left out before its line is made."""
    def lines(reach: DataFrame) -> DataFrame:
        events = read(spark, sf_dir, "events")
        own = reach.withColumnRenamed("incident_id", "_incident")
        near = events.withColumn("_incident", F.expr(INCIDENT_ID)).join(own, "_incident").where(
            F.col("ts").between(F.col("reach_from"), F.col("reach_to")))
        return log_source.leveled_logs(raw_logs(spark, sf_dir, near.select(*events.columns)))
    return lines


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_spark(METRICS), events=read(spark, sf_dir, "events"))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.sql(_spark(INCIDENTS), events=read(spark, sf_dir, "events"))
    return found.withColumn("duration_minutes", minutes_between(F.col("start_time"), F.col("end_time")))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_spark(LABELS), incidents=incidents(spark, sf_dir))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_series(metrics(spark, sf_dir))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly points of the default detector, as a written table: they are few, and windows alone read them twice."""
    return cut_lineage(flag_with_feedback(series(spark, sf_dir)))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows_of(points(spark, sf_dir))


def windows_of(found: DataFrame) -> DataFrame:
    return anomaly_windows(found)


# JSON lines as a collector might write them. Some property values carry a fault.
_QUOTED = "replace(message, '\"', concat(chr(92), '\"'))"
RAW_LINES = f"""
SELECT concat('logs/', incident_id, '-', service, '-', hour(timestamp), '.jsonl') AS path, seq AS line_no,
  CASE k WHEN 13 THEN '{{"timestamp": broken' WHEN 77 THEN '   ' WHEN 51 THEN '[1, 2]'
  ELSE concat('{{"timestamp":"', cast(timestamp AS {{text}}), CASE k WHEN 57 THEN '+02:00' ELSE '' END,
    '","service":"', service, '","host":"', CASE k WHEN 37 THEN '' ELSE host END,
    '","level":"', CASE k WHEN 29 THEN 'FATAL' ELSE raw_level END, '","logger":"', logger,
    '","message":"', {_QUOTED}, '","incident_id":"',
    CASE k WHEN 88 THEN 'INC-1' WHEN 91 THEN 'INC-999' ELSE incident_id END, '"',
    CASE WHEN k = 41 THEN '' WHEN trace_id IS NULL THEN ',"trace_id":null' ELSE concat(',"trace_id":"', trace_id, '"') END,
    CASE k WHEN 63 THEN ',"event_type":"retry"' WHEN 19 THEN ',"pod":"x"' ELSE '' END, '}}') END AS line, k, raw_level
FROM ({RAW_LOGS}) raw_logs_for_lines
"""

# Metric cells as text, ten-minute rows of one file per (incident, service); some cells are faulty.
RAW_CELLS = f"""
SELECT concat('metrics/', incident_id, '-', service, '.csv') AS path,
  cast(2 + 2 * slot + copy AS bigint) AS row_no,
  CASE WHEN h = 9 AND service = 'svc-4' THEN 'yesterday' ELSE cast(timestamp AS {{text}}) END AS timestamp,
  incident_id, service,
  CASE WHEN h = 3 AND service = 'svc-1' THEN 'n/a' ELSE cast(cpu_usage AS {{text}}) END AS cpu_usage,
  CASE WHEN h = 5 AND service = 'svc-2' THEN '' ELSE cast(memory_usage AS {{text}}) END AS memory_usage,
  CASE WHEN h = 15 AND service = 'svc-1' THEN '-4' ELSE cast(request_rate AS {{text}}) END AS request_rate,
  CASE WHEN h = 11 AND service = 'svc-5' THEN 'nan' ELSE cast(latency_ms AS {{text}}) END AS latency_ms,
  CASE WHEN h = 7 AND service = 'svc-1' THEN '150' ELSE cast(error_rate AS {{text}}) END AS error_rate,
  coalesce(cast(db_connection_utilization AS {{text}}), '') AS db_connection_utilization,
  coalesce(cast(downstream_latency_ms AS {{text}}), '') AS downstream_latency_ms, h, copy
FROM (SELECT m.*, hour(timestamp) AS h, {{slot}} AS slot, 0 AS copy FROM ({METRICS}) m
      UNION ALL SELECT m.*, hour(timestamp) AS h, {{slot}} AS slot, 1 AS copy FROM ({METRICS}) m
      WHERE hour(timestamp) = 13 AND service = 'svc-0') rows
"""
_SLOT = "cast((hour(timestamp) * 60 + minute(timestamp)) / 10 AS int)"
_DUCK_NAMES |= {"text": "varchar", "slot": _SLOT}
_SPARK_NAMES |= {"text": "string", "slot": _SLOT}


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.sql(_escaped(_spark(RAW_LINES)), events=read(spark, sf_dir, "events"))
    return once(lines, "line", F.col("line"))


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_escaped(_spark(RAW_CELLS)), events=read(spark, sf_dir, "events"))


def _escaped(text: str) -> str:
    """Keep literal braces from being read as parameters."""
    return text.replace("{", "{{").replace("}", "}}").replace("{{events}}", "{events}")
