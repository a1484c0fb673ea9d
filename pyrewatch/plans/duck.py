"""Comparison SQL: named building blocks, joined into one WITH clause per query."""

from __future__ import annotations

from pyrewatch.config import DEFAULT_RULES
from pyrewatch.functions import events as E
from pyrewatch.plans import tables as t
from pyrewatch.schemas import METRICS


def literal(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def in_list(values) -> str:
    return "(" + ", ".join(literal(v) for v in values) + ")"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {literal(pattern)})"


def level_of(raw: str) -> str:
    up = f"upper(trim({raw}))"
    return f"CASE WHEN {up} IN ('WARNING', 'WARN') THEN 'WARN' WHEN {up} IN ('INFO', 'ERROR') THEN {up} END"


def event_type_of(message: str, level: str) -> str:
    parts = [f"WHEN {matches(message, E.HEALTH_PROBE)} THEN CASE WHEN "
             f"regexp_extract({message}, {literal(E.HEALTH_PROBE)}, 1) LIKE '2%' "
             f"THEN 'health_check_passed' ELSE 'health_check_failed' END"]
    for shape in E.STATUS_SHAPES:
        status = f"cast(regexp_extract({message}, {literal(shape)}, 1) AS int)"
        parts.append(f"WHEN {matches(message, shape)} THEN CASE WHEN {status} >= 500 THEN 'request_failed' "
                     f"WHEN {status} >= 400 THEN 'request_client_error' "
                     f"WHEN contains({message}, 'slow=true') THEN 'slow_request' ELSE 'request_completed' END")
    parts.append(f"WHEN {matches(message, E.STATEMENT_DURATION)} THEN CASE WHEN upper(trim({level})) LIKE 'WARN%' "
                 f"THEN 'slow_db_query' ELSE 'db_query' END")
    parts += [f"WHEN {matches(message, pattern)} THEN {literal(name)}" for name, pattern in E.MESSAGE_RULES]
    return "CASE " + " ".join(parts) + " ELSE 'unknown' END"


def _rules() -> str:
    rows = [
        f"({literal(n)}, {r.min_std!r}::DOUBLE, {r.abs_floor!r}::DOUBLE, {r.rel_floor!r}::DOUBLE, "
        f"{'NULL' if r.ceiling is None else repr(r.ceiling)}::DOUBLE)" for n, r in DEFAULT_RULES.items()
    ]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) v(metric_name, min_std, abs_floor, rel_floor, ceiling)"


def scored(source: str, extra: str = "") -> str:
    """Scores of rows that carry both baselines (rm, rs, rn and lm, ls, ln) and the metric's limits."""
    return f"""
SELECT incident_id, timestamp, service, metric_name, value, {extra}
       CASE WHEN use_lag THEN lm ELSE rm END AS baseline_mean, CASE WHEN use_lag THEN ls ELSE rs END AS baseline_std,
       coalesce(CASE WHEN use_lag THEN ln ELSE rn END, 0) AS baseline_points,
       CASE WHEN use_lag THEN lz ELSE rz END AS z_score,
       value - CASE WHEN use_lag THEN lm ELSE rm END AS deviation,
       CASE WHEN value - CASE WHEN use_lag THEN lm ELSE rm END >= 0 THEN 'up'
            WHEN value - CASE WHEN use_lag THEN lm ELSE rm END < 0 THEN 'down' END AS direction,
       CASE WHEN rfire THEN 'rolling_zscore' WHEN lfire THEN 'drift_zscore' WHEN above THEN 'absolute_threshold'
            END AS detection_method,
       CASE WHEN (rfire OR lfire) AND abs(CASE WHEN use_lag THEN lz ELSE rz END) >= 50 THEN 'HIGH'
            WHEN (rfire OR lfire) AND abs(CASE WHEN use_lag THEN lz ELSE rz END) >= 10 OR above THEN 'MEDIUM'
            WHEN rfire OR lfire THEN 'LOW' END AS severity,
       above AS absolute_threshold_exceeded
FROM (SELECT *, lfire AND NOT rfire AS use_lag FROM (
  SELECT *, coalesce(abs(rz) >= 3 AND abs(value - rm) >= greatest(abs_floor, rel_floor * abs(rm)), false) AS rfire,
         coalesce(abs(lz) >= 3 AND abs(value - lm) >= greatest(abs_floor, rel_floor * abs(lm)), false) AS lfire,
         coalesce(value >= ceiling, false) AS above
  FROM (SELECT *, (value - rm) / greatest(rs, min_std) AS rz, (value - lm) / greatest(ls, min_std) AS lz
        FROM {source}) z) f) u"""


def frames(lag: int = 30, source: str = "series_rows") -> str:
    """Baselines as plain row frames over all earlier observations."""
    def part(first: int, last: int, tag: str) -> str:
        over = (f"OVER (PARTITION BY incident_id, service, metric_name ORDER BY timestamp "
                f"ROWS BETWEEN {first} PRECEDING AND {last} PRECEDING)")
        ready = f"count(value) {over} >= 10"
        return (f"CASE WHEN {ready} THEN avg(value) {over} END AS {tag}m, "
                f"CASE WHEN {ready} THEN stddev_samp(value) {over} END AS {tag}s, "
                f"CASE WHEN {ready} THEN count(value) {over} END AS {tag}n")
    lagged = part(lag + 15, lag + 1, "l") if lag else "NULL::DOUBLE AS lm, NULL::DOUBLE AS ls, NULL::BIGINT AS ln"
    return f"SELECT s.*, {part(15, 1, 'r')}, {lagged} FROM {source} s"


def fold(lag: int = 30) -> str:
    """The detector with feedback, one step per position and all series at once, state kept in a list."""
    last = f"hist[greatest(1, len(hist) - {lag + 14}):len(hist) - {lag}]"
    lagged = f"CASE WHEN len(hist) > {lag} THEN {last} ELSE [] END" if lag else "[]::DOUBLE[]"
    step = f"""(
  SELECT q.*, CASE WHEN len(r) >= 10 THEN list_avg(r) END AS rm, CASE WHEN len(r) >= 10 THEN list_stddev_samp(r) END AS rs,
         CASE WHEN len(r) >= 10 THEN len(r) END AS rn, CASE WHEN len(l) >= 10 THEN list_avg(l) END AS lm,
         CASE WHEN len(l) >= 10 THEN list_stddev_samp(l) END AS ls, CASE WHEN len(l) >= 10 THEN len(l) END AS ln
  FROM (SELECT s.*, f.hist, f.hist[-15:] AS r, {lagged} AS l FROM fold f JOIN series_rows s
        ON s.incident_id = f.incident_id AND s.service = f.service AND s.metric_name = f.metric_name
           AND s.i = f.i + 1) q) p"""
    columns = ("baseline_mean, baseline_std, baseline_points, z_score, deviation, direction, detection_method, "
               "severity, absolute_threshold_exceeded")
    return f"""
SELECT DISTINCT incident_id, service, metric_name, 0::BIGINT AS i, []::DOUBLE[] AS hist, NULL::TIMESTAMP AS timestamp,
       NULL::DOUBLE AS value, NULL::DOUBLE AS baseline_mean, NULL::DOUBLE AS baseline_std,
       NULL::BIGINT AS baseline_points, NULL::DOUBLE AS z_score, NULL::DOUBLE AS deviation,
       NULL::VARCHAR AS direction, NULL::VARCHAR AS detection_method, NULL::VARCHAR AS severity,
       NULL::BOOLEAN AS absolute_threshold_exceeded
FROM series_rows
UNION ALL
SELECT incident_id, service, metric_name, i,
       CASE WHEN detection_method IS NULL THEN list_append(hist, value)[-45:] ELSE hist END, timestamp, value, {columns}
FROM ({scored(step, "i, hist,")}) scored_step"""


_UNPIVOT = " UNION ALL ".join(
    f"SELECT incident_id, timestamp, service, '{m}' AS metric_name, {m} AS value FROM metrics WHERE {m} IS NOT NULL"
    for m in METRICS
)
SEVERITY_RANK = "CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 END"

# name -> (blocks it reads, text)
BLOCKS: dict[str, tuple[str, str]] = {
    "base": ("", t.duck(t.BASE)),
    "raw_logs": ("", t.duck(t.RAW_LOGS)),
    "leveled_logs": ("raw_logs", f"SELECT *, {level_of('raw_level')} AS level FROM raw_logs"),
    "logs": ("leveled_logs", f"SELECT *, {event_type_of('message', 'level')} AS event_type FROM leveled_logs "
                             f"WHERE level IS NOT NULL"),
    "metrics": ("", t.duck(t.METRICS)),
    "incidents": ("", f"SELECT *, date_diff('microsecond', start_time, end_time) / 6e7 AS duration_minutes "
                      f"FROM ({t.duck(t.INCIDENTS)})"),
    "labels_of": ("incidents", t.duck(t.LABELS)),
    "series": ("metrics", _UNPIVOT),
    "rules": ("", _rules()),
    "series_rows": ("series rules", "SELECT s.*, r.* EXCLUDE (metric_name), row_number() OVER (PARTITION BY "
                                    "incident_id, service, s.metric_name ORDER BY timestamp) AS i "
                                    "FROM series s JOIN rules r ON r.metric_name = s.metric_name"),
    "frames": ("series_rows", frames()),
    "plain_scores": ("frames", scored("frames")),
    "fold": ("series_rows", fold()),
    "points": ("fold", "SELECT * EXCLUDE (i, hist) FROM fold WHERE detection_method IS NOT NULL"),
    "numbered": ("points", """
SELECT *, sum(opens) OVER (PARTITION BY incident_id ORDER BY timestamp, service, metric_name) AS window_no
FROM (SELECT *, CASE WHEN timestamp <= lag(timestamp) OVER (PARTITION BY incident_id
      ORDER BY timestamp, service, metric_name) + INTERVAL '2' MINUTE THEN 0 ELSE 1 END AS opens FROM points) g"""),
    "ranked_points": ("numbered", f"""
SELECT *, row_number() OVER (PARTITION BY incident_id, window_no ORDER BY coalesce(abs(z_score), -1) DESC,
       {SEVERITY_RANK} DESC, timestamp, service, metric_name) AS place FROM numbered"""),
    "windows": ("ranked_points", f"""
SELECT incident_id, cast(window_no AS bigint) AS window_no, min(timestamp) AS start_time, max(timestamp) AS end_time,
       date_diff('microsecond', min(timestamp), max(timestamp)) / 6e7 AS duration_minutes,
       CASE max({SEVERITY_RANK}) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       count(*) AS anomaly_count, list_sort(list(DISTINCT service)) AS affected_services,
       list_sort(list(DISTINCT metric_name)) AS affected_metrics,
       list_sort(list(DISTINCT service || ':' || metric_name)) AS affected_series,
       list_sort(list(DISTINCT detection_method)) AS detection_methods,
       max(CASE WHEN place = 1 THEN z_score END) AS peak_z_score, max(CASE WHEN place = 1 THEN metric_name END) AS peak_metric,
       max(CASE WHEN place = 1 THEN service END) AS peak_service, max(CASE WHEN place = 1 THEN timestamp END) AS peak_timestamp
FROM ranked_points GROUP BY incident_id, window_no"""),
}


def block(name: str, reads: str, text: str) -> None:
    """Add a building block other queries can read."""
    if name in BLOCKS:
        raise ValueError(f"block {name} exists")
    BLOCKS[name] = (reads, text)


def sql(body: str, reads: str = "", stored: str = "") -> str:
    """``body`` with the blocks it reads, and what those read, as a WITH clause.

    ``stored`` names blocks to compute once as a whole: with a LIMIT around it, a union of joins over recursive blocks is
    otherwise streamed, and the recursion runs again and again.
    """
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for needed in BLOCKS[name][0].split():
                visit(needed)
            ordered.append(name)

    for name in reads.split():
        visit(name)
    if not ordered:
        return body
    readers = [r for name in ordered for r in BLOCKS[name][0].split()] + reads.split()

    def kind(name: str) -> str:
        """A block that several read is computed once; a recursive one always is."""
        again = (readers.count(name) > 1 or name in stored.split()) and f"FROM {name} " not in BLOCKS[name][1]
        return "AS MATERIALIZED" if again else "AS"

    clause = ",\n".join(f"{name} {kind(name)} ({BLOCKS[name][1]})" for name in ordered)
    return f"WITH RECURSIVE {clause}\n{body}"
