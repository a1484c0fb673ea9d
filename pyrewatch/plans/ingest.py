"""Queries on reading and checking raw records."""

from __future__ import annotations

from pyspark.sql import functions as F

from pyrewatch import schemas as S
from pyrewatch.functions.text import LABEL_LEAK
from pyrewatch.functions.times import iso_text
from pyrewatch.operators import quality as q
from pyrewatch.operators.ordered import with_previous
from pyrewatch.sources import documents as docs, logs as log_source, metrics as metric_source, reports
from pyrewatch.plans import tables as t
from pyrewatch.plans.correlation import iso
from pyrewatch.plans.duck import block, in_list, literal, matches, sql
from pyrewatch.plans.registry import query

block("raw_lines", "", t.duck(t.RAW_LINES))
block("line_issues", "raw_lines", """
SELECT *, CASE k WHEN 77 THEN 'blank line' WHEN 13 THEN 'not a JSON object' WHEN 51 THEN 'not a JSON object'
  WHEN 63 THEN 'event_type must not be supplied'
  ELSE nullif(concat_ws('; ', CASE k WHEN 57 THEN 'timestamp: not a zone-free ISO time' END,
    CASE k WHEN 88 THEN 'incident_id: bad id' END, CASE k WHEN 37 THEN 'host: empty or missing' END,
    CASE WHEN k = 29 OR raw_level = 'debug' THEN 'level: unknown' END, CASE k WHEN 41 THEN 'trace_id: missing' END,
    CASE k WHEN 19 THEN 'unexpected fields: pod' END,
    CASE WHEN k = 91 AND raw_level <> 'debug' THEN 'record belongs to INC-999, expected ' || substr(path, 6, 12) END), '')
  END AS reason,
  CASE WHEN k IN (77, 13, 51) THEN NULL WHEN k = 88 THEN 'INC-1' WHEN k = 91 THEN 'INC-999' ELSE substr(path, 6, 12) END
    AS claimed FROM raw_lines""")


def checked_lines(spark, sf):
    expected = F.regexp_extract("path", r"(INC-\d+)", 1)
    return log_source.check_log_lines(t.raw_lines(spark, sf).select("path", "line_no", "line"), expected)


@query("log_line_rejects", "A3 A9", sql("""
SELECT path, line_no AS location_no, 'line ' || line_no AS location, reason, claimed AS incident_id
FROM line_issues WHERE reason IS NOT NULL""", "line_issues"))
def _(spark, sf):
    return log_source.rejects(checked_lines(spark, sf))


@query("accepted_logs", "A3", sql("""
SELECT path, (dense_rank() OVER (PARTITION BY incident_id ORDER BY path) - 1) * 1099511627776 + seq AS seq, l.timestamp,
  incident_id, service, host, level, logger, message, trace_id, event_type
FROM logs l JOIN line_issues i ON i.line_no = l.seq
WHERE path NOT IN (SELECT path FROM line_issues WHERE reason IS NOT NULL)""", "logs line_issues"))
def _(spark, sf):
    expected = F.regexp_extract("path", r"(INC-\d+)", 1)
    return log_source.ingest_logs(t.raw_lines(spark, sf).select("path", "line_no", "line"), expected)[0]


@query("issue_reports", "A9", sql("""
SELECT path, count(*) AS problems, path || ': ' || count(*) || ' problem(s)' || chr(10) ||
  string_agg(CASE WHEN place <= 10 THEN text END, chr(10) ORDER BY place) ||
  CASE WHEN count(*) > 10 THEN chr(10) || '  - ... ' || (count(*) - 10) || ' more' ELSE '' END AS message
FROM (SELECT path, '  - line ' || line_no || coalesce(' [' || claimed || ']', '') || ': ' || reason AS text,
        row_number() OVER (PARTITION BY path ORDER BY line_no) AS place
      FROM (SELECT * REPLACE (substr(path, 1, 17) AS path) FROM line_issues) WHERE reason IS NOT NULL) GROUP BY path""",
                              "line_issues"))
def _(spark, sf):
    rejects = log_source.rejects(checked_lines(spark, sf))
    return reports.issue_report(rejects.withColumn("path", F.substring("path", 1, 17)))


block("raw_cells", "", t.duck(t.RAW_CELLS))
block("cell_issues", "raw_cells", f"""
SELECT *, nullif(concat_ws('; ', CASE WHEN h = 9 AND service = 'svc-4' THEN 'timestamp: not a zone-free ISO time' END,
  CASE WHEN h = 3 AND service = 'svc-1' THEN 'cpu_usage: not a number' END,
  CASE WHEN h = 5 AND service = 'svc-2' THEN 'memory_usage: blank but required' END,
  CASE WHEN h = 15 AND service = 'svc-1' THEN 'request_rate: below 0' END,
  CASE WHEN h = 11 AND service = 'svc-5' THEN 'latency_ms: not finite' END,
  CASE WHEN h = 7 AND service = 'svc-1' THEN 'error_rate: above 100' END,
  CASE WHEN copy = 1 THEN 'duplicate row for ' || service || ' at ' || {iso("cast(CASE WHEN copy = 1 THEN timestamp END AS timestamp)")}
    || ' (first seen in row ' || (row_no - 1) || ')' END), '') AS reason FROM raw_cells""")


def checked_cells(spark, sf):
    return metric_source.check_metric_cells(t.raw_cells(spark, sf).drop("h", "copy"))


@query("metric_row_rejects", "A4 A5", sql("""
SELECT path, row_no AS location_no, 'row ' || row_no AS location, reason, incident_id FROM cell_issues
WHERE reason IS NOT NULL""", "cell_issues"))
def _(spark, sf):
    return metric_source.rejects(checked_cells(spark, sf))


@query("accepted_metrics", "A4 A5", sql("""
SELECT m.* FROM metrics m WHERE 'metrics/' || incident_id || '-' || service || '.csv' NOT IN
  (SELECT path FROM cell_issues WHERE reason IS NOT NULL)""", "metrics cell_issues"))
def _(spark, sf):
    return metric_source.ingest_metrics(t.raw_cells(spark, sf).drop("h", "copy"))[0]


def incident_documents(spark, sf):
    """One JSON text per incident; the day of the month decides which fault it carries."""
    cases = t.incidents(spark, sf).join(t.labels(spark, sf), "incident_id").withColumn("_d", F.dayofmonth("window_start"))
    d = F.col("_d")
    at = {c: iso_text(F.col(c)) for c in ("start_time", "end_time", "window_start", "window_end", "fault_start_time")}
    cause = F.when(F.col("scenario") != "NORMAL", F.col("scenario"))
    record = F.struct(
        F.when(d == 6, "INC-000").otherwise(F.col("incident_id")).alias("incident_id"), "title", "scenario", "service",
        F.when(d == 9, "SEV1").otherwise(F.col("severity")).alias("severity"),
        at["start_time"].alias("start_time"), F.when(d == 7, at["window_start"]).otherwise(at["end_time"]).alias("end_time"),
        "duration_minutes", at["window_start"].alias("window_start"), at["window_end"].alias("window_end"), "description",
        F.when(d == 12, "MEMORY_LEAK").when(d == 13, "OTHER").otherwise(cause).alias("true_root_cause"),
        "root_cause_service", F.when(d != 14, F.col("root_cause_variant")).alias("root_cause_variant"),
        F.lit("fault").alias("root_cause_detail"), at["fault_start_time"].alias("fault_start_time"),
        F.array("service").alias("affected_services"), F.lit("fixed").alias("resolution"),
        F.when(d == 5, "x").alias("pager"),
    )
    return cases.select(
        F.concat(F.lit("incidents/"), "incident_id", F.lit(".json")).alias("path"), F.col("incident_id").alias("stem"),
        F.when(d == 10, "[1]").otherwise(F.to_json(record)).alias("text"))


block("document_issues", "incidents", """
SELECT *, CASE d WHEN 5 THEN 'unrecognized fields: pager' WHEN 6 THEN 'incident_id: differs from the file name'
  WHEN 7 THEN 'times: expected window_start <= start_time <= end_time <= window_end' WHEN 9 THEN 'severity: unknown'
  WHEN 10 THEN 'not a JSON object' WHEN 12 THEN 'labels: a NORMAL case has fault fields'
  WHEN 13 THEN 'labels: cause differs from scenario' WHEN 14 THEN 'labels: a failure case lacks fault fields' END AS reason
FROM (SELECT *, day(window_start) AS d FROM incidents)""")


@query("incident_document_rejects", "A1 A6", sql("""
SELECT incident_id AS stem, reason FROM document_issues WHERE reason IS NOT NULL""", "document_issues"))
def _(spark, sf):
    checked = docs.check_incident_documents(incident_documents(spark, sf))
    return checked.where(F.size("reasons") > 0).select("stem", F.array_join("reasons", "; ").alias("reason"))


@query("incident_contexts", "A1 A2 A8", sql("""
SELECT incident_id, title, service, severity, start_time, end_time, duration_minutes, window_start, window_end, description
FROM document_issues WHERE reason IS NULL""", "document_issues"))
def _(spark, sf):
    checked = docs.check_incident_documents(incident_documents(spark, sf))
    context = docs.incident_context(checked)
    docs.assert_disjoint(context, docs.incident_labels(checked))
    return context


@query("incident_labels", "A2", sql("""
SELECT l.incident_id, scenario, CASE WHEN scenario <> 'NORMAL' THEN scenario END AS true_root_cause, root_cause_service,
  root_cause_variant, fault_start_time, d.service AS affected_services, 'fixed' AS resolution
FROM labels_of l JOIN document_issues d ON d.incident_id = l.incident_id AND reason IS NULL""", "labels_of document_issues"))
def _(spark, sf):
    found = docs.incident_labels(docs.check_incident_documents(incident_documents(spark, sf)))
    return found.withColumn("affected_services", F.array_join("affected_services", "|")).drop(
        "root_cause_detail", "expected_symptoms")


@query("incident_listing", "A8 A13", sql("""
SELECT i.incident_id, coalesce(l.n, 0) AS log_rows, coalesce(m.n, 0) AS metric_rows FROM incidents i
LEFT JOIN (SELECT incident_id, count(*) AS n FROM logs GROUP BY ALL) l ON l.incident_id = i.incident_id
LEFT JOIN (SELECT incident_id, count(*) AS n FROM metrics GROUP BY ALL) m ON m.incident_id = i.incident_id""",
                                 "incidents logs metrics"))
def _(spark, sf):
    def rows(df, name):
        return df.groupBy("incident_id").agg(F.count("*").alias(name))
    listing = t.incidents(spark, sf).select("incident_id")
    listing = listing.join(rows(t.logs(spark, sf), "log_rows"), "incident_id", "left")
    listing = listing.join(rows(t.metrics(spark, sf), "metric_rows"), "incident_id", "left")
    return listing.na.fill(0)


@query("order_violations", "A7 E12", sql("""
SELECT path, line_no, placed FROM (SELECT path, line_no, placed, lag(placed) OVER (PARTITION BY path ORDER BY line_no)
  AS earlier FROM (SELECT o_orderpriority AS path, o_orderkey AS line_no, o_orderdate AS placed FROM orders))
WHERE placed < earlier"""))
def _(spark, sf):
    rows = t.read(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("path"), F.col("o_orderkey").alias("line_no"), F.col("o_orderdate").alias("placed"))
    bucket = F.floor(F.col("line_no") / 100_000)
    out = with_previous(rows, ["path"], bucket, ["line_no"], {"earlier": "placed"})
    return out.where("placed < earlier").drop("earlier")


@query("foreign_rows", "A7 A15", sql("""
SELECT 'unknown order' AS problem, l_orderkey AS key FROM (SELECT DISTINCT l_orderkey FROM lineitem) l
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'order without lines', o_orderkey FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"""))
def _(spark, sf):
    lines = t.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"))
    orders = t.read(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    names = F.when(F.col("problem") == "no evidence", "order without lines").otherwise("unknown order")
    return q.orphans(lines, orders, "key").withColumn("problem", names)


@query("duplicate_keys", "A5 A18", sql("""
SELECT l_orderkey, l_linenumber, count(*) AS copies, min(l_partkey) AS least_part FROM lineitem
GROUP BY ALL HAVING count(*) > 1"""))
def _(spark, sf):
    return t.read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.count("*").alias("copies"), F.min("l_partkey").alias("least_part")).where("copies > 1")


_SAMPLES = """
SELECT c.name, coalesce(n, 0) = 0 AS ok, coalesce(n, 0) AS n_problems, coalesce(samples, '') AS samples
FROM (VALUES {names}) c(name) LEFT JOIN (
  SELECT name, count(*) AS n, string_agg(CASE WHEN place <= 5 THEN problem END, '|' ORDER BY problem) AS samples
  FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY problem) AS place FROM ({found})) GROUP BY name) p
ON p.name = c.name"""


def _suite(found: str, names) -> str:
    return _SAMPLES.format(names=", ".join(f"({literal(n)})" for n in names), found=found)


def _flat(report):
    return report.withColumn("samples", F.array_join("samples", "|"))


_LOG_FOUND = f"""
SELECT name, incident_id || ':' || seq AS problem FROM (
  SELECT *, unnest([CASE WHEN raw_level NOT IN ('INFO', 'WARN', 'ERROR') THEN 'unknown level' END,
    CASE WHEN ts < before THEN 'not in order' END,
    CASE WHEN NOT ts BETWEEN window_start AND window_end THEN 'outside the case window' END,
    CASE WHEN {matches('message', LABEL_LEAK)} THEN 'label in message' END]) AS name
  FROM (SELECT l.*, l.timestamp AS ts, i.window_start, i.window_end,
          lag(l.timestamp) OVER (PARTITION BY l.incident_id ORDER BY seq) AS before
        FROM raw_logs l LEFT JOIN incidents i ON i.incident_id = l.incident_id)) WHERE name IS NOT NULL"""


@query("log_row_checks", "A16 A19", sql(_suite(_LOG_FOUND, q.LOG_CHECKS), "raw_logs incidents"))
def _(spark, sf):
    found = q.log_row_problems(t.raw_logs(spark, sf), t.incidents(spark, sf))
    return _flat(q.report(found, q.LOG_CHECKS))


_METRIC_FOUND = """
SELECT name, incident_id || ':' || service || ':' || strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS problem FROM (
  SELECT *, unnest([CASE WHEN latency_ms - 300 > 100 THEN 'above 100' END,
    CASE WHEN request_rate - 2 < 0 THEN 'below 0' END]) AS name FROM metrics) WHERE name IS NOT NULL"""


@query("metric_row_checks", "A17 A19", sql(_suite(_METRIC_FOUND, q.METRIC_CHECKS), "metrics"))
def _(spark, sf):
    # Shifted columns, so that the range checks have something to find.
    rows = t.metrics(spark, sf).withColumns(
        {"cpu_usage": F.col("latency_ms") - 300, "request_rate": F.col("request_rate") - 2})
    rows = rows.withColumns({c: F.greatest(F.col(c), F.lit(0.0)) for c in ("cpu_usage",)})
    return _flat(q.report(q.metric_row_problems(rows, t.incidents(spark, sf)), q.METRIC_CHECKS))


_LEAST = {"DB_CONNECTION_POOL_EXHAUSTION": 10, "MEMORY_LEAK": 10, "DOWNSTREAM_SERVICE_TIMEOUT": 10, "NORMAL": 5}
_CASE_FOUND = f"""
SELECT 'times out of order' AS name, incident_id AS problem FROM incidents
WHERE NOT (window_start <= start_time AND start_time < end_time AND end_time <= window_end)
UNION ALL SELECT 'fault outside window_start..start', l.incident_id FROM labels_of l JOIN incidents i
ON i.incident_id = l.incident_id WHERE scenario <> 'NORMAL' AND NOT fault_start_time BETWEEN window_start AND start_time
UNION ALL SELECT 'too few cases', scenario || '=' || n FROM (
  SELECT w.scenario, least_n, count(incident_id) AS n FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in _LEAST.items())})
  w(scenario, least_n) LEFT JOIN labels_of l ON l.scenario = w.scenario GROUP BY ALL) WHERE n < least_n"""


@query("case_checks", "A18 A19", sql(_suite(_CASE_FOUND, q.CASE_CHECKS), "incidents labels_of"))
def _(spark, sf):
    found = q.case_problems(t.incidents(spark, sf), t.labels(spark, sf), _LEAST)
    return _flat(q.report(found, q.CASE_CHECKS))


@query("label_leaks", "B14 D26", sql(f"""
SELECT 'log' AS kind, seq AS id FROM raw_logs WHERE {matches('message', LABEL_LEAK)}
UNION ALL SELECT 'document', doc_id FROM documents WHERE {matches('text', LABEL_LEAK)}
UNION ALL SELECT 'turn', conv_id * 1000 + turn FROM conversations WHERE {matches('text', LABEL_LEAK)}""", "raw_logs"))
def _(spark, sf):
    logs = q.label_leaks(t.raw_logs(spark, sf), "message").select(F.lit("log").alias("kind"), F.col("seq").alias("id"))
    documents = q.label_leaks(t.read(spark, sf, "documents"), "text").select(F.lit("document"), "doc_id")
    turns = q.label_leaks(t.read(spark, sf, "conversations"), "text").select(
        F.lit("turn"), F.col("conv_id") * 1000 + F.col("turn"))
    return logs.union(documents).union(turns)


@query("manifest_audit", "A14", sql("""
SELECT coalesce(f.path, m.path) AS path, CASE WHEN f.path IS NULL THEN 'listed in manifest but missing'
  WHEN m.path IS NULL THEN 'not listed in manifest' ELSE 'checksum differs from manifest' END AS problem
FROM (SELECT 'doc-' || doc_id AS path, sha256(text) AS digest FROM documents) f
FULL JOIN (SELECT 'doc-' || doc_id AS path, CASE WHEN toxic = 1 THEN 'stale' ELSE sha256(text) END AS digest FROM (
    SELECT l.doc_id, l.toxic, d.text FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id)
  UNION ALL SELECT 'bench-' || item_id, sha256(text) FROM benchmark) m ON m.path = f.path
WHERE f.digest IS DISTINCT FROM m.digest"""))
def _(spark, sf):
    documents = t.read(spark, sf, "documents")
    key = F.concat(F.lit("doc-"), "doc_id").alias("path")
    files = documents.select(key, F.sha2("text", 256).alias("digest"))
    digest = F.when(F.col("toxic") == 1, "stale").otherwise(F.sha2("text", 256)).alias("digest")
    listed = t.read(spark, sf, "labels").join(documents.select("doc_id", "text"), "doc_id", "left").select(key, digest)
    gone = t.read(spark, sf, "benchmark").select(
        F.concat(F.lit("bench-"), "item_id").alias("path"), F.sha2("text", 256).alias("digest"))
    return reports.manifest_audit(files, listed.unionByName(gone))


@query("rounded_summary", "A20 G11", sql("""
SELECT event_type, round(cents / 100.0 / n, 4) AS mean_value, CASE WHEN n_errors > 0 THEN round(100.0 * n_errors / n, 4) END
  AS error_share FROM (SELECT event_type, sum(cast(round(value * 100) AS bigint)) AS cents, count(*) AS n,
  count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY event_type)"""))
def _(spark, sf):
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    errors = F.count_if(F.col("event_type") == "error")
    share = F.when(errors > 0, errors * 100.0 / F.count("*")).otherwise(F.lit(float("nan")))
    out = t.read(spark, sf, "events").groupBy("event_type").agg(
        (cents / 100.0 / F.count("*")).alias("mean_value"), share.alias("error_share"))
    return reports.for_json(out)
