"""Queries on evidence packs, report checks and the incident catalog."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from pyrewatch.functions.text import clip
from pyrewatch.functions.times import iso_text
from pyrewatch.operators import catalog as cat, grounding as g, packs
from pyrewatch.operators.quality import label_columns
from pyrewatch.plans import tables as t
from pyrewatch.plans.correlation import clipped, evidence, iso
from pyrewatch.plans.duck import block, literal, sql
from pyrewatch.plans.registry import query
from pyrewatch.plans.retrieve import search
from pyrewatch.schemas import INSUFFICIENT, RESULT
from pyrewatch.session import cut_lineage, shared_folder
from pyrewatch.sources.reports import read_reports, write_reports

# --- packs of incidents

block("pack", "evidence history_hits note_hits postmortem_texts chunks", f"""
SELECT incident_id, evidence_id, source_type, {clipped('detail', 240)} AS short_description, {clipped('detail', 500)} AS detail, timestamp
FROM (SELECT incident_id, evidence_id, source_type, summary AS detail, {iso('timestamp')} AS timestamp FROM evidence
  UNION ALL SELECT query_id, h.id, 'HISTORICAL_INCIDENT', 'Retrieved prior incident ' || h.id || ' (similarity ' ||
    printf('%.3f', score) || '). ' || text, occurred_at FROM history_hits h JOIN postmortem_texts p ON p.id = h.id
  UNION ALL SELECT query_id, h.id, 'TECHNICAL_DOCUMENT', 'Technical note ' || h.id || ', section ' || section || ' (similarity ' ||
    printf('%.3f', score) || '). ' || text, '' FROM note_hits h JOIN chunks c ON c.id = h.id)""")


@query("evidence_packs", "I1 F6", sql("SELECT * FROM pack", "pack", stored="pack"))
def _(spark, sf):
    found, _, history, notes = search(spark, sf)
    return packs.evidence_pack(found, history, notes)


def _lines(kind: str, order: str) -> str:
    stamp = "CASE WHEN timestamp <> '' THEN timestamp || ' ' ELSE '' END"
    return (f"coalesce((SELECT string_agg('- ' || evidence_id || ' ' || {stamp} || detail, chr(10) ORDER BY {order}evidence_id) "
            f"FROM pack p WHERE p.incident_id = i.incident_id AND source_type IN {kind}), '- none')")


_PACK_TEXT = f"""
SELECT i.incident_id, concat_ws(chr(10), 'incident_id: ' || i.incident_id, 'service: ' || i.service, 'severity: ' || severity,
  'title: ' || title, 'description: ' || description, 'alert: ' || {iso('start_time')} || ' to ' || {iso('end_time')} || ' (' ||
  printf('%.1f', duration_minutes) || ' min)', chr(10) || 'Citable ids:' || chr(10) || coalesce((SELECT string_agg('- ' || evidence_id ||
  ' [' || source_type || '] ' || short_description, chr(10) ORDER BY evidence_id) FROM pack p WHERE p.incident_id = i.incident_id), ''),
  chr(10) || 'Metric evidence:' || chr(10) || {_lines("('ANOMALY_WINDOW', 'METRIC_ANOMALY')", "source_type <> 'ANOMALY_WINDOW', ")},
  chr(10) || 'Log evidence:' || chr(10) || {_lines("('LOG')", "")},
  chr(10) || 'Earlier incidents, for comparison:' || chr(10) || {_lines("('HISTORICAL_INCIDENT')", "")},
  chr(10) || 'Technical notes:' || chr(10) || {_lines("('TECHNICAL_DOCUMENT')", "")},
  chr(10) || 'Search text:' || chr(10) || coalesce(q.text, '(empty)')) AS text
FROM incidents i LEFT JOIN safe_texts q ON q.id = i.incident_id"""


@query("rendered_packs", "I2", sql(_PACK_TEXT, "incidents pack safe_texts"))
def _(spark, sf):
    found, asked, history, notes = search(spark, sf)
    return packs.rendered_packs(packs.evidence_pack(found, history, notes), t.incidents(spark, sf), asked)


@query("clipped_texts", "G1", sql(f"""
SELECT doc_id, {clipped('text', 180)} AS short, {clipped('text', 240)} AS medium, {clipped('text', 500)} AS long FROM documents"""))
def _(spark, sf):
    text = F.col("text")
    return t.read(spark, sf, "documents").select(
        "doc_id", clip(text, 180).alias("short"), clip(text, 240).alias("medium"), clip(text, 500).alias("long"))


# --- reports: one per order, which cites its line items; the pack holds the items of smaller quantity

block("cited_items", "", """
SELECT l_orderkey AS o, l_linenumber AS n, 'P' || l_partkey AS e, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, 'P' || l_partkey) - 1 AS place FROM lineitem""")
block("supplied", "", f"""
SELECT DISTINCT 'INC-' || l_orderkey AS incident_id, 'P' || l_partkey AS evidence_id,
  CASE WHEN l_partkey % 5 = 3 THEN 'HISTORICAL_INCIDENT' WHEN l_partkey % 5 = 4 THEN 'TECHNICAL_DOCUMENT' ELSE 'LOG' END AS source_type,
  p_name || ' ' || p_brand AS short_description, p_type AS detail, {iso('o_orderdate')} AS timestamp
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity < 40""")


def supplied(spark, sf):
    """Texts are made once per part and order; dealt by part, items meet both their copies and their part."""
    part, order = F.col("p_partkey"), F.col("o_orderkey")
    kind = F.when(part % 5 == 3, "HISTORICAL_INCIDENT").when(part % 5 == 4, "TECHNICAL_DOCUMENT").otherwise("LOG")
    parts = t.read(spark, sf, "part").select(
        part.alias("l_partkey"), F.concat(F.lit("P"), part).alias("evidence_id"), kind.alias("source_type"),
        F.concat_ws(" ", "p_name", "p_brand").alias("short_description"), F.col("p_type").alias("detail"))
    orders = t.read(spark, sf, "orders").select(
        order.alias("l_orderkey"), F.concat(F.lit("INC-"), order).alias("incident_id"), iso_text(F.col("o_orderdate")).alias("timestamp"))
    items = t.read(spark, sf, "lineitem").where("l_quantity < 40").select("l_orderkey", "l_partkey")
    return items.repartition("l_partkey").distinct().join(parts, "l_partkey").join(orders, "l_orderkey").select(
        "incident_id", "evidence_id", "source_type", "short_description", "detail", "timestamp")


def drafts(spark, sf):
    """Line items 1-2 support the cause, 3 speaks against it, 4-5 support an alternative, 6 an action, 7 is similar."""
    items = t.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.concat(F.lit("P"), "l_partkey").alias("e")))).alias("_c"))

    def ids(*numbers):
        return F.transform(F.filter("_c", lambda x: x["n"].isin(*numbers)), lambda x: x["e"])

    def hypothesis(cause, confidence, support, against):
        return F.struct(cause.alias("cause"), confidence.alias("confidence"), support.alias("supporting_evidence_ids"),
                        against.alias("contradicting_evidence_ids"), F.lit("seen in the items").alias("rationale"))

    def references(found):
        return F.transform(found, lambda e: F.struct(
            e.alias("evidence_id"), F.lit("TECHNICAL_DOCUMENT").alias("source_type"), F.lit("said").alias("short_description")))

    none = F.array().cast("array<string>")
    total = F.col("o_totalprice") / 400_000
    cause = F.when(F.col("o_orderstatus") == "P", INSUFFICIENT).otherwise(F.col("o_orderpriority"))
    root = hypothesis(cause, F.when(F.col("o_orderpriority") == "5-LOW", total / 2).otherwise(total), ids(1, 2), ids(3))
    given = {
        "incident_id": F.concat(F.lit("INC-"), "o_orderkey"),
        "summary": F.when(F.col("o_orderpriority") == "3-MEDIUM", "").otherwise("summary"),
        "root_cause": root, "confidence": total,
        "alternative_causes": F.array(hypothesis(F.lit("other"), F.lit(0.1), ids(4, 5), none)),
        "supporting_evidence": references(ids(1, 2)), "contradicting_evidence": references(ids(3)),
        "timeline": F.transform(ids(1), lambda e: F.struct(e.alias("a"), F.lit("then").alias("b"), F.lit("said").alias("c"))),
        "recommended_actions": F.array(F.struct(F.lit("look").alias("a"), F.lit("why").alias("b"), ids(6).alias("c"))),
        "similar_incidents": F.transform(ids(7), lambda e: F.struct(e.alias("a"), F.lit("alike").alias("b"))),
    }
    orders = t.read(spark, sf, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select(*[given[f.name].cast(f.dataType).alias(f.name) for f in RESULT.fields])


def reports(spark, sf):
    """Reports as a stored table; most checks name their lists many times, and Spark would make a list each time."""
    return cut_lineage(drafts(spark, sf))


block("report_citations", "cited_items", """
SELECT 'INC-' || o AS incident_id, place, cast(row_number() OVER (PARTITION BY o, place ORDER BY n, e) - 1 AS int) AS position, e AS evidence_id
FROM (SELECT o, n, e, unnest(CASE WHEN n <= 2 THEN ['root_cause', 'supporting_evidence'] WHEN n = 3 THEN ['root_cause', 'contradicting_evidence']
  WHEN n <= 5 THEN ['alternative_causes[0]'] WHEN n = 6 THEN ['recommended_actions'] ELSE [] END) AS place FROM cited_items
  UNION ALL SELECT o, n, e, 'timeline' FROM cited_items WHERE n = 1)
WHERE o IN (SELECT o_orderkey FROM orders)""")


@query("report_citations", "C7 I4", sql("SELECT * FROM report_citations", "report_citations"))
def _(spark, sf):
    return g.citations(reports(spark, sf))


@query("unknown_citations", "C7", sql("""
SELECT c.* FROM report_citations c WHERE NOT EXISTS (SELECT 1 FROM supplied s WHERE s.incident_id = c.incident_id
  AND s.evidence_id = c.evidence_id)""", "report_citations supplied"))
def _(spark, sf):
    return g.unknown_citations(g.citations(reports(spark, sf)), supplied(spark, sf))


block("reported", "cited_items", """
SELECT 'INC-' || o_orderkey AS incident_id, o_orderkey AS o, o_totalprice / 400000 AS confidence, o_orderpriority AS priority,
  CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice / 400000 / 2 ELSE o_totalprice / 400000 END AS root_confidence,
  o_orderstatus <> 'P' AS concluded, count(*) FILTER (n <= 2) AS support, count(*) FILTER (n = 3) AS against,
  count(*) FILTER (n IN (4, 5)) AS alternative, count(*) FILTER (n = 6) AS action, count(*) FILTER (n = 7) AS alike
FROM orders JOIN cited_items ON o = o_orderkey GROUP BY ALL""")


@query("report_violations", "I3", sql("""
SELECT incident_id, unnest(list_filter([CASE WHEN priority = '3-MEDIUM' THEN 'summary is empty' END,
  CASE WHEN root_confidence > 1 THEN 'root cause is incomplete or its score is outside 0..1' END,
  CASE WHEN confidence > 1 THEN 'score is outside 0..1' END,
  CASE WHEN abs(confidence - root_confidence) > 1e-6 THEN 'score differs from the root cause''s' END,
  CASE WHEN concluded AND support = 0 THEN 'stated cause has no support' END], lambda v: v IS NOT NULL)) AS violation FROM reported""",
                                   "reported"))
def _(spark, sf):
    return g.result_violations(reports(spark, sf))


@query("grounding_violations", "I4", sql("""
SELECT incident_id, 'unknown incident' AS violation FROM reported WHERE o NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 > 0)
UNION ALL SELECT DISTINCT incident_id, place || ' cites ' || evidence_id FROM report_citations c WHERE NOT EXISTS (
  SELECT 1 FROM supplied s WHERE s.incident_id = c.incident_id AND s.evidence_id = c.evidence_id)
UNION ALL SELECT incident_id, 'alternative without support' FROM reported WHERE concluded AND alternative = 0
UNION ALL SELECT incident_id, 'action without evidence' FROM reported WHERE concluded AND action = 0
UNION ALL SELECT 'INC-' || o, 'similar incident ' || e || ' was not retrieved' FROM cited_items i WHERE n = 7
  AND o IN (SELECT o_orderkey FROM orders) AND NOT EXISTS (SELECT 1 FROM supplied s WHERE s.incident_id = 'INC-' || o
  AND s.evidence_id = e AND source_type = 'HISTORICAL_INCIDENT')""", "reported report_citations supplied cited_items"))
def _(spark, sf):
    # Reports on the orders of every tenth customer name no known incident; items of large quantity were not supplied.
    known = t.read(spark, sf, "orders").where("o_custkey % 10 > 0").select(F.concat(F.lit("INC-"), "o_orderkey").alias("incident_id"))
    return g.grounding_violations(reports(spark, sf), supplied(spark, sf), known)


block("cited_unique", "cited_items", """
SELECT o, role, e, row_number() OVER (PARTITION BY o, role ORDER BY first_place) - 1 AS position FROM (
  SELECT o, CASE WHEN n = 3 THEN 'contradicting' ELSE 'supporting' END AS role, e, min(place) AS first_place FROM cited_items
  WHERE n <= 5 AND o IN (SELECT o_orderkey FROM orders) GROUP BY ALL)""")


@query("cited_lists", "I5 F9", sql("""
SELECT 'INC-' || o_orderkey AS incident_id, coalesce((SELECT string_agg(e, '|' ORDER BY position) FROM cited_unique u
  WHERE u.o = o_orderkey AND role = 'supporting'), '') AS supporting, coalesce((SELECT string_agg(e, '|' ORDER BY position)
  FROM cited_unique u WHERE u.o = o_orderkey AND role = 'contradicting'), '') AS contradicting
FROM orders WHERE o_orderkey IN (SELECT o FROM cited_items)""", "cited_unique cited_items"))
def _(spark, sf):
    out = g.cited_lists(reports(spark, sf))
    return out.withColumns({c: F.array_join(c, "|") for c in ("supporting", "contradicting")})


block("references_found", "cited_unique cited_items supplied", """
SELECT r.incident_id, role, cast(position AS int) AS position, e AS evidence_id, source_type, short_description, timestamp FROM (
  SELECT 'INC-' || o AS incident_id, role, position, e FROM cited_unique
  UNION ALL SELECT 'INC-' || o, 'timeline', row_number() OVER (PARTITION BY o ORDER BY e) - 1, e FROM cited_items
    WHERE n = 1 AND o IN (SELECT o_orderkey FROM orders)) r
LEFT JOIN supplied s ON s.incident_id = r.incident_id AND s.evidence_id = r.e""")


@query("canonical_references", "C8 I5", sql("SELECT * FROM references_found", "references_found"))
def _(spark, sf):
    return g.canonical_references(reports(spark, sf), supplied(spark, sf))


@query("evidence_cards", "I7", sql("""
SELECT incident_id, role, evidence_id, source_type, short_description, timestamp FROM (SELECT *, row_number() OVER (
  PARTITION BY incident_id, evidence_id ORDER BY role DESC, position) AS place FROM references_found WHERE role <> 'timeline')
WHERE place = 1""", "references_found"))
def _(spark, sf):
    # The cards read two lists of a report once, so reports are not stored.
    return g.evidence_cards(g.canonical_references(drafts(spark, sf), supplied(spark, sf)))


@query("review_counts", "D41", sql("""
SELECT incident_id, CASE WHEN concluded THEN priority ELSE 'Insufficient evidence' END AS cause, support AS supporting,
  against AS contradicting, 1 AS alternatives, alike AS historical, support + against AS technical, 1 AS actions FROM reported""",
                               "reported"))
def _(spark, sf):
    return g.review_counts(reports(spark, sf))


_REASON = "No evidence was supplied."


@query("insufficient_reports", "I6", sql(f"""
SELECT 'INC-' || o_orderkey AS incident_id, {literal(_REASON)} AS summary, '{INSUFFICIENT}' AS cause, 0.0::DOUBLE AS confidence,
  1 AS actions, 0 AS citations FROM orders WHERE 'INC-' || o_orderkey NOT IN (SELECT incident_id FROM supplied)""", "supplied"))
def _(spark, sf):
    incidents = t.read(spark, sf, "orders").select(F.concat(F.lit("INC-"), "o_orderkey").alias("incident_id"))
    out = g.insufficient_results(incidents, supplied(spark, sf), _REASON)
    cited = F.size("root_cause.supporting_evidence_ids") + F.size("supporting_evidence") + F.size("timeline")
    return out.select("incident_id", "summary", F.col("root_cause.cause").alias("cause"), "confidence",
                      F.size("recommended_actions").alias("actions"), cited.alias("citations"))


# --- catalog

@query("catalog_list", "I8", sql("""
SELECT incident_id, title, service, severity, start_time, end_time, round(duration_minutes, 6) AS duration_minutes, description
FROM incidents""", "incidents"))
def _(spark, sf):
    return cat.listing(t.incidents(spark, sf)).withColumn("duration_minutes", F.round("duration_minutes", 6))


@query("catalog_search", "B12", sql("""
SELECT 'text' AS search, incident_id FROM incidents WHERE contains(lower(concat_ws(' ', incident_id, title, service, description)), 'timing')
UNION ALL SELECT 'service and severity', incident_id FROM incidents WHERE service = 'svc-1' AND severity = 'CRITICAL'
UNION ALL SELECT 'all', incident_id FROM incidents""", "incidents"))
def _(spark, sf):
    incidents = t.incidents(spark, sf)
    searches = {"text": {"text": " TIMING "}, "service and severity": {"service": "svc-1", "severity": "CRITICAL"}, "all": {}}
    out = None
    for name, given in searches.items():
        rows = cat.matching(incidents, **given).select(F.lit(name).alias("search"), "incident_id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("catalog_facets", "B13", sql("""
SELECT DISTINCT 'service' AS facet, service AS value, 0 AS place FROM incidents
UNION ALL SELECT DISTINCT 'severity', severity, CASE severity WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END FROM incidents""",
                                "incidents"))
def _(spark, sf):
    return cat.facets(t.incidents(spark, sf))


@query("catalog_records", "I8 D1 D2 D9", sql("""
SELECT i.incident_id, i.service, severity, coalesce(lines, 0) AS line_count, coalesce(log_services, 0) AS log_services,
  coalesce(rows, 0) AS row_count, coalesce(window_count, 0) AS window_count, coalesce(point_count, 0) AS point_count,
  coalesce(timeline_events, 0) AS timeline_events, observed_services, anomalous_metrics,
  window_count IS NOT NULL AS anomalies_available, timeline_events IS NOT NULL AS timeline_available
FROM incidents i LEFT JOIN (SELECT incident_id, count(*) AS lines, count(DISTINCT service) AS log_services FROM logs GROUP BY ALL) l USING (incident_id)
LEFT JOIN (SELECT incident_id, count(*) AS rows FROM metrics GROUP BY ALL) m USING (incident_id)
LEFT JOIN (SELECT incident_id, count(*) AS window_count, cast(sum(anomaly_count) AS bigint) AS point_count FROM windows GROUP BY ALL) w USING (incident_id)
LEFT JOIN (SELECT incident_id, string_agg(DISTINCT metric_name, '|' ORDER BY metric_name) AS anomalous_metrics FROM points GROUP BY ALL) p USING (incident_id)
LEFT JOIN (SELECT incident_id, count(*) AS timeline_events, string_agg(DISTINCT service, '|' ORDER BY service) AS observed_services
  FROM evidence GROUP BY ALL) e USING (incident_id)""", "incidents logs metrics windows points evidence"))
def _(spark, sf):
    points = t.points(spark, sf)
    out = cat.records(t.incidents(spark, sf), t.logs(spark, sf), t.metrics(spark, sf), t.windows_of(points),
                      evidence(spark, sf), points)
    hidden = label_columns(out)
    if hidden:
        raise ValueError(f"the catalog shows label columns {hidden}")
    return out.select(
        "incident_id", "service", "severity", "line_count", F.coalesce(F.size("log_services"), F.lit(0)).alias("log_services"),
        "row_count", "window_count", "point_count", "timeline_events",
        F.array_join("observed_services", "|").alias("observed_services"),
        F.array_join("anomalous_metrics", "|").alias("anomalous_metrics"), "anomalies_available", "timeline_available")


@query("report_round_trip", "A12", sql("""
SELECT incident_id, window_no, start_time, end_time, severity, anomaly_count FROM windows""", "windows"))
def _(spark, sf):
    """Windows written per incident, a third of the incidents written again, and read back."""
    path = f"{shared_folder(spark)}/reports-{uuid4().hex}"
    report = t.windows(spark, sf).select("incident_id", "window_no", "start_time", "end_time", "severity", "anomaly_count")
    write_reports(report, path)
    write_reports(report.where(F.substring("incident_id", -1, 1).isin("1", "4", "7")), path)
    return read_reports(spark, path).select(report.columns)
