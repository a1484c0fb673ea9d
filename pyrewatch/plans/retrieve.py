"""Queries on corpora, vectors, search and retrieval texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pyrewatch import schemas as S
from pyrewatch.functions.text import LABEL_LEAK, QUERY_LEAK, RELATIVE_TIME
from pyrewatch.operators import correlate as c, knowledge as kn, quality as q, retrieval as r
from pyrewatch.plans import tables as t
from pyrewatch.plans.correlation import evidence, squeezed
from pyrewatch.plans.duck import SEVERITY_RANK, block, in_list, literal, matches, sql
from pyrewatch.plans.ingest import _flat, _suite
from pyrewatch.plans.registry import query
from pyrewatch.schemas import METRIC_LABELS
from pyrewatch.sources import documents as docs

# --- corpora taken from `documents`: every document as a markdown note, labelled ones also as postmortems

def notes(spark, sf):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(
        i % 5 == 1, F.concat(F.lit("## "), F.substring(x, 1, 30), F.lit("\n\n"), x)).when(
        i % 2 == 0, F.concat(x, F.lit("\n"))).otherwise(x))
    head = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("# Notes of "), "source", F.lit("\n")))
    return t.read(spark, sf, "documents").select(
        F.concat(F.lit("note"), "doc_id", F.lit(".md")).alias("document_name"),
        F.concat(head, F.array_join(lines, "\n")).alias("text"))


_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def strip(text: str) -> str:
    return _STRIP.format(text)


NL2 = "chr(10) || chr(10)"
block("notes", "", f"""
SELECT 'note' || doc_id || '.md' AS document_name, 'note' || doc_id AS stem, {strip("""
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE '# Notes of ' || source || chr(10) END || array_to_string(
  list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 5 = 1 THEN '## ' || x[1:30] || chr(10) || chr(10) || x
    WHEN (i - 1) % 2 = 0 THEN x || chr(10) ELSE x END), chr(10))""")} AS text FROM documents""")
block("sections", "notes", f"""
SELECT document_name, stem, CASE WHEN regexp_matches(text, '(^|\\n)# ') THEN
    {strip("regexp_extract(chr(10) || text, '\\n# ([^\\n]*)', 1)")} ELSE stem END AS title, i AS section_no,
  {strip("string_split(part, chr(10))[1]")} AS section,
  {strip("CASE WHEN contains(part, chr(10)) THEN substr(part, instr(part, chr(10)) + 1) ELSE '' END")} AS body
FROM (SELECT document_name, stem, text, unnest(parts[2:]) AS part, generate_subscripts(parts[2:], 1) AS i
      FROM (SELECT *, string_split(chr(10) || text, chr(10) || '## ') AS parts FROM notes))""")
block("packed", "sections", f"""
SELECT *, CASE WHEN length(body) <= 1800 THEN [body] ELSE (SELECT CASE WHEN folded IS NULL THEN [body]
    ELSE list_append(folded.done, folded.now) END) END AS groups
FROM (SELECT *,
  CASE WHEN len(list_filter(string_split(body, {NL2}), lambda p: {strip('p')} <> '')) > 0 THEN
  list_reduce(list_transform(list_filter(list_transform(string_split(body, {NL2}), lambda p: {strip('p')}),
    lambda p: p <> ''), lambda p: {{'done': []::VARCHAR[], 'now': p}}),
  lambda a, x: CASE WHEN length(a.now || {NL2} || x.now) <= 1800 THEN {{'done': a.done, 'now': a.now || {NL2} || x.now}}
    ELSE {{'done': list_append(a.done, a.now), 'now': x.now}} END) END AS folded FROM sections)""")
block("piece_lists", "packed", """
SELECT document_name, stem, title, list({'done': []::STRUCT(section VARCHAR, body VARCHAR)[], 'section':
  CASE WHEN len(groups) = 1 THEN section ELSE section || ' (part ' || g || ')' END, 'body': groups[g]} ORDER BY section_no, g) AS pieces
FROM (SELECT *, unnest(generate_series(1, len(groups))) AS g FROM packed) GROUP BY ALL""")
block("chunk_lists", "piece_lists", f"""
SELECT document_name, stem, title, CASE WHEN len(m.done) >= 1 AND length(m.body) < 280 THEN
    list_append(m.done[:-2], {{'section': m.done[-1].section || ' / ' || m.section, 'body': m.done[-1].body || {NL2} || m.body}})
  ELSE list_append(m.done, {{'section': m.section, 'body': m.body}}) END AS chunks
FROM (SELECT *, list_reduce(pieces, lambda a, x: CASE WHEN length(a.body) < 280 THEN
    {{'done': a.done, 'section': a.section || ' / ' || x.section, 'body': a.body || {NL2} || x.body}}
  ELSE {{'done': list_append(a.done, {{'section': a.section, 'body': a.body}}), 'section': x.section, 'body': x.body}} END) AS m
  FROM piece_lists)""")
block("chunks", "chunk_lists", f"""
SELECT stem || '_' || lpad(cast(i AS varchar), greatest(3, length(cast(i AS varchar)))::INT, '0') AS id, document_name,
  'Document: ' || title || chr(10) || 'Section: ' || ch.section || {NL2} || {strip('ch.body')} || chr(10) AS text,
  i - 1 AS position, ch.section AS section
FROM (SELECT document_name, stem, title, unnest(chunks) AS ch, generate_subscripts(chunks, 1) AS i FROM chunk_lists)""")


def chunks(spark, sf):
    return kn.chunk_markdown(notes(spark, sf))


@query("note_chunks", "H2 E14 A11", sql("""
SELECT id, text, cast(position AS bigint) AS position, document_name, section FROM chunks""", "chunks"))
def _(spark, sf):
    return chunks(spark, sf).select(
        "id", "text", F.col("position").cast("long").alias("position"), F.col("metadata")["document_name"].alias("document_name"),
        F.col("metadata")["section"].alias("section"))


_CAUSES = [*S.FAILURES, "OTHER"]


def postmortem_files(spark, sf):
    """One JSON text per labelled document; two kinds of it name another id or are no object."""
    rows = t.read(spark, sf, "documents").join(t.read(spark, sf, "labels"), "doc_id").withColumn("_l", F.split("text", "\n"))
    d, lines = F.col("doc_id"), F.col("_l")
    identity = F.concat(F.lit("HIST-"), "doc_id")
    cause = F.element_at(F.array(*[F.lit(x) for x in _CAUSES]), (d % 4 + 1).cast("int"))
    def part(k: int):
        """Every sixth line, so that all lines of a text belong to one list."""
        return F.filter(lines, lambda x, i: i % 6 == k)

    step = F.transform(part(2), lambda x, i: F.struct(
        F.when(d % 11 == 0, "now").otherwise(F.concat(F.lit("+0"), i.cast("string"), F.lit("m"))).alias("relative_time"),
        x.alias("event")))
    record = F.struct(
        F.when(d % 13 == 0, "HIST-X").otherwise(identity).alias("incident_id"),
        F.get(lines, F.lit(0)).alias("title"), F.lit("2024-01-15T10:00:00").alias("occurred_at"),
        F.concat(F.lit("svc-"), (d % 6).cast("string")).alias("service"),
        F.when(F.col("quality") == 1, "HIGH").when(F.col("toxic") == 1, "SEV").otherwise("LOW").alias("severity"),
        (F.col("n_chars") % 90).alias("duration_minutes"), F.when(d % 5 > 0, cause).alias("root_cause"),
        F.when(d % 2 == 0, "svc-1").alias("root_cause_service"),
        part(0).alias("symptoms"), part(1).alias("observed_signals"), step.alias("timeline"),
        part(3).alias("contributing_factors"), part(4).alias("resolution"),
        part(5).alias("lessons_learned"), F.array("lang", "source").alias("tags"),
        F.when(d % 3 > 0, F.array("source")).otherwise(F.array().cast("array<string>")).alias("affected_services"))
    return rows.select(F.concat(identity, F.lit(".json")).alias("path"), identity.alias("stem"),
                       F.when(d % 17 == 0, "[]").otherwise(F.to_json(record)).alias("text"))


def postmortems(spark, sf):
    return docs.parse_postmortems(postmortem_files(spark, sf)).where(F.size("reasons") == 0)


def _part(k: int) -> str:
    return f"list_filter(l, lambda x, i: (i - 1) % 6 = {k})"


_cause_list = "[" + ", ".join(literal(x) for x in _CAUSES) + "]"
block("postmortems", "", f"""
SELECT 'HIST-' || doc_id AS incident_id, l[1] AS title, '2024-01-15T10:00:00' AS occurred_at, 'svc-' || doc_id % 6 AS service,
  CASE WHEN quality = 1 THEN 'HIGH' WHEN toxic = 1 THEN 'SEV' ELSE 'LOW' END AS severity, n_chars % 90 AS duration_minutes,
  CASE WHEN doc_id % 5 > 0 THEN ({_cause_list})[doc_id % 4 + 1] END AS root_cause,
  CASE WHEN doc_id % 2 = 0 THEN 'svc-1' END AS root_cause_service, {_part(0)} AS symptoms, {_part(1)} AS observed_signals,
  list_transform({_part(2)}, lambda x, i: CASE WHEN doc_id % 11 = 0 THEN 'now' ELSE '+0' || (i - 1) || 'm' END || ': ' || x) AS timeline,
  {_part(3)} AS contributing_factors, {_part(4)} AS resolution, {_part(5)} AS lessons_learned, [lang, source] AS tags,
  CASE WHEN doc_id % 3 > 0 THEN [source] ELSE [] END AS affected_services, doc_id
FROM (SELECT d.*, quality, toxic, string_split(text, chr(10)) AS l FROM documents d JOIN labels g ON g.doc_id = d.doc_id)
WHERE doc_id % 17 <> 0 AND doc_id % 13 <> 0""")


@query("postmortem_rejects", "A10", sql("""
SELECT 'HIST-' || doc_id AS stem, CASE WHEN doc_id % 17 = 0 THEN 'not a JSON object'
  ELSE 'incident_id: differs from the file name' END AS reason FROM labels JOIN documents USING (doc_id)
WHERE doc_id % 17 = 0 OR doc_id % 13 = 0"""))
def _(spark, sf):
    parsed = docs.parse_postmortems(postmortem_files(spark, sf))
    return parsed.where(F.size("reasons") > 0).select("stem", F.array_join("reasons", "; ").alias("reason"))


def _bul(head: str, items: str) -> str:
    return f"'{head}' || CASE WHEN len({items}) > 0 THEN chr(10) || array_to_string(list_transform({items}, lambda x: '- ' || x), chr(10)) ELSE '' END"


block("postmortem_texts", "postmortems", f"""
SELECT incident_id AS id, {strip("concat_ws(chr(10), 'Incident ' || incident_id, 'Title: ' || title, 'Service: ' || service, 'Severity: ' || severity, 'Duration minutes: ' || duration_minutes, 'When: ' || occurred_at, CASE WHEN len(affected_services) > 0 THEN 'Affected services: ' || array_to_string(affected_services, ', ') END, "
  + ", ".join(_bul(h, i) for h, i in (("Symptoms:", "symptoms"), ("Observed signals:", "observed_signals"), ("Timeline:", "timeline"),
    ("Contributing factors:", "contributing_factors"), ("Resolution:", "resolution"), ("Lessons learned:", "lessons_learned")))
  + ", 'Tags: ' || array_to_string(tags, ', '))")} || chr(10) AS text, service, severity, root_cause, duration_minutes, occurred_at
FROM postmortems""")


@query("postmortem_texts", "H1", sql("""
SELECT id, text, service, severity, root_cause AS cause, cast(duration_minutes AS varchar) AS duration FROM postmortem_texts""",
                                     "postmortem_texts"))
def _(spark, sf):
    meta = F.col("metadata")
    return kn.postmortem_documents(postmortems(spark, sf)).select(
        "id", "text", meta["service"].alias("service"), meta["severity"].alias("severity"),
        meta["historical_root_cause"].alias("cause"), meta["duration_minutes"].alias("duration"))


@query("independent_labels", "B17", sql("""
SELECT doc_id AS id FROM documents WHERE contains(text, source) OR contains(text, lang)"""))
def _(spark, sf):
    rows = t.read(spark, sf, "documents")
    def with_cause(name):
        return rows.select(F.col("doc_id").alias("id"), "text", F.create_map(F.lit("historical_root_cause"), name).alias("metadata"))
    return kn.leaking_documents(with_cause("source")).unionByName(kn.leaking_documents(with_cause("lang"))).select("id").distinct()


_NARRATIVE = "concat_ws(' ', title, array_to_string(symptoms, ' '), array_to_string(observed_signals, ' '), array_to_string(contributing_factors, ' '))"
_CORPUS = f"""
SELECT 'unknown cause' AS name, incident_id AS problem FROM postmortems WHERE coalesce(root_cause NOT IN {in_list(S.FAILURES)}, true)
UNION ALL SELECT 'unknown severity', incident_id FROM postmortems WHERE severity NOT IN {in_list(S.SEVERITIES)}
UNION ALL SELECT 'too short', incident_id FROM postmortems WHERE duration_minutes < 10
{' '.join(f"UNION ALL SELECT 'too few {n}', incident_id FROM postmortems WHERE len({n}) < {k}" for n, k in
          {"symptoms": 3, "observed_signals": 3, "timeline": 3, "contributing_factors": 1, "resolution": 1, "lessons_learned": 1}.items())}
UNION ALL SELECT 'bad step time', incident_id FROM postmortems WHERE len(list_filter(timeline, lambda x: NOT {matches('x', RELATIVE_TIME)})) > 0
UNION ALL SELECT 'label in narrative', incident_id FROM postmortems WHERE {matches(_NARRATIVE, LABEL_LEAK)}
UNION ALL SELECT 'unbalanced cause', coalesce(root_cause, 'none') || '=' || count(*) FROM postmortems GROUP BY root_cause HAVING count(*) <> 10
UNION ALL SELECT 'repeated title', min(incident_id) FROM postmortems GROUP BY title HAVING count(*) > 1
UNION ALL SELECT 'repeated symptoms', min(incident_id) FROM postmortems GROUP BY symptoms HAVING count(*) > 1"""


@query("corpus_checks", "D35 G10", sql(_suite(_CORPUS, kn.CORPUS_CHECKS), "postmortems"))
def _(spark, sf):
    import datetime as dt

    found = kn.corpus_problems(postmortems(spark, sf), t.incidents(spark, sf), dt.datetime(2026, 1, 1))
    return _flat(q.report(found, kn.CORPUS_CHECKS))


# --- vectors and search


def hashed(source: str, id_: str = "id", text: str = "text") -> str:
    """Sparse unit vectors (id, slot, w) of a table's texts."""
    parts = " UNION ALL ".join(
        f"SELECT id, cast('0x' || substr(h, {2 * i + 1}, 2) AS int) % 64 AS slot, "
        f"CASE WHEN cast('0x' || substr(h, {2 * i + 9}, 2) AS int) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM tokens" for i in range(4))
    return f"""
SELECT id, slot, weight / sqrt(sum(weight * weight) OVER (PARTITION BY id)) AS w FROM (
  WITH tokens AS (SELECT id, sha256(lower(token)) AS h FROM (
    SELECT {id_} AS id, unnest(regexp_split_to_array({text}, '[^\\p{{L}}\\p{{N}}]+')) AS token FROM {source}) WHERE token <> '')
  SELECT id, slot, sum(sign) AS weight FROM ({parts}) GROUP BY id, slot HAVING sum(sign) <> 0)"""


def ranked(queries: str, items: str, k: int = 3) -> str:
    return f"""
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT a.id AS query_id, b.id, round(coalesce(sum(x.w * y.w), 0), 9) AS score
  FROM (SELECT DISTINCT id FROM {queries}) a CROSS JOIN (SELECT DISTINCT id FROM {items}) b
  LEFT JOIN {queries} x ON x.id = a.id LEFT JOIN {items} y ON y.id = b.id AND y.slot = x.slot GROUP BY ALL)) WHERE rank <= {k}"""


block("chunk_vectors", "chunks", hashed("chunks"))
block("document_vectors", "", hashed("documents", "doc_id"))
block("benchmark_vectors", "", hashed("benchmark", "item_id"))
block("history_vectors", "postmortem_texts", hashed("postmortem_texts"))


@query("document_vectors", "H3", sql("SELECT id, slot, round(w, 9) AS w FROM document_vectors", "document_vectors"))
def _(spark, sf):
    documents = t.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    vectors = r.hash_vectors(documents)
    return vectors.select("id", F.posexplode("vector").alias("slot", "w")).where("w <> 0").withColumn("w", F.round("w", 9))


block("redacted", "", """
SELECT doc_id AS id, CASE WHEN lang = 'de' THEN regexp_replace(text, '[\\p{L}\\p{N}]+', '-', 'g') ELSE text END AS text FROM documents""")
block("redacted_vectors", "redacted", hashed("redacted"))


@query("unsearchable_documents", "H8", sql("""
SELECT id FROM redacted WHERE id NOT IN (SELECT id FROM redacted_vectors)""", "redacted redacted_vectors"))
def _(spark, sf):
    """German documents with every letter and digit struck out have no token left."""
    struck = F.when(F.col("lang") == "de", F.regexp_replace("text", r"[\p{L}\p{N}]+", "-")).otherwise(F.col("text"))
    documents = t.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), struck.alias("text"))
    return r.without_vector(documents, r.hash_vectors(documents))


@query("similar_documents", "C9 E13 F3", sql(ranked("benchmark_vectors", "document_vectors"), "benchmark_vectors document_vectors"))
def _(spark, sf):
    documents = t.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    passages = r.usable_queries(t.read(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"))
    queries = r.hash_vectors(passages).withColumnRenamed("id", "query_id")
    return r.top_k(queries, r.hash_vectors(documents), 3)


@query("nearest_to_label_centers", "C9 F3", sql("""
SELECT label AS query_id, vec_id AS id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT c.label, e.vec_id, round(list_cosine_similarity(c.center, cast(e.embedding AS DOUBLE[])), 9) AS score
    FROM (SELECT label, list(m ORDER BY i) AS center FROM (SELECT label, i, avg(v) AS m FROM (
        SELECT label, unnest(cast(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL)
      GROUP BY label) c CROSS JOIN embeddings e)) WHERE rank <= 5"""))
def _(spark, sf):
    items = t.read(spark, sf, "embeddings")
    means = items.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(
        F.avg(F.col("v").cast("double")).alias("m"))
    parts = F.array_sort(F.collect_list(F.struct("i", "m")))
    centers = means.groupBy(F.col("label").alias("query_id")).agg(F.transform(parts, lambda p: p["m"]).alias("vector"))
    vectors = items.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return r.top_k(centers, vectors, 5)


@query("hits_against_labels", "C6 F3", sql("""
SELECT query_id AS label, count(*) AS hits, count(*) FILTER (e.label = h.query_id) AS same_label FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT c.label AS query_id, e.vec_id AS id, round(list_cosine_similarity(c.center, cast(e.embedding AS DOUBLE[])), 9) AS score
    FROM (SELECT label, list(m ORDER BY i) AS center FROM (SELECT label, i, avg(v) AS m FROM (
        SELECT label, unnest(cast(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL)
      GROUP BY label) c CROSS JOIN embeddings e)) h JOIN embeddings e ON e.vec_id = h.id WHERE rank <= 5 GROUP BY query_id"""))
def _(spark, sf):
    from pyrewatch.plans.registry import REGISTRY

    found = REGISTRY["nearest_to_label_centers"].run(spark, sf)
    labels = t.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return found.join(labels, "id").groupBy(F.col("query_id").alias("label")).agg(
        F.count("*").alias("hits"), F.count_if(F.col("query_id") == labels["label"]).alias("same_label"))


# --- retrieval queries of incidents

block("series_counts", "points incidents", f"""
SELECT *, row_number() OVER (PARTITION BY incident_id, own, ok ORDER BY top DESC, points DESC, first_ts, service, metric_name) AS side,
  row_number() OVER (PARTITION BY incident_id ORDER BY own DESC, top DESC, points DESC, first_ts, service, metric_name) AS place,
  max(ok::INT) OVER (PARTITION BY incident_id) AS any_ok, max((own AND top = 3)::INT) OVER (PARTITION BY incident_id) = 1 AS own_high
FROM (SELECT *, own OR top >= 2 AS ok FROM (
  SELECT p.incident_id, p.service, metric_name, count(*) AS points, max({SEVERITY_RANK.replace('severity', 'p.severity')}) AS top,
    min(p.timestamp) AS first_ts, p.service = i.service AS own
  FROM points p JOIN incidents i ON i.incident_id = p.incident_id GROUP BY ALL))""")
block("series_facts", "series_counts", """
SELECT incident_id, service, metric_name, points, top AS severity_rank, own_high, place FROM series_counts
WHERE (ok AND side <= CASE WHEN own THEN 3 ELSE 1 END) OR (any_ok = 0 AND place <= 3)""")
block("event_facts", "timeline incidents", f"""
SELECT incident_id, service, event_type, events, place FROM (
  SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY own DESC, events DESC, first_position) AS place FROM (
    SELECT e.incident_id, e.service, event_type, cast(sum(occurrence_count) AS bigint) AS events, min(position) AS first_position,
      e.service = i.service AS own FROM timeline e JOIN incidents i ON i.incident_id = e.incident_id
    WHERE event_type IN {in_list(S.QUERY_EVENTS)} GROUP BY ALL)) WHERE place <= 6""")
block("change_facts", "timeline", f"""
SELECT incident_id, label, place FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY first_position) AS place FROM (
  SELECT incident_id, replace(event_type, '_', ' ') || ' on ' || service AS label, min(position) AS first_position FROM timeline
  WHERE event_type IN {in_list(S.QUERY_CHANGES)} GROUP BY ALL)) WHERE place <= 3""")


@query("query_series_facts", "D38 G4", sql("SELECT * FROM series_facts", "series_facts"))
def _(spark, sf):
    return r.series_facts(t.points(spark, sf), t.incidents(spark, sf))


@query("query_event_facts", "D39", sql("SELECT * FROM event_facts", "event_facts"))
def _(spark, sf):
    return r.event_facts(evidence(spark, sf), t.incidents(spark, sf))


@query("query_change_facts", "D40", sql("SELECT * FROM change_facts", "change_facts"))
def _(spark, sf):
    return r.change_facts(evidence(spark, sf))


_metric_words = " ".join(f"WHEN '{m}' THEN {literal(x)}" for m, x in METRIC_LABELS.items())
_ahead = "date_diff('microsecond', i.start_time, a.timestamp) / 6e7"
block("query_texts", "incidents series_facts event_facts change_facts timeline", f"""
SELECT i.incident_id AS query_id, concat_ws(' ',
  i.service || ' alert (' || i.severity || ', about ' || printf('%.0f', duration_minutes) || ' minutes): ' || i.title || '.',
  {squeezed('i.description')} || '.',
  coalesce(CASE WHEN high THEN 'Metric anomaly points: ' ELSE 'Metric deviations on the alerting service were below high severity: ' END
    || series || '.', 'No metric anomaly points were observed.'),
  coalesce('Observed log events: ' || events || '.',
    'No timeout, connection-wait, memory-pressure, or error events were retained on the observed timeline.'),
  'Changes observed in the window: ' || changes || '.',
  CASE WHEN others IS NULL THEN 'Related observations stayed on ' || i.service || '.' ELSE 'Related services include ' || others || '.' END,
  coalesce('The earliest anomaly on the timeline is ' || printf('%.0f', abs({_ahead})) || ' minutes ' ||
    CASE WHEN {_ahead} < 0 THEN 'before' ELSE 'after' END || ' the alert: ' || a.title || '.',
    'No anomaly was placed on the timeline before or during the alert.')) AS text
FROM incidents i
LEFT JOIN (SELECT incident_id, bool_or(own_high) AS high, string_agg(service || ' ' || CASE metric_name {_metric_words} END || ' was ' ||
    CASE severity_rank WHEN 3 THEN 'highly anomalous' WHEN 2 THEN 'anomalous' ELSE 'mildly elevated above baseline' END ||
    ' (' || points || ' anomalous points)', '; ' ORDER BY place) AS series FROM series_facts GROUP BY incident_id) s ON s.incident_id = i.incident_id
LEFT JOIN (SELECT incident_id, string_agg(replace(event_type, '_', ' ') || ' on ' || service || ' (' || events || ')', '; ' ORDER BY place) AS events
    FROM event_facts GROUP BY incident_id) e ON e.incident_id = i.incident_id
LEFT JOIN (SELECT incident_id, string_agg(label, '; ' ORDER BY place) AS changes FROM change_facts GROUP BY incident_id) c ON c.incident_id = i.incident_id
LEFT JOIN (SELECT t.incident_id, string_agg(DISTINCT t.service, ', ' ORDER BY t.service) AS others FROM timeline t JOIN incidents j
    ON j.incident_id = t.incident_id AND j.service <> t.service GROUP BY t.incident_id) o ON o.incident_id = i.incident_id
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY position) AS place FROM timeline WHERE source_type <> 'LOG') a
    ON a.incident_id = i.incident_id AND a.place = 1""")


def texts(spark, sf):
    points, incidents = t.points(spark, sf), c.cut_lineage(t.incidents(spark, sf))
    found = c.correlate(t.reached_logs(spark, sf), incidents, points, t.windows_of(points))
    return found, r.query_texts(incidents, points, found)


@query("query_texts", "H5 G5", sql("SELECT * FROM query_texts", "query_texts"))
def _(spark, sf):
    return texts(spark, sf)[1]


@query("query_label_guard", "B15", sql(f"""
SELECT kind, id FROM (SELECT 'turn' AS kind, cast(conv_id * 1000 + turn AS varchar) AS id, text FROM conversations
  UNION ALL SELECT 'document', cast(doc_id AS varchar), text FROM documents
  UNION ALL SELECT 'case', incident_id, 'alert of ' || root_cause_variant || ', ' || lower(scenario) FROM labels_of)
WHERE {matches('text', QUERY_LEAK)}""", "labels_of"))
def _(spark, sf):
    turns = t.read(spark, sf, "conversations").select(
        F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("id"), "text")
    documents = t.read(spark, sf, "documents").select(F.lit("document"), F.col("doc_id").cast("string"), "text")
    case = F.concat(F.lit("alert of "), "root_cause_variant", F.lit(", "), F.lower("scenario"))
    cases = t.labels(spark, sf).select(F.lit("case"), "incident_id", case)
    return r.leaking_queries(turns.union(documents).union(cases)).select("kind", "id")


_CAUSAL = " OR ".join(f"contains(' ' || lower(text) || ' ', {literal(p)})" for p in (
    " caused ", " causing ", " because ", " due to ", " led to ", " root cause", " responsible for ", " triggered ",
    " resulting from "))


@query("causal_wording", "B16", sql(f"""
SELECT incident_id, evidence_id, text FROM (SELECT incident_id, evidence_id, title AS text FROM titled
  UNION ALL SELECT incident_id, evidence_id, summary FROM titled WHERE source_type <> 'LOG'
  UNION ALL SELECT incident_id, 'log', message FROM logs) WHERE {_CAUSAL}""", "titled logs"))
def _(spark, sf):
    from pyrewatch.functions.text import has_causal_phrase

    quoted = t.logs(spark, sf).where(has_causal_phrase(F.col("message"))).select(
        "incident_id", F.lit("log").alias("evidence_id"), F.col("message").alias("text"))
    return c.causal_wording(evidence(spark, sf)).unionByName(quoted)


def search(spark, sf):
    """Evidence, queries, and the three best hits of every incident in both collections."""
    found, asked = texts(spark, sf)
    asked = c.cut_lineage(r.safe_queries(r.usable_queries(asked)))
    vectors = r.hash_vectors(asked.withColumnRenamed("query_id", "id")).withColumnRenamed("id", "query_id")
    def collection(documents):
        return c.cut_lineage(documents.select("id", "text", "metadata"))
    history = r.hits(vectors, collection(kn.postmortem_documents(postmortems(spark, sf))))
    notes_found = r.hits(vectors, collection(chunks(spark, sf)))
    return found, asked, history, notes_found


block("safe_texts", "query_texts", f"SELECT query_id AS id, text FROM query_texts WHERE NOT {matches('text', QUERY_LEAK)}")
block("query_vectors", "safe_texts", hashed("safe_texts"))
block("history_hits", "query_vectors history_vectors", ranked("query_vectors", "history_vectors"))
block("note_hits", "query_vectors chunk_vectors", ranked("query_vectors", "chunk_vectors"))


@query("retrieved_evidence", "H6 H7 H4 G7 G8", sql("""
SELECT query_id, rank, h.id, score, 'historical_incident' AS source_type, service, occurred_at, severity,
  cast(duration_minutes AS bigint) AS duration_minutes, '' AS title, '' AS section, NULL::VARCHAR AS document_name
FROM history_hits h JOIN postmortem_texts p ON p.id = h.id
UNION ALL SELECT query_id, rank, h.id, score, 'technical_document', NULL, NULL, NULL, NULL,
  coalesce(nullif(trim(regexp_extract(text, 'Document: ([^\\n]*)', 1)), ''), replace(document_name, '.md', '')), section, document_name
FROM note_hits h JOIN chunks c ON c.id = h.id""", "history_hits note_hits chunks postmortem_texts"))
def _(spark, sf):
    _, _, history, found = search(spark, sf)
    return r.typed_hits(history.unionByName(found))

