"""Queries that scan files: texts derived from the tables are written once and read back by the file readers."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from pyrewatch import schemas as S
from pyrewatch.functions.times import minutes_between
from pyrewatch.operators.series import SERIES
from pyrewatch.plans import tables as t
from pyrewatch.plans.detection import _POINT, rounded
from pyrewatch.plans.duck import sql
from pyrewatch.plans.ingest import incident_documents
from pyrewatch.plans.registry import query
from pyrewatch.plans.retrieve import postmortem_files
from pyrewatch.session import cut_lineage, delete_at_end, shared_folder
from pyrewatch.sources import documents as docs, logs as log_source, metrics as metric_source, reports
from pyrewatch.sources.documents import NOTE_NAMES
from pyrewatch.sources.folder import documents_of, numbered, read_folder
from pyrewatch.streaming.detector import detect_stream, stream_windows


def folder(spark, name):
    path = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    delete_at_end(spark, path)
    return path


def written(spark, rows, keys, order, name):
    """A folder with one text file per key, its lines (column ``value``) in order."""
    path = folder(spark, name)
    rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, "value").write.partitionBy(*keys).text(path)
    return path


def _name(path, key):
    return F.regexp_extract(path, f"{key}=([^/]+)", 1)


@query("log_files", "A3 A9", sql("""
SELECT 'INC-' || file AS incident_id, row_number() OVER (PARTITION BY file ORDER BY line_no) AS location_no, reason
FROM (SELECT substr(path, 10, 8) AS file, * FROM line_issues) QUALIFY reason IS NOT NULL""", "line_issues"))
def _(spark, sf):
    """One file of JSON lines per incident, read in splits; rejected lines with their numbers in the file."""
    lines = t.raw_lines(spark, sf).select(
        F.regexp_extract("path", r"(INC-\d+)", 1).alias("of"), "line_no", F.col("line").alias("value"))
    path = written(spark, lines, ["of"], ["line_no"], "logs")
    found = log_source.check_log_lines(log_source.read_log_lines(spark, path), _name("path", "of"))
    return log_source.rejects(found).select(_name("path", "of").alias("incident_id"), "location_no", "reason")


@query("incident_folder", "A1 A2 A3 A8", sql("""
SELECT 'INC-' || file AS incident_id, 'logs' AS kind, row_number() OVER (PARTITION BY file ORDER BY line_no) AS location_no, reason
FROM (SELECT substr(path, 10, 8) AS file, * FROM line_issues) QUALIFY reason IS NOT NULL
UNION ALL SELECT incident_id, 'incidents', 0, reason FROM document_issues WHERE reason IS NOT NULL""", "line_issues document_issues"))
def _(spark, sf):
    """Logs and records of all incidents in one folder, read through its data source; what is wrong with either."""
    root = folder(spark, "incidents")
    lines = t.raw_lines(spark, sf).select(
        F.regexp_extract("path", r"(INC-\d+)", 1).alias("of"), "line_no", F.col("line").alias("value"))
    lines.repartition("of").sortWithinPartitions("of", "line_no").select("of", "value").write.partitionBy("of").text(f"{root}/logs")
    incident_documents(spark, sf).select("stem", F.col("text").alias("value")).repartition("stem").write.partitionBy("stem").text(f"{root}/incidents")
    found = log_source.check_log_lines(numbered(read_folder(spark, root, ["logs"])).select("path", "line_no", "line"), _name("path", "of"))
    records = docs.check_incident_documents(documents_of(read_folder(spark, root, ["incidents"]))).where(F.size("reasons") > 0)
    return log_source.rejects(found).select(
        _name("path", "of").alias("incident_id"), F.lit("logs").alias("kind"), "location_no", "reason").unionByName(
        records.select(F.col("stem").alias("incident_id"), F.lit("incidents").alias("kind"), F.lit(0).cast("long").alias("location_no"),
                       F.array_join("reasons", "; ").alias("reason")))


@query("metric_files", "A4 A5", sql("""
SELECT * REPLACE ('team "a",' || chr(10) || service AS service) FROM metrics""", "metrics"))
def _(spark, sf):
    """CSV files whose service names are quoted and hold commas, quotes and line breaks; the header's order differs by file."""
    rows = t.metrics(spark, sf).withColumn("service", F.concat(F.lit('team "a",\n'), "service"))
    order = {False: list(S.METRIC_COLUMNS), True: list(reversed(S.METRIC_COLUMNS))}
    turned = F.dayofmonth("timestamp") % 2 == 0

    def cell(name):
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')) if name == "service" else text

    def line(names):
        return F.concat_ws(",", *[cell(name) for name in names])

    body = rows.select(F.col("incident_id").alias("of"), F.lit(1).alias("part"), "timestamp", "service",
                       F.when(turned, line(order[True])).otherwise(line(order[False])).alias("value"))
    head = rows.select(F.col("incident_id").alias("of"), F.lit(0).alias("part"), F.col("timestamp").cast("date").cast(
        "timestamp_ntz").alias("timestamp"), F.lit("").alias("service"), F.when(turned, ",".join(order[True])).otherwise(
        ",".join(order[False])).alias("value")).distinct()
    path = written(spark, head.unionByName(body), ["of"], ["part", "timestamp", "service"], "metrics")
    cells, _ = metric_source.read_metric_cells(spark, path)
    return metric_source.ingest_metrics(cells, _name("path", "of"))[0]


@query("incident_files", "A1 A8", sql("""
SELECT incident_id AS stem, reason FROM document_issues WHERE reason IS NOT NULL""", "document_issues"))
def _(spark, sf):
    path = written(spark, incident_documents(spark, sf).select("stem", F.col("text").alias("value")), ["stem"], [], "incidents")
    found = docs.read_documents(spark, path).withColumn("stem", _name("path", "stem"))
    checked = docs.check_incident_documents(found)
    return checked.where(F.size("reasons") > 0).select("stem", F.array_join("reasons", "; ").alias("reason"))


@query("postmortem_reads", "A10", sql("""
SELECT incident_id, title, len(symptoms) + len(observed_signals) + len(timeline) + len(contributing_factors) + len(resolution)
  + len(lessons_learned) AS lines FROM postmortems""", "postmortems"))
def _(spark, sf):
    """Whole documents as postmortems, many to a file; every line of a text is in one of the lists."""
    path = folder(spark, "postmortems")
    docs.write_bundles(postmortem_files(spark, sf), path)
    found = docs.parse_postmortems(docs.read_bundles(spark, path))
    lists = ("symptoms", "observed_signals", "timeline", "contributing_factors", "resolution", "lessons_learned")
    lines = sum((F.size(name) for name in lists[1:]), F.size(lists[0]))
    return found.where(F.size("reasons") == 0).select("incident_id", "title", lines.cast("long").alias("lines"))


@query("technical_notes", "A11 H2", sql("""
WITH notes AS (SELECT ['database.md', 'memory.md', 'networking.md', 'troubleshooting.md'][item_id % 4 + 1] AS document_name,
  '## Item ' || item_id || chr(10) || text || chr(10) AS part, item_id FROM benchmark)
SELECT document_name, length(string_agg(part, '' ORDER BY item_id)) AS characters, count(*) AS items FROM notes GROUP BY document_name"""))
def _(spark, sf):
    """The four technical notes, each a file with the benchmark items of its share as sections, read whole."""
    path = folder(spark, "technical")
    items = t.read(spark, sf, "benchmark")
    for place, name in enumerate(NOTE_NAMES):
        part = F.concat(F.lit("## Item "), F.col("item_id").cast("string"), F.lit("\n"), "text").alias("value")
        items.where(F.col("item_id") % 4 == place).orderBy("item_id").coalesce(1).select(part).write.text(f"{path}/{name}", lineSep="\n")
    found = docs.read_notes(spark, path)
    heads = F.regexp_count("text", F.lit(r"(^|\n)## Item \d+\n"))
    return found.select("document_name", F.length("text").cast("long").alias("characters"), heads.cast("long").alias("items"))


@query("note_files", "A11", sql("""
SELECT CASE doc_id % 4 WHEN 0 THEN 'database.md' WHEN 1 THEN 'memory.md' WHEN 2 THEN 'networking.md' ELSE 'troubleshooting.md' END
  AS document_name, sum(length(text) + 1)::BIGINT - 1 AS characters, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT
  AS lines FROM documents GROUP BY ALL"""))
def _(spark, sf):
    """All documents as the text of the four technical notes: each task writes a file per note, lines are read in splits."""
    names = F.element_at(F.array(*[F.lit(n) for n in NOTE_NAMES]), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = t.read(spark, sf, "documents").select(names.alias("document"), F.col("text").alias("value"))
    path = folder(spark, "notes")
    rows.write.partitionBy("document").text(path, lineSep="\n")
    lines = docs.read_note_lines(spark, path)
    return lines.groupBy("document_name").agg((F.sum(F.length("line").cast("long") + 1) - 1).alias("characters"),
                                              F.count("*").alias("lines"))


@query("file_manifest", "A14", sql("""
SELECT item_id, problem FROM (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'checksum differs from manifest'
  WHEN item_id % 3 = 1 THEN 'not listed in manifest' END AS problem FROM benchmark) WHERE problem IS NOT NULL"""))
def _(spark, sf):
    """One file per benchmark item, the longer ones hashed as streams; a third of the manifest is stale and a third is missing."""
    items = t.read(spark, sf, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("value"))
    path = written(spark, items, ["item"], [], "items")
    key = _name("path", "item").cast("long")
    files = reports.file_digests(spark, path, whole=200).where(F.col("path").contains("item=")).select(key.alias("path"), "digest")
    right = F.sha2(F.concat("value", F.lit("\n")), 256)
    listed = items.where("item % 3 <> 1").select(F.col("item").alias("path"), F.when(F.col("item") % 3 == 0, "old").otherwise(
        right).alias("digest"))
    return reports.manifest_audit(files, listed).select(F.col("path").alias("item_id"), "problem")


@query("replaced_collection", "H4", sql("""
SELECT 2::BIGINT AS version, (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT doc_id) FROM documents) AS ids,
  (SELECT count(*) FROM documents) AS readable"""))
def _(spark, sf):
    """A collection of notes is replaced by one of all documents; readers get the second."""
    path = folder(spark, "collection")
    documents = t.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    reports.replace_collection(t.read(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"), path)
    summary = reports.replace_collection(documents, path)
    readable = reports.read_collection(spark, path).agg(F.count("*").alias("readable"))
    return summary.select("version", "documents", "ids").join(F.broadcast(readable))


ARRIVALS = 3


def _streamed(spark, rows, arrival, run):
    """``rows`` as files that arrive by thirds of the time from first to last ``arrival``; ``run`` makes a stream of them.

    The stream is started once per arrival and runs to the end of it, so later files never come before earlier ones,
    however many files an arrival has.
    """
    source, found, state = (folder(spark, name) for name in ("arrivals", "found", "stream"))
    rows = cut_lineage(rows.withColumn("_arrival", arrival))
    span = rows.agg(F.min("_arrival").alias("first"), F.max("_arrival").alias("last"))
    share = minutes_between(F.col("first"), F.col("_arrival")) / F.greatest(minutes_between(F.col("first"), F.col("last")), F.lit(1.0))
    placed = rows.join(F.broadcast(span)).withColumn("_place", F.least(F.floor(share * ARRIVALS), F.lit(ARRIVALS - 1)))
    kept = rows.drop("_arrival").schema
    for place in range(ARRIVALS):
        part = placed.where(F.col("_place") == place)
        part.repartition(F.xxhash64("_arrival", "service")).select(*kept.names).write.mode("append").parquet(source)
        out = run(spark.readStream.schema(kept).parquet(source))
        out.writeStream.trigger(availableNow=True).option("checkpointLocation", state).start(
            path=found, format="parquet", outputMode="append").awaitTermination()
    return spark.read.schema(out.schema).parquet(found)


@query("late_stream_points", "E5 F2", sql(f"""
SELECT {_POINT} FROM points WHERE timestamp < (SELECT max(timestamp) FROM series) - INTERVAL '3' HOUR""", "points series"))
def _(spark, sf):
    """The detector over rows that arrive up to two hours late and in no order: all points that the watermark has passed."""
    series = t.series(spark, sf).select(*SERIES, "timestamp", "value")
    late = F.make_dt_interval(mins=F.pmod(F.xxhash64("service", "timestamp"), F.lit(120)).cast("int"))
    return rounded(_streamed(spark, series, F.col("timestamp") + late, lambda rows: detect_stream(rows, late="3 hours")))


@query("streamed_windows", "E7 D4", sql("""
SELECT incident_id, start_time, end_time, anomaly_count, array_to_string(services, '|') AS affected_services,
  array_to_string(metrics, '|') AS affected_metrics FROM (
  SELECT incident_id, min(timestamp) AS start_time, max(timestamp) AS end_time, count(*) AS anomaly_count,
    list_sort(list_distinct(list(service))) AS services, list_sort(list_distinct(list(metric_name))) AS metrics FROM (
    SELECT *, sum(opens) OVER (PARTITION BY incident_id ORDER BY timestamp, service, metric_name) AS no FROM (
      SELECT *, CASE WHEN timestamp <= lag(timestamp) OVER (PARTITION BY incident_id ORDER BY timestamp, service, metric_name)
        + INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS opens FROM points)) GROUP BY incident_id, no)
WHERE end_time + INTERVAL '30' MINUTE <= (SELECT max(timestamp) FROM points) - INTERVAL '10' MINUTE""", "points"))
def _(spark, sf):
    """Windows of points that arrive by thirds of their time, each one when the watermark has passed its end."""
    found = _streamed(spark, t.points(spark, sf), F.col("timestamp"), lambda rows: stream_windows(rows, 30))
    lists = ("affected_services", "affected_metrics")
    return found.withColumns({c: F.array_join(c, "|") for c in lists})


@query("streamed_points", "E5 F2", sql(f"SELECT {_POINT} FROM points", "points"))
def _(spark, sf):
    """The detector as a stream over files that arrive by thirds of their time, run to their end into a table."""
    series = t.series(spark, sf).select(*SERIES, "timestamp", "value")
    return rounded(_streamed(spark, series, F.col("timestamp"), detect_stream))
