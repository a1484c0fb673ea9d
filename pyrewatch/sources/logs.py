"""JSON-lines logs: scan, validate, explain every rejected line.

A line is parsed by ``from_json`` against an all-string schema and checked with one expression per rule. All
rules of a line are reported. A file with any rejected line fails as a whole, as a left-anti join on its path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pyrewatch import schemas as S
from pyrewatch.functions.evaluate import once
from pyrewatch.functions.events import with_event_type
from pyrewatch.functions.text import normalize_level
from pyrewatch.functions.times import parse_iso
from pyrewatch.session import cut_lineage
from pyrewatch.sources.lines import files_without_rows, read_lines

#: Bits of a line number in ``seq``.
LINE_BITS = 40
REQUIRED = ("service", "host", "logger", "message")


def leveled_logs(raw: DataFrame) -> DataFrame:
    """Add the level to raw log rows; rows with an unknown level are left out."""
    return raw.withColumn("level", normalize_level(F.col("raw_level"))).where(F.col("level").isNotNull())


def typed_logs(raw: DataFrame) -> DataFrame:
    """Add level and event type to raw log rows; rows with an unknown level are left out."""
    return with_event_type(leveled_logs(raw), F.col("message"), F.col("level"))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of the log files under ``path``."""
    return read_lines(spark, path)


def files_without_logs(expected: DataFrame, lines: DataFrame) -> DataFrame:
    return files_without_rows(expected, lines, "contains no log records")


def _reasons(record: Column, keys: Column, expected: Column | None) -> Column:
    def missing(name):
        return record[name].isNull() | (record[name] == "")
    checks = [
        (parse_iso(record["timestamp"]).isNull(), F.lit("timestamp: not a zone-free ISO time")),
        (~F.coalesce(record["incident_id"].rlike(S.INCIDENT_ID_PATTERN), F.lit(False)), F.lit("incident_id: bad id")),
        *[(missing(name), F.lit(f"{name}: empty or missing")) for name in REQUIRED],
        (normalize_level(record["level"]).isNull(), F.lit("level: unknown")),
        (~F.array_contains(keys, "trace_id"), F.lit("trace_id: missing")),
        (F.coalesce(record["trace_id"] == "", F.lit(False)), F.lit("trace_id: empty")),
    ]
    unknown = F.array_except(keys, F.array(*[F.lit(c) for c in S.RAW_LOG.names if c != "_corrupt"]))
    checks.append((F.size(unknown) > 0, F.concat(F.lit("unexpected fields: "), F.array_join(F.array_sort(unknown), ","))))
    found = [F.when(bad, reason) for bad, reason in checks]
    own = F.array_compact(F.array(*found))
    if expected is None:
        return own
    foreign = F.concat(F.lit("record belongs to "), record["incident_id"], F.lit(", expected "), expected)
    strange = F.coalesce(record["incident_id"] != expected, F.lit(False))
    return F.when(F.concat_ws("", *found) != "", own).when(strange, F.array(foreign)).otherwise(own)


def check_log_lines(lines: DataFrame, expected: Column | None = None) -> DataFrame:
    """Add ``record``, ``reasons`` (empty when valid) and the claimed ``incident_id`` to (path, line_no, line)."""
    parsed = once(lines, "record", F.from_json("line", S.RAW_LOG, {"columnNameOfCorruptRecord": "_corrupt"}))
    parsed = once(parsed, "_keys", F.json_object_keys("line"))
    record, keys = F.col("record"), F.col("_keys")
    blank = F.trim(F.regexp_replace("line", r"\s", "")) == ""
    reasons = (
        F.when(blank, F.array(F.lit("blank line")))
        .when(keys.isNull(), F.array(F.lit("not a JSON object")))
        .when(record["event_type"].isNotNull(), F.array(F.lit("event_type must not be supplied")))
        .otherwise(_reasons(record, keys, expected))
    )
    return once(parsed, "reasons", reasons).withColumn("incident_id", record["incident_id"]).drop("_keys")


def rejects(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reasons") > 0).select(
        "path", F.col("line_no").alias("location_no"), F.concat(F.lit("line "), F.col("line_no")).alias("location"),
        F.array_join("reasons", "; ").alias("reason"), "incident_id",
    )


def valid_logs(checked: DataFrame) -> DataFrame:
    """Typed rows of the files without a rejected line.

    ``seq`` names a line of its incident: the place of its file among the incident's files, by path, in the upper bits
    and the line number below. It keeps file order for ties and is the line number where an incident has one file.
    """
    record = F.col("record")
    # One row per file and incident it names: whether the file is sound, and its place among the incident's files.
    files = checked.groupBy("path", "incident_id").agg(F.count_if(F.size("reasons") > 0).alias("_bad"))
    files = files.withColumn("_bad", F.sum("_bad").over(Window.partitionBy("path"))).where("_bad = 0").select(
        "path", "incident_id", (F.row_number().over(Window.partitionBy("incident_id").orderBy("path")) - 1).cast("long").alias("_file"))
    rows = checked.join(files, ["path", "incident_id"]).select(
        "path", (F.shiftleft("_file", LINE_BITS) + F.col("line_no")).alias("seq"), parse_iso(record["timestamp"]).alias("timestamp"),
        "incident_id", record["service"].alias("service"), record["host"].alias("host"), normalize_level(record["level"]).alias("level"),
        record["logger"].alias("logger"), record["message"].alias("message"), record["trace_id"].alias("trace_id"))
    return with_event_type(rows, F.col("message"), F.col("level"))


def ingest_logs(lines: DataFrame, expected: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects) of (path, line_no, line). Lines are parsed once; the checked records are stored for both results."""
    checked = cut_lineage(check_log_lines(lines, expected).drop("line"))
    return valid_logs(checked), rejects(checked)
