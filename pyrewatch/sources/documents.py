"""One JSON or markdown document per file: incident records, postmortems and technical notes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pyrewatch import schemas as S
from pyrewatch.functions.evaluate import once
from pyrewatch.functions.times import parse_iso

# The technical notes that have to exist.
NOTE_NAMES = ("database.md", "memory.md", "networking.md", "troubleshooting.md")
#: Bytes of a note that is read as one value.
NOTE_BYTES = 64 << 20
_TIMES = ("start_time", "end_time", "window_start", "window_end")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, text) of whole files."""
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    ).withColumn("stem", F.regexp_replace(name, r"\.[^.]*$", ""))


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, text) of documents that lie many to a file: JSON lines with the name and the text of each.

    A folder with a file per document costs a listing and an open per document; bundles are read in splits.
    """
    rows = spark.read.schema("stem string, text string").json(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), "text", "stem")


def write_bundles(documents: DataFrame, path: str) -> None:
    """Write (stem, text) as JSON lines, one file per task."""
    documents.select("stem", "text").write.json(path)


def _filled(column: Column) -> Column:
    return F.coalesce(column, F.lit("")) != ""


def _context_rules(r: Column) -> list[tuple[Column, str]]:
    start, end, opened, closed = (parse_iso(r[c]) for c in _TIMES)
    ordered = (opened <= start) & (start <= end) & (end <= closed)
    return [
        (F.coalesce(r["incident_id"].rlike(S.INCIDENT_ID_PATTERN), F.lit(False)), "incident_id: bad id"),
        *[(_filled(r[c]), f"{c}: empty or missing") for c in ("title", "service", "description")],
        (F.coalesce(r["severity"].isin(*S.SEVERITIES), F.lit(False)), "severity: unknown"),
        *[(parse_iso(r[c]).isNotNull(), f"{c}: not a zone-free ISO time") for c in _TIMES],
        (F.coalesce((r["duration_minutes"] >= 0) & ~F.isnan(r["duration_minutes"]), F.lit(False)),
         "duration_minutes: not a number from 0 up"),
        (F.coalesce(ordered, F.lit(True)), "times: expected window_start <= start_time <= end_time <= window_end"),
    ]


def _label_rules(r: Column) -> list[tuple[Column, str]]:
    faults = [r[c] for c in ("true_root_cause", "root_cause_service", "root_cause_variant", "fault_start_time")]
    known = F.coalesce(r["scenario"].isin(*S.SCENARIOS), F.lit(False))
    normal = r["scenario"] == S.NORMAL
    none, every = faults[0].isNull(), faults[0].isNotNull()
    for f in faults[1:]:
        none, every = none & f.isNull(), every & f.isNotNull()
    return [
        (known, "scenario: unknown"),
        (~known | ~normal | none, "labels: a NORMAL case has fault fields"),
        (~known | normal | every, "labels: a failure case lacks fault fields"),
        (~known | normal | F.coalesce(faults[0] == r["scenario"], F.lit(True)), "labels: cause differs from scenario"),
        (_filled(r["root_cause_detail"]), "root_cause_detail: empty or missing"),
        (_filled(r["resolution"]), "resolution: empty or missing"),
    ]


def check_incident_documents(documents: DataFrame) -> DataFrame:
    """Add ``record`` and ``reasons`` to (path, stem, text). Fields that are neither context nor label are refused."""
    record, keys = F.col("record"), F.json_object_keys("text")
    parsed = once(documents, "record", F.from_json("text", S.RAW_INCIDENT, {"columnNameOfCorruptRecord": "_corrupt"}))
    known = F.array(*[F.lit(c) for c in dict.fromkeys(S.CONTEXT_FIELDS + S.LABEL_FIELDS + S.FILE_FIELDS)])
    unknown = F.array_sort(F.array_except(keys, known))
    found = [
        F.when(F.size(unknown) > 0, F.concat(F.lit("unrecognized fields: "), F.array_join(unknown, ","))),
        F.when(record["incident_id"] != F.col("stem"), F.lit("incident_id: differs from the file name")),
        *[F.when(~ok, F.lit(reason)) for ok, reason in _context_rules(record) + _label_rules(record)],
    ]
    reasons = F.when(keys.isNull(), F.array(F.lit("not a JSON object"))).otherwise(F.array_compact(F.array(*found)))
    return once(parsed, "reasons", reasons)


def incident_context(checked: DataFrame) -> DataFrame:
    """What an investigation may read; no label column is selected."""
    record = F.col("record")
    columns = [
        (parse_iso(record[c]) if c in _TIMES else record[c]).alias(c) for c in S.CONTEXT_FIELDS
    ]
    return checked.where(F.size("reasons") == 0).select(*columns)


def incident_labels(checked: DataFrame) -> DataFrame:
    """Labels, for evaluation only."""
    record = F.col("record")
    columns = [
        (parse_iso(record[c]) if c == "fault_start_time" else record[c]).alias(c) for c in S.LABEL_FIELDS
    ]
    return checked.where(F.size("reasons") == 0).select(*columns)


def assert_disjoint(context: DataFrame, labels: DataFrame) -> None:
    shared = (set(context.columns) & set(labels.columns)) - {"incident_id"}
    if shared:
        raise ValueError(f"context and labels share columns {sorted(shared)}")


def incident_ids(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("stem").alias("incident_id")).orderBy("incident_id")


def parse_postmortems(documents: DataFrame) -> DataFrame:
    """Postmortems with ``reasons``: the record has to be an object whose id is the file name."""
    parsed = once(documents, "record", F.from_json("text", S.POSTMORTEM))
    reason = F.when(F.json_object_keys("text").isNull(), "not a JSON object").when(
        ~F.col("record.incident_id").eqNullSafe(F.col("stem")), "incident_id: differs from the file name")
    return parsed.select("path", "stem", F.array_compact(F.array(reason)).alias("reasons"), "record.*")


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """The fixed set of technical notes as (document_name, text); a missing or very large one is an error at once.

    A note is a file, or a folder that holds one.
    """
    paths = [f"{folder.rstrip('/')}/{name}" for name in NOTE_NAMES]
    sizes = spark.read.format("binaryFile").load(paths).select("path", "length")
    large = [r["path"] for r in sizes.where(F.col("length") > NOTE_BYTES).collect()]  # four files
    if large:
        raise ValueError(f"notes over {NOTE_BYTES} bytes, to be read by lines: {large}")
    name = F.regexp_extract(F.col("_metadata.file_path"), f"/({'|'.join(map(re.escape, NOTE_NAMES))})(/[^/]*)?$", 1)
    return spark.read.text(paths, wholetext=True).select(name.alias("document_name"), F.col("value").alias("text"))


def read_note_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(document_name, line) of notes of any size, each a folder ``document=<name>`` of text files, read in splits."""
    lines = spark.read.schema("value string, document string").text(folder, lineSep="\n")
    return lines.where(F.col("document").isin(*NOTE_NAMES)).select(F.col("document").alias("document_name"), F.col("value").alias("line"))
