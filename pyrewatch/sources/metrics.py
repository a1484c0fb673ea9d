"""Metric CSV files: read every cell as text, then check, type and de-duplicate.

A row is one record. Cells may be quoted: a comma or a line break inside quotes belongs to the cell, and two quotes stand
for one. Files are read in splits all the same; a quote that is never closed is a problem of its file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pyrewatch import schemas as S
from pyrewatch.functions.evaluate import once
from pyrewatch.functions.text import stripped
from pyrewatch.functions.times import iso_text, parse_iso
from pyrewatch.sources.lines import files_without_rows, read_records

NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NOT_FINITE = r"(?i)^[+-]?(nan|inf|infinity)$"


#: Stands between cells while a record is cut: a noncharacter, which no text holds.
_BORDER = "\ufdd0"


def csv_cells(record: Column) -> Column:
    """The cells of a CSV record, without their quotes. The record is cut at its quotes first, so the work is linear."""
    def cell(text: Column) -> Column:
        inner = F.replace(F.substring(text, 2, F.length(text) - 2), F.lit('""'), F.lit('"'))
        return F.when((F.length(text) > 1) & text.startswith('"') & text.endswith('"'), inner).otherwise(text)
    # Every second part lies between quotes.
    parts = F.transform(F.split(F.regexp_replace(record, r"\r$", ""), '"', -1), lambda part, i: F.when(
        i % 2 == 0, F.translate(part, ",", _BORDER)).otherwise(part))
    return F.transform(F.split(F.array_join(parts, '"'), _BORDER, -1), cell)


def read_metric_cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cells, file problems). Row 1 is the header; a file whose header is wrong yields no cells."""
    records = read_records(spark, path)
    wanted = F.array(*[F.lit(c) for c in S.METRIC_COLUMNS])
    headers = records.where((F.col("row_no") == 1) & F.col("line").isNotNull()).select("path", csv_cells(F.col("line")).alias("header")).withColumns({
        "missing": F.array_except(wanted, "header"), "unexpected": F.array_except("header", wanted)})
    wrong = (F.size("missing") > 0) | (F.size("unexpected") > 0)
    unclosed = records.where(F.col("line").isNull())
    body = records.where(F.col("row_no") > 1).join(unclosed.select("path").distinct(), "path", "left_anti")
    note = F.concat_ws(
        "; ",
        F.when(F.size("missing") > 0, F.concat(F.lit("missing columns "), F.array_join("missing", ","))),
        F.when(F.size("unexpected") > 0, F.concat(F.lit("unexpected columns "), F.array_join("unexpected", ","))))

    def problem(files: DataFrame, location: Column, reason: Column, number: Column | None = None) -> DataFrame:
        number = F.lit(0) if number is None else number
        return files.select("path", number.cast("long").alias("location_no"), location.alias("location"), reason.alias("reason"), F.lit(None).cast("string").alias("incident_id"))

    row = F.concat(F.lit("row "), F.col("row_no").cast("string"))
    note_unclosed = F.concat(F.lit("a quote is not closed within "), F.col("lines").cast("string"), F.lit(" lines"))

    bare = headers.where(~wrong).join(body.select("path").distinct(), "path", "left_anti").join(
        unclosed.select("path"), "path", "left_anti")
    problems = problem(headers.where(wrong), F.lit("header"), note).unionByName(
        problem(bare, F.lit("file"), F.lit("contains no metric rows"))).unionByName(
        problem(unclosed, row, note_unclosed, F.col("row_no")))
    cells = once(body, "_split", csv_cells(F.col("line"))).join(headers.where(~wrong).select("path", "header"), "path").withColumn(
        "_cells", F.map_from_arrays("header", F.transform("header", lambda name, i: F.get("_split", i))))
    named = [F.col("_cells")[c].alias(c) for c in S.METRIC_COLUMNS]
    return cells.select("path", "row_no", *named), problems


def files_without_metrics(expected: DataFrame, cells: DataFrame) -> DataFrame:
    return files_without_rows(expected, cells, "contains no metric rows")


def _number_problem(name: str) -> Column:
    text = stripped(F.col(name))
    value = text.try_cast("double")
    top = 100.0 if name in S.PERCENT_METRICS else None
    blank = F.lit(None) if name in S.NULLABLE_METRICS else F.lit(f"{name}: blank but required")
    return (
        F.when(F.col(name).isNull(), F.lit(f"{name}: missing"))
        .when(text == "", blank)
        .when(text.rlike(NOT_FINITE), F.lit(f"{name}: not finite"))
        .when(~text.rlike(NUMBER), F.lit(f"{name}: not a number"))
        .when(value < 0, F.lit(f"{name}: below 0"))
        .when(F.lit(False) if top is None else value > top, F.lit(f"{name}: above 100"))
    )


def check_metric_cells(cells: DataFrame, expected: Column | None = None) -> DataFrame:
    """Add ``reasons`` and typed columns. A repeated (time, service) of a file names the row seen first."""
    at = parse_iso(F.col("timestamp"))
    found = [
        F.when(at.isNull(), F.lit("timestamp: not a zone-free ISO time")),
        F.when(~F.coalesce(F.col("incident_id").rlike(S.INCIDENT_ID_PATTERN), F.lit(False)), F.lit("incident_id: bad id")),
        F.when(F.coalesce(F.col("service"), F.lit("")) == "", F.lit("service: empty or missing")),
        *[_number_problem(name) for name in S.METRICS],
    ]
    if expected is not None:
        found.append(F.when(F.col("incident_id") != expected, F.concat(
            F.lit("row belongs to "), "incident_id", F.lit(", expected "), expected)))
    typed = {name: stripped(F.col(name)).try_cast("double") for name in S.METRICS}
    checked = once(cells, "reasons", F.array_compact(F.array(*found))).withColumns({"at": at, **typed})
    # Aggregate first: copies of one row may be very many, and only the smallest row number is needed.
    firsts = checked.where(F.size("reasons") == 0).groupBy("path", "at", "service").agg(
        F.min("row_no").alias("first_row"), F.count("*").alias("_copies")).where("_copies > 1").drop("_copies")
    joined = checked.join(firsts, ["path", "at", "service"], "left")
    repeated = (F.size("reasons") == 0) & F.coalesce(F.col("row_no") > F.col("first_row"), F.lit(False))
    note = F.concat(F.lit("duplicate row for "), "service", F.lit(" at "), iso_text(F.col("at")),
                    F.lit(" (first seen in row "), F.col("first_row").cast("string"), F.lit(")"))
    return joined.withColumn("reasons", F.when(repeated, F.array(note)).otherwise(F.col("reasons")))


def rejects(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reasons") > 0).select(
        "path", F.col("row_no").alias("location_no"), F.concat(F.lit("row "), F.col("row_no")).alias("location"),
        F.array_join("reasons", "; ").alias("reason"), "incident_id")


def valid_metrics(checked: DataFrame) -> DataFrame:
    """Typed rows of the files without a rejected row."""
    bad = checked.where(F.size("reasons") > 0).select("path").distinct()
    return checked.where(F.size("reasons") == 0).join(bad, "path", "left_anti").select(
        F.col("at").alias("timestamp"), "incident_id", "service", *S.METRICS)


def ingest_metrics(cells: DataFrame, expected: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects) of metric cells. Nothing is stored: each result checks the cells it reads."""
    checked = check_metric_cells(cells, expected)
    return valid_metrics(checked), rejects(checked)
