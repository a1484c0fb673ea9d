"""Numbered lines of text files, read in splits so that one very large file is shared by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of all files under ``path``.

    A split is read in order by one task, so the running row id gives the place of a line in its split. Only one row
    per split is aggregated to learn how many lines the splits before it hold; the lines are not shuffled.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"),
        F.col("value").alias("line"), F.monotonically_increasing_id().alias("_id"))
    splits = rows.groupBy("path", "_split").agg(F.min("_id").alias("_first"), F.count("*").alias("_lines"))
    earlier = Window.partitionBy("path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_offset", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)) - F.col("_first") + 1)
    return rows.join(splits.drop("_first", "_lines"), ["path", "_split"]).select(
        "path", (F.col("_id") + F.col("_offset")).alias("line_no"), "line")


#: Lines of a quoted record; a longer one is taken for a quote that was never closed.
RECORD_LINES = 10_000


def read_records(spark: SparkSession, path: str, most_lines: int = RECORD_LINES) -> DataFrame:
    """(path, row_no, line, lines) of quoted records, whose quoted cells may hold line breaks, of all files under ``path``.

    A quote opens or closes, so a line turns the state around where it has an odd number of them. Every split is scanned for
    both states it may begin in: whether it turns, and how many records begin in it either way. These rows, one per split, are
    folded along each file, which tells where a split begins and how many records stand before it; then the lines know theirs.
    A line that is a record of its own goes on as it is; only the lines of the others meet, by record.

    A record that is never closed, or has more than ``most_lines`` lines, has no ``line``; ``lines`` tells how many it has.
    """
    rows = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"),
        F.col("value").alias("line"), F.monotonically_increasing_id().alias("_id"))
    odd = (F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))) % 2
    inside = Window.partitionBy("path", "_split").orderBy("_id")
    turned = F.coalesce(F.sum("_odd").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    scanned = rows.withColumn("_odd", odd).withColumn("_turned", turned)
    both = [F.count_if(F.col("_turned") == state).alias(f"_begin{state}") for state in (0, 1)]
    splits = scanned.groupBy("path", "_split").agg((F.sum("_odd") % 2).alias("_turns"), *both)
    earlier = Window.partitionBy("path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_open", F.coalesce(F.sum("_turns").over(earlier), F.lit(0)) % 2).withColumn(
        "_begin", F.when(F.col("_open") == 0, F.col("_begin0")).otherwise(F.col("_begin1"))).withColumn(
        "_before", F.coalesce(F.sum("_begin").over(earlier), F.lit(0)))
    begins = F.col("_turned") == F.col("_open")
    number = F.col("_before") + F.sum(F.when(begins, 1).otherwise(0)).over(inside)
    lines = scanned.join(splits.select("path", "_split", "_open", "_before"), ["path", "_split"]).select(
        "path", number.alias("row_no"), "_id", "_odd", (begins & (F.col("_odd") == 0)).alias("_whole"), "line")
    whole = lines.where("_whole").select("path", "row_no", "line", F.lit(1).cast("long").alias("lines"))
    parts = lines.where("not _whole")
    sizes = parts.groupBy("path", "row_no").agg(F.count("*").alias("lines"), (F.sum("_odd") % 2 == 0).alias("_closed"))
    sound = F.col("_closed") & (F.col("lines") <= most_lines)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_id", "line"))), lambda x: x["line"]), "\n")
    joined = parts.join(sizes.where(sound), ["path", "row_no"]).groupBy("path", "row_no").agg(text.alias("line"), F.count("*").alias("lines"))
    broken = sizes.where(~sound).select("path", "row_no", F.lit(None).cast("string").alias("line"), "lines")
    return whole.unionByName(joined).unionByName(broken)


def file_name(path: str = "path") -> Column:
    return F.element_at(F.split(path, "/"), -1)


def files_without_rows(expected: DataFrame, rows: DataFrame, reason: str) -> DataFrame:
    """Reject rows for expected files (path) that are missing or empty. Files are told apart by their name.

    Spark does not scan empty files, so the list comes from the records that name the evidence files.
    """
    seen = rows.select(file_name().alias("_name")).distinct()
    return expected.withColumn("_name", file_name()).join(seen, "_name", "left_anti").select(
        "path", F.lit(0).cast("long").alias("location_no"), F.lit("file").alias("location"), F.lit(reason).alias("reason"),
        F.lit(None).cast("string").alias("incident_id"))
