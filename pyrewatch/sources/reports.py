"""Derived tables on disk, file audits and issue reports."""

from __future__ import annotations

import json
import time
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256
from uuid import uuid4

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from pyrewatch.session import cut_lineage


def write_reports(report: DataFrame, path: str) -> None:
    """One partition per incident; a rerun replaces only the incidents it contains."""
    report.repartition("incident_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "incident_id").parquet(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def for_json(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round doubles for a JSON or CSV summary and turn NaN into null."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.round(F.nanvl(c, F.lit(None).cast("double")), digits) for c in doubles})


def write_summary(df: DataFrame, path: str, kind: str = "json") -> None:
    writer = for_json(df).write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


#: Versions that are tried before a writer gives up.
TRIES = 100
_VERSION = "version bigint, folder string, documents bigint, ids bigint"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _created(spark: SparkSession, path: str) -> bool:
    """Create an empty file unless there is one; of several writers one succeeds."""
    files, where = _file_system(spark, path)
    files.mkdirs(where.getParent())
    if files.getUri().getScheme() == "file":
        return spark._jvm.java.io.File(where.toUri().getPath()).createNewFile()
    try:
        files.create(where, False).close()
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception):
            return False
        raise
    return True


def _written(spark: SparkSession, path: str, text: str) -> None:
    files, where = _file_system(spark, path)
    out = files.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers taken so far, complete or not."""
    files, where = _file_system(spark, f"{path}/versions")
    names = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
    return [int(name.removesuffix(".json")) for name in names if name.endswith(".json") and not name.startswith((".", "_"))]


def replace_collection(collection: DataFrame, path: str) -> DataFrame:
    """Write a collection (id, ...) as a new version and make it the one that readers get. Returns its row.

    The rows go to a folder of their own. Only when they are complete the next free number is taken, by creating the version's
    file where there is none, and the file gets one row (version, folder, documents, distinct ids). Two writers get two numbers;
    a run that fails leaves readers with the version before, as a file without a row is not a version.
    """
    spark = collection.sparkSession
    folder = f"{path}/rows-{uuid4().hex}"
    collection.write.parquet(folder)
    counts = spark.read.parquet(folder).agg(F.count("*").alias("documents"), F.countDistinct("id").alias("ids")).first()
    for _ in range(TRIES):
        number = max(_versions(spark, path), default=0) + 1
        name = f"{path}/versions/{number:012}.json"
        if _created(spark, name):
            row = {"version": number, "folder": folder, **counts.asDict()}
            _written(spark, name, json.dumps(row) + "\n")
            return spark.read.schema(_VERSION).json(name)
    raise RuntimeError(f"no version could be taken in {TRIES} tries: {path}")


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """All complete versions of a collection."""
    return spark.read.schema(_VERSION).json(f"{path}/versions").where(F.col("version").isNotNull())


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of a collection."""
    newest = read_versions(spark, path).orderBy(F.desc("version")).first()
    if newest is None:
        raise FileNotFoundError(f"no complete version: {path}")
    return spark.read.parquet(newest["folder"])


def remove_unnamed(spark: SparkSession, path: str, older_than_hours: float = 24.0) -> int:
    """Remove folders of rows that no version names, left by runs that failed; young ones may belong to a run at work."""
    files, where = _file_system(spark, path)
    named = {r["folder"].rstrip("/").rsplit("/", 1)[-1] for r in read_versions(spark, path).select("folder").toLocalIterator()}
    oldest = (time.time() - older_than_hours * 3600) * 1000
    unnamed = [f.getPath() for f in files.listStatus(where) if f.getPath().getName().startswith("rows-")
               and f.getPath().getName() not in named and f.getModificationTime() <= oldest]
    for folder in unnamed:
        files.delete(folder, True)
    return len(unnamed)


def issue_report(rejects: DataFrame, shown: int = 10) -> DataFrame:
    """Per file: number of problems and a message with the first ``shown`` of them and the rest as a count.

    The rejects are stored once. The first lines are picked by a rank that every task limits before the shuffle, and the others
    are only counted, so a file with very many problems is neither one list nor one sorted group.
    """
    rejects = cut_lineage(rejects.select("path", "location_no", "location", "reason", "incident_id"))
    first = Window.partitionBy("path").orderBy("location_no", "reason")
    ranked = rejects.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= shown)
    where = F.when(F.col("incident_id").isNotNull(), F.concat("location", F.lit(" ["), "incident_id", F.lit("]"))).otherwise(
        F.col("location"))
    line = F.struct("_place", F.concat(F.lit("  - "), where, F.lit(": "), "reason").alias("text"))
    lines = ranked.groupBy("path").agg(F.array_sort(F.collect_list(line)).alias("_lines"))
    files = rejects.groupBy("path").agg(F.count("*").alias("problems")).join(lines, "path", "left")
    rest = F.when(F.col("problems") > shown, F.concat(
        F.lit("  - ... "), (F.col("problems") - shown).cast("string"), F.lit(" more")))
    head = F.concat("path", F.lit(": "), F.col("problems").cast("string"), F.lit(" problem(s)"))
    return files.select("path", "problems", F.concat_ws("\n", head, F.array_join(F.col("_lines.text"), "\n"), rest).alias("message"))


#: Largest file that is read as one row.
LARGEST_FILE = 64 << 20
_MARK = b"\xef\xbb\xbf"


def _streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each file from its lines in order, one batch at a time.

    Lines come without their breaks, and the reader leaves out a mark at the front of a file. The length of the file tells
    whether the last line had a break, and whether there was a mark, so both hashes are carried to the end.
    """
    current, size, seen, hashes = None, 0, 0, ()

    def done() -> pa.RecordBatch:
        # The first line was led by no break, so one break is still due where the file ends with one.
        plain, marked = hashes
        rest = size - seen
        chosen = marked if rest >= len(_MARK) else plain
        if rest in (1, 1 + len(_MARK)):
            chosen.update(b"\n")
        return pa.record_batch([[current], [size], [chosen.hexdigest()]], names=["path", "length", "digest"])

    for batch in batches:
        paths, sizes, lines = (batch.column(i).to_pylist() for i in range(3))
        at = 0
        while at < len(paths):
            end = bisect_right(paths, paths[at], lo=at)
            if paths[at] != current:
                if current is not None:
                    yield done()
                current, size, seen = paths[at], sizes[at], -1
                hashes = (sha256(), sha256(_MARK))
            part = b"\n".join(lines[at:end])
            part = part if seen < 0 else b"\n" + part
            seen = max(seen, 0) + len(part)
            for h in hashes:
                h.update(part)
            at = end
    if current is not None:
        yield done()


def file_digests(spark: SparkSession, path: str, whole: int = LARGEST_FILE) -> DataFrame:
    """(path, length, digest) of every file below ``path``.

    A file of up to ``whole`` bytes is one row. A larger one is read in splits of lines, which are brought together in order and
    hashed as a stream: a digest of a file is one chain, so one task ends it, but it holds no more than a batch of lines.
    Spark scans no empty file, so such a file has no row.
    """
    name = F.col("_metadata.file_path").alias("path")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.where(F.col("length") <= whole).select(name, "length", F.sha2("content", 256).alias("digest"))
    rows = spark.read.option("recursiveFileLookup", True).text(path, lineSep="\n").where(F.col("_metadata.file_size") > whole).select(
        name, F.col("_metadata.file_size").alias("length"), F.col("value").cast("binary").alias("line"),
        F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"))
    dealt = rows.repartition("path").sortWithinPartitions("path", "_split", "_id").select("path", "length", "line")
    return small.unionByName(dealt.mapInArrow(_streamed_digests, "path string, length bigint, digest string"))


def manifest_audit(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, digest) against the manifest (path, digest): missing, changed and unlisted ones."""
    listed = manifest.select("path", F.col("digest").alias("_listed"))
    joined = files.select("path", F.col("digest").alias("_found")).join(listed, "path", "full")
    problem = (
        F.when(F.col("_found").isNull(), "listed in manifest but missing")
        .when(F.col("_listed").isNull(), "not listed in manifest")
        .when(F.col("_found") != F.col("_listed"), "checksum differs from manifest")
    )
    return joined.select("path", problem.alias("problem")).where(F.col("problem").isNotNull())
