"""A data source for folders of incident files: ``spark.read.format("incident_folder")``.

A folder holds ``logs``, ``metrics``, ``incidents`` and ``postmortems``; a file belongs to the incident that its path below them
names (``logs/INC-001.jsonl``, ``logs/of=INC-001/part-0.txt``). Tasks are planned by file and offset: log and metric files are
read as lines, in ranges of bytes; records are read whole, many small files to a task. Files of other kinds and incidents
than asked for are left out at planning and never opened.

The files have to be on a store that Python reads: a local or shared folder, or one that ``pyarrow.fs`` knows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Kinds of files, and whether they are read by lines.
KINDS = {"logs": True, "metrics": True, "incidents": False, "postmortems": False}
#: Bytes of a task.
SPLIT_BYTES = 64 << 20
BATCH_ROWS = 4096
_ID = re.compile(r"(?:INC|HIST)-\d+")
_SCHEMA = pa.schema([("incident_id", pa.string()), ("kind", pa.string()), ("path", pa.string()), ("split", pa.int64()),
                     ("place", pa.int64()), ("value", pa.string())])


def _store(path: str):
    """(file system or None for a local one, path in it)."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return None, unquote(parts.path) if parts.scheme else path
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _files(path: str) -> Iterator[tuple[str, int]]:
    """(path, bytes) of all files below a folder, in order; hidden ones and marks of writers are left out."""
    store, root = _store(path)
    if store is None:
        for folder, folders, names in os.walk(root):
            folders.sort()
            yield from ((f"{folder}/{n}", os.path.getsize(f"{folder}/{n}")) for n in sorted(names) if n[0] not in "._")
        return
    from pyarrow import fs

    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    scheme = urlparse(path).scheme
    for info in sorted(found, key=lambda i: i.path):
        if info.is_file and info.base_name[0] not in "._":
            yield f"{scheme}://{info.path}", info.size


@contextmanager
def _opened(path: str):
    store, inner = _store(path)
    with open(inner, "rb") if store is None else store.open_input_file(inner) as file:
        yield file


class FolderPart(InputPartition):
    """Some files of one kind, each from a first to a last byte."""

    def __init__(self, kind: str, pieces: list[tuple[str, str, int, int]]):
        super().__init__((kind, pieces))
        self.kind, self.pieces = kind, pieces


class FolderReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int = SPLIT_BYTES, kinds: Iterable[str] = (), incidents: Iterable[str] = ()):
        self.path, self.split_bytes = path.rstrip("/"), split_bytes
        self.kinds, self.incidents = set(kinds) or set(KINDS), set(incidents)
        if self.kinds - set(KINDS):
            raise ValueError(f"unknown kinds: {sorted(self.kinds - set(KINDS))}")

    def partitions(self) -> list[FolderPart]:
        out = []
        for kind, by_lines in KINDS.items():
            if kind not in self.kinds:
                continue
            held, size = [], 0
            folder = f"{self.path}/{kind}"
            for path, length in _files(folder):
                found = _ID.search(path[path.rfind(f"/{kind}/"):])
                incident = found and found.group()
                if not length or self.incidents and incident not in self.incidents:
                    continue
                if by_lines and length > self.split_bytes:
                    out += [FolderPart(kind, [(path, incident, at, min(length, at + self.split_bytes))]) for at in range(0, length, self.split_bytes)]
                    continue
                if held and size + length > self.split_bytes:
                    out.append(FolderPart(kind, held))
                    held, size = [], 0
                held.append((path, incident, 0, length))
                size += length
            if held:
                out.append(FolderPart(kind, held))
        return out or [FolderPart("logs", [])]

    def read(self, partition: FolderPart) -> Iterator[pa.RecordBatch]:
        for path, incident, start, stop in partition.pieces:
            rows = _lines(path, start, stop) if KINDS[partition.kind] else _whole(path)
            place = 0
            for values in rows:
                n = len(values)
                yield pa.record_batch([[incident] * n, [partition.kind] * n, [path] * n, [start] * n, list(range(place, place + n)), values], schema=_SCHEMA)
                place += n


def _whole(path: str) -> Iterator[list[str]]:
    with _opened(path) as file:
        yield [file.read().decode(errors="replace")]


def _lines(path: str, start: int, stop: int) -> Iterator[list[str]]:
    """Lines that begin from byte ``start`` on and before ``stop``, some at a time."""
    with _opened(path) as file:
        at, held = start, []
        if start:
            file.seek(start - 1)
            at = start - 1 + len(file.readline())
        while at < stop:
            line = file.readline()
            if not line:
                break
            at += len(line)
            held.append(line.removesuffix(b"\n").removesuffix(b"\r").decode(errors="replace"))
            if len(held) == BATCH_ROWS:
                yield held
                held = []
        if held:
            yield held


class IncidentFolder(DataSource):
    """Options: ``path``; ``kinds`` and ``incidents``, comma-separated, all if empty; ``splitBytes`` for the bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "incident_folder"

    def schema(self) -> str:
        return "incident_id string, kind string, path string, split bigint, place bigint, value string"

    def reader(self, schema) -> FolderReader:
        kinds, incidents = (filter(None, self.options.get(name, "").split(",")) for name in ("kinds", "incidents"))
        return FolderReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)), kinds, incidents)


def read_folder(spark: SparkSession, path: str, kinds: Iterable[str] = (), incidents: Iterable[str] = (),
                split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Files of a folder as (incident_id, kind, path, split, place, value): a row per line, or per whole record.

    Kinds and incidents are options of the read and not conditions on its rows: Spark keeps one reader per read, so conditions
    pushed down from two branches of a plan would meet in it.
    """
    spark.dataSource.register(IncidentFolder)
    return (spark.read.format("incident_folder").option("splitBytes", split_bytes).option("kinds", ",".join(kinds))
            .option("incidents", ",".join(incidents)).load(path))


def numbered(rows: DataFrame) -> DataFrame:
    """(incident_id, path, line_no, line) of the rows of log or metric files; one row per split tells where its lines start."""
    splits = rows.groupBy("path", "split").agg(F.count("*").alias("_lines"))
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_lines").over(earlier), F.lit(0))).drop("_lines")
    return rows.join(splits, ["path", "split"]).select(
        "incident_id", "path", (F.col("_before") + F.col("place") + 1).alias("line_no"), F.col("value").alias("line"))


def documents_of(rows: DataFrame) -> DataFrame:
    """(path, stem, text) of the rows of whole records."""
    return rows.select("path", F.col("incident_id").alias("stem"), F.col("value").alias("text"))
