"""Corpora for retrieval: postmortems as search text, markdown notes as chunks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pyrewatch import schemas as S
from pyrewatch.functions.evaluate import once
from pyrewatch.functions.text import LABEL_LEAK, RELATIVE_TIME, stripped
from pyrewatch.operators.quality import flagged, problems, union

# Chunk sizes in characters.
SHORT_CHUNK = 280
LONG_CHUNK = 1800
_STRINGS = "array<string>"


def _bullets(head: str, items: Column) -> Column:
    lines = F.transform(F.coalesce(items, F.array().cast(_STRINGS)), lambda x: F.concat(F.lit("- "), x))
    return F.concat(F.array(F.lit(head)), lines)


def postmortem_text() -> Column:
    """Search text of a postmortem in a fixed section order; the stated cause is left out."""
    def field(label: str, name: str) -> Column:
        return F.concat(F.lit(label), F.coalesce(F.col(name).cast("string"), F.lit("")))

    def joined(label: str, name: str) -> Column:
        some = F.size(F.coalesce(F.col(name), F.array().cast(_STRINGS))) > 0
        return F.array_compact(F.array(F.when(some, F.concat(F.lit(label), F.array_join(name, ", ")))))

    steps = F.transform("timeline", lambda x: F.concat(
        F.coalesce(x["relative_time"], F.lit("")), F.lit(": "), F.coalesce(x["event"], F.lit(""))))
    head = F.array(
        field("Incident ", "incident_id"), field("Title: ", "title"), field("Service: ", "service"),
        field("Severity: ", "severity"), field("Duration minutes: ", "duration_minutes"), field("When: ", "occurred_at"))
    lines = F.concat(
        head, joined("Affected services: ", "affected_services"), _bullets("Symptoms:", F.col("symptoms")),
        _bullets("Observed signals:", F.col("observed_signals")), _bullets("Timeline:", steps),
        _bullets("Contributing factors:", F.col("contributing_factors")), _bullets("Resolution:", F.col("resolution")),
        _bullets("Lessons learned:", F.col("lessons_learned")), joined("Tags: ", "tags"))
    return F.concat(stripped(F.array_join(lines, "\n")), F.lit("\n"))


def postmortem_documents(postmortems: DataFrame) -> DataFrame:
    """(id, text, metadata) per postmortem; blank metadata is dropped."""
    def text(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    def entry(key, value):
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    pairs = F.array_compact(F.array(
        entry("incident_id", text("incident_id")), entry("service", text("service")), entry("date", text("occurred_at")),
        entry("source_type", F.lit("historical_incident")), entry("severity", text("severity")),
        entry("duration_minutes", F.coalesce(F.col("duration_minutes"), F.lit(0)).cast("string")),
        F.when(text("root_cause") != "", entry("historical_root_cause", text("root_cause"))),
        F.when(text("root_cause_service") != "", entry("historical_root_cause_service", text("root_cause_service"))),
    ))
    return postmortems.select(
        F.col("incident_id").alias("id"), postmortem_text().alias("text"), F.map_from_entries(pairs).alias("metadata"))


def leaking_documents(documents: DataFrame) -> DataFrame:
    """Documents whose text holds their own stored cause."""
    cause = F.col("metadata")["historical_root_cause"]
    return documents.where(F.coalesce(F.col("text").contains(cause), F.lit(False)))


class _Chunks:
    """The chunks of one document, closed one after another; two pieces are held at most.

    Short pieces run into the next one, and a short last piece goes back to the one before.
    """

    def __init__(self, least: int):
        self.least = least
        self.ready: tuple[str, list[str]] | None = None
        self.now: tuple[str, list[str]] | None = None
        self.size = 0

    def add(self, section: str, body: str) -> tuple[str, str] | None:
        """Take a piece; the chunk that is certain now, if any."""
        if self.now is not None and self.size < self.least:
            self.now = (f"{self.now[0]} / {section}", [*self.now[1], body])
            self.size += 2 + len(body)
            return None
        closed, self.ready = self.ready, self.now
        self.now, self.size = (section, [body]), len(body)
        return self._text(closed)

    def rest(self) -> list[tuple[str, str]]:
        if self.now is not None and self.ready is not None and self.size < self.least:
            self.now = (f"{self.ready[0]} / {self.now[0]}", [*self.ready[1], *self.now[1]])
            self.ready = None
        return [self._text(held) for held in (self.ready, self.now) if held is not None]

    @staticmethod
    def _text(held: tuple[str, list[str]] | None) -> tuple[str, str] | None:
        return held and (held[0], "\n\n".join(held[1]))


def _groups(body: str, limit: int) -> Iterator[str]:
    """A body that is not too long, or its paragraphs in groups of at most ``limit`` characters."""
    paragraphs = [body] if len(body) <= limit else [p for p in map(str.strip, body.split("\n\n")) if p] or [body]
    held, size = [], 0
    for paragraph in paragraphs:
        if held and size + 2 + len(paragraph) > limit:
            yield "\n\n".join(held)
            held, size = [], 0
        size += len(paragraph) + (2 if held else 0)
        held.append(paragraph)
    yield "\n\n".join(held)


def _sections(text: str) -> Iterator[tuple[str, str]]:
    """(section, body) after each ``## `` heading; what stands before the first one is dropped."""
    text = "\n" + text
    at = text.find("\n## ")
    while at >= 0:
        end = text.find("\n## ", at + 4)
        heading, _, body = text[at + 4: end if end >= 0 else len(text)].partition("\n")
        yield heading.strip(), body.strip()
        at = end


def _pieces(text: str, limit: int) -> Iterator[tuple[str, str]]:
    for section, body in _sections(text):
        first, number = None, 1
        for group in _groups(body, limit):
            if first is None:
                first = group
                continue
            if number == 1:
                yield f"{section} (part 1)", first
            number += 1
            yield f"{section} (part {number})", group
        if number == 1:
            yield section, first


def _chunked(limit: int, least: int):
    """One row per chunk of each document, in rows of a bounded number of chunks."""
    names = ["document_name", "_stem", "_title", "_at", "_section", "_body"]

    def chunks(text: str) -> Iterator[tuple[str, str]]:
        found = _Chunks(least)
        for section, body in _pieces(text, limit):
            closed = found.add(section, body)
            if closed:
                yield closed
        yield from found.rest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                name, stem, title, text = (column[at].as_py() for column in batch.columns)
                for start, part in enumerate(batched(chunks(text or ""), 1000)):
                    n = len(part)
                    yield pa.record_batch(
                        [pa.array([name] * n, pa.string()), pa.array([stem] * n, pa.string()), pa.array([title] * n, pa.string()),
                         pa.array(range(1000 * start, 1000 * start + n), pa.int32()), pa.array([s for s, _ in part], pa.string()),
                         pa.array([b for _, b in part], pa.string())], names=names)
    return run


def chunk_markdown(notes: DataFrame, limit: int = LONG_CHUNK, least: int = SHORT_CHUNK) -> DataFrame:
    """Chunks of markdown documents (document_name, text).

    Where a chunk ends depends on the one before, so a document is cut by one task, in one pass: its time is linear in the text,
    and beside the text no more than two chunks are held.
    """
    text = stripped(F.replace("text", F.lit("\r\n"), F.lit("\n")))
    stem = F.regexp_replace("document_name", r"\.[^.]*$", "")
    heading = F.regexp_extract(F.concat(F.lit("\n"), F.col("_text")), r"\n# ([^\n]*)", 1)
    has_title = F.col("_text").rlike(r"(^|\n)# ")
    rows = once(notes.select("document_name", "text"), "_text", text).select("document_name", stem.alias("_stem"), F.when(
        has_title, stripped(heading)).otherwise(stem).alias("_title"), "_text")
    rows = rows.mapInArrow(_chunked(limit, least), "document_name string, _stem string, _title string, _at int, _section string, _body string")
    number = F.col("_at") + 1
    digits = F.when(number > 999, number.cast("string")).otherwise(F.lpad(number.cast("string"), 3, "0"))
    body = F.concat(F.lit("Document: "), "_title", F.lit("\nSection: "), F.col("_section"), F.lit("\n\n"), stripped(F.col("_body")), F.lit("\n"))
    identity = F.concat_ws("_", "_stem", digits)
    return rows.select(
        identity.alias("id"), body.alias("text"), F.col("_at").alias("position"), F.create_map(
            F.lit("document_id"), identity, F.lit("document_name"), F.col("document_name"),
            F.lit("section"), F.col("_section"), F.lit("source_type"), F.lit("technical_document")).alias("metadata"))


def corpus_problems(postmortems: DataFrame, incidents: DataFrame, cutoff, cases_per_cause: int = 10) -> DataFrame:
    """Corpus checks: ids, balance, list sizes, dates, step times, labels in the narrative, copies of incidents."""
    case = F.col("incident_id")
    least = {"symptoms": 3, "observed_signals": 3, "timeline": 3, "contributing_factors": 1, "resolution": 1,
             "lessons_learned": 1, "tags": 2}
    balance = postmortems.groupBy("root_cause").count()
    titles = postmortems.groupBy("title").agg(F.count("*").alias("n"), F.min("incident_id").alias("incident_id"))
    symptoms = postmortems.groupBy("symptoms").agg(F.count("*").alias("n"), F.min("incident_id").alias("incident_id"))
    narrative = F.concat_ws(" ", "title", F.array_join("symptoms", " "), F.array_join("observed_signals", " "),
                            F.array_join("contributing_factors", " "))
    return union([
        flagged(postmortems, {
            "unknown cause": ~F.coalesce(F.col("root_cause").isin(*S.FAILURES), F.lit(False)),
            "unknown severity": ~F.coalesce(F.col("severity").isin(*S.SEVERITIES), F.lit(False)),
            "too short": F.coalesce(F.col("duration_minutes"), F.lit(0)) < 10,
            **{f"too few {c}": F.coalesce(F.size(c), F.lit(0)) < n for c, n in least.items()},
            "bad step time": ~F.forall("timeline", lambda x: F.coalesce(x["relative_time"].rlike(RELATIVE_TIME), F.lit(False))),
            "not before the cutoff": ~(F.col("occurred_at").cast("timestamp_ntz") < F.lit(cutoff)),
            "label in narrative": narrative.rlike(LABEL_LEAK),
        }, case),
        problems(balance, "unbalanced cause", F.col("count") != cases_per_cause, F.concat_ws(
            "=", F.coalesce("root_cause", F.lit("none")), F.col("count").cast("string"))),
        problems(titles, "repeated title", F.col("n") > 1, case),
        problems(symptoms, "repeated symptoms", F.col("n") > 1, case),
        problems(postmortems.join(incidents.select("incident_id"), "incident_id", "left_semi"), "id of an incident", F.lit(True), case),
        problems(postmortems.join(incidents.select("title"), "title", "left_semi"), "title of an incident", F.lit(True), case),
    ])


CORPUS_CHECKS = [
    "unknown cause", "unknown severity", "too short", "too few symptoms", "too few observed_signals", "too few timeline",
    "too few contributing_factors", "too few resolution", "too few lessons_learned", "too few tags", "bad step time",
    "not before the cutoff", "label in narrative", "unbalanced cause", "repeated title", "repeated symptoms",
    "id of an incident", "title of an incident",
]
