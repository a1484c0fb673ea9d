"""Evidence packs: the closed list of evidence a report on an incident may cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pyrewatch.functions.text import clip, fixed, squeeze
from pyrewatch.functions.times import iso_text
from pyrewatch.schemas import PACK

# Text limits.
SHORT, DETAIL = 240, 500


def _layout(df: DataFrame, source: Column, text: Column, at: Column) -> DataFrame:
    return df.select(
        "incident_id", "evidence_id", source.alias("source_type"), clip(text, SHORT).alias("short_description"),
        clip(text, DETAIL).alias("detail"), at.alias("timestamp")).select(*PACK.names)


def from_evidence(evidence: DataFrame) -> DataFrame:
    return _layout(evidence, F.col("source_type"), F.col("summary"), iso_text(F.col("timestamp")))


def _score() -> Column:
    return F.concat(F.lit(" (similarity "), fixed(F.col("score"), 3), F.lit("). "), squeeze(F.col("text")))


def from_history(hits: DataFrame) -> DataFrame:
    """Prior incidents. The text does not hold the stored cause, and the metadata is not copied."""
    rows = hits.select(F.col("query_id").alias("incident_id"), F.col("id").alias("evidence_id"), "score", "text", "metadata")
    text = F.concat(F.lit("Retrieved prior incident "), "evidence_id", _score())
    return _layout(rows, F.lit("HISTORICAL_INCIDENT"), text, F.coalesce(F.col("metadata")["date"], F.lit("")))


def from_notes(hits: DataFrame) -> DataFrame:
    rows = hits.select(F.col("query_id").alias("incident_id"), F.col("id").alias("evidence_id"), "score", "text", "metadata")
    section = F.coalesce(F.col("metadata")["section"], F.lit(""))
    text = F.concat(F.lit("Technical note "), "evidence_id", F.lit(", section "), section, _score())
    return _layout(rows, F.lit("TECHNICAL_DOCUMENT"), text, F.lit(""))


def evidence_pack(evidence: DataFrame, history: DataFrame, notes: DataFrame) -> DataFrame:
    """All citable evidence, one row per (incident, id)."""
    return from_evidence(evidence).unionByName(from_history(history)).unionByName(from_notes(notes))


_SECTIONS = (
    ("Metric evidence", ("ANOMALY_WINDOW", "METRIC_ANOMALY")),
    ("Log evidence", ("LOG",)),
    ("Earlier incidents, for comparison", ("HISTORICAL_INCIDENT",)),
    ("Technical notes", ("TECHNICAL_DOCUMENT",)),
)


def rendered_packs(pack: DataFrame, incidents: DataFrame, queries: DataFrame) -> DataFrame:
    """One text per incident: facts, the ids that may be cited, and the evidence by section.

    A text is the output itself, so its lines are gathered per incident; use the pack rows for anything larger.
    """
    def listed(kinds: tuple[str, ...] | None, line: Column) -> Column:
        place = F.lit(0)
        if kinds and len(kinds) > 1:
            place = F.when(F.col("source_type") == kinds[0], 0).otherwise(1)
        chosen = F.lit(True) if kinds is None else F.col("source_type").isin(*kinds)
        rows = F.array_sort(F.collect_list(F.when(chosen, F.struct(place.alias("p"), F.col("evidence_id").alias("e"), line.alias("t")))))
        return F.array_join(F.transform(rows, lambda r: r["t"]), "\n")

    allowed = F.concat(F.lit("- "), "evidence_id", F.lit(" ["), "source_type", F.lit("] "), "short_description")
    stamp = F.when(F.coalesce("timestamp", F.lit("")) != "", F.concat("timestamp", F.lit(" "))).otherwise("")
    detail = F.concat(F.lit("- "), "evidence_id", F.lit(" "), stamp, "detail")
    lists = pack.groupBy("incident_id").agg(
        listed(None, allowed).alias("_ids"),
        *[listed(kinds, detail).alias(f"_s{i}") for i, (_, kinds) in enumerate(_SECTIONS)])
    facts = [
        F.concat(F.lit(f"{name}: "), F.coalesce(F.col(name).cast("string"), F.lit("")))
        for name in ("incident_id", "service", "severity", "title", "description")]
    facts += [F.concat(F.lit("alert: "), iso_text(F.col("start_time")), F.lit(" to "), iso_text(F.col("end_time")),
                       F.lit(" ("), fixed(F.col("duration_minutes"), 1), F.lit(" min)"))]
    sections = [F.concat(F.lit(f"\n{head}:\n"), F.when(F.coalesce(f"_s{i}", F.lit("")) == "", "- none").otherwise(F.col(f"_s{i}")))
                for i, (head, _) in enumerate(_SECTIONS)]
    text = F.concat_ws("\n", *facts, F.concat(F.lit("\nCitable ids:\n"), F.coalesce("_ids", F.lit(""))), *sections,
                       F.concat(F.lit("\nSearch text:\n"), F.coalesce("_query", F.lit("(empty)"))))
    asked = queries.select(F.col("query_id").alias("incident_id"), F.col("text").alias("_query"))
    return incidents.join(lists, "incident_id", "left").join(asked, "incident_id", "left").select("incident_id", text.alias("text"))
