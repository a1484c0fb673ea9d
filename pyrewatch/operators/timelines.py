"""Reports over finished timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pyrewatch.functions.times import step_of
from pyrewatch.operators.correlate import source_rank, title
from pyrewatch.operators.ordered import with_row_number

# Evidence that counts as a change.
CHANGE_EVIDENCE = ("DEPLOYMENT_EVENT", "CHANGE_EVENT", "RESTART_EVENT")


def category() -> Column:
    kind, source = F.col("evidence_type"), F.col("source_type")
    return (
        F.when((kind == "ANOMALY_WINDOW") | (source == "ANOMALY_WINDOW"), "window")
        .when((kind == "ANOMALY") | (source == "METRIC_ANOMALY"), "anomaly")
        .when(kind.isin(*CHANGE_EVIDENCE), "change")
        .otherwise("log")
    )


def with_titles(evidence: DataFrame, events: DataFrame) -> DataFrame:
    """Titles of timeline rows by id; the summary where the timeline has no such row."""
    titles = events.select("incident_id", "evidence_id", F.col("title").alias("_title"))
    joined = evidence.join(titles, ["incident_id", "evidence_id"], "left")
    return joined.withColumn("title", F.coalesce("_title", "summary")).drop("_title")


def with_boundaries(evidence: DataFrame, incidents: DataFrame) -> DataFrame:
    """Evidence rows plus the alert's start and end; at one instant the start leads and the end closes."""
    items = evidence.select(
        "incident_id", F.col("evidence_id").alias("id"), title().alias("label"), "timestamp", category().alias("category"),
        F.lit(1).alias("_side"), source_rank(F.col("source_type")).alias("_rank"), "service",
    )
    marks = F.explode(F.array(*[
        F.struct(F.lit(id_).alias("id"), F.lit(label).alias("label"), F.col(at).alias("timestamp"), F.lit(side).alias("_side"))
        for id_, label, at, side in (("alert-start", "Alert start", "start_time", 0), ("alert-end", "Alert end", "end_time", 2))
    ]))
    edges = incidents.select("incident_id", marks.alias("m")).select(
        "incident_id", "m.id", "m.label", "m.timestamp", F.lit("boundary").alias("category"), "m._side",
        F.lit(0).alias("_rank"), F.lit("").alias("service"),
    )
    rows = items.unionByName(edges)
    order = ["timestamp", "_side", "_rank", "service", "id"]
    return with_row_number(rows, ["incident_id"], step_of(F.col("timestamp"), 1), order, "position").drop(
        "_side", "_rank", "service")


def totals(evidence: DataFrame, incidents: DataFrame) -> DataFrame:
    """Items and incidents overall, by source and by service, and the incidents without evidence."""
    n_incidents = incidents.agg(F.count("*")).scalar()
    small = evidence.groupBy("incident_id", "source_type", "service").agg(F.count("*").alias("_items"))
    scope = F.explode(F.array(
        F.struct(F.lit("all").alias("scope"), F.lit("items").alias("name")),
        F.struct(F.lit("source").alias("scope"), F.col("source_type").alias("name")),
        F.struct(F.lit("service").alias("scope"), F.col("service").alias("name")),
    ))
    counted = small.select("incident_id", "_items", scope.alias("s")).groupBy("s.scope", "s.name").agg(
        F.sum("_items").alias("items"), F.countDistinct("incident_id").alias("incidents"))
    averaged = counted.select(
        "scope", "name", "items", "incidents", (F.col("items") / n_incidents).alias("per_incident"))
    empty = incidents.select("incident_id").join(evidence.select("incident_id"), "incident_id", "left_anti").select(
        F.lit("empty").alias("scope"), F.col("incident_id").alias("name"), F.lit(0).cast("long").alias("items"),
        F.lit(0).cast("long").alias("incidents"), F.lit(0.0).alias("per_incident"))
    return averaged.unionByName(empty)
