"""Message templates across incidents and scenarios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pyrewatch.functions.text import DESCRIPTION_WORDS, KEYWORDS, template_of
from pyrewatch.schemas import FAILURES, METRICS
from pyrewatch.session import cut_lineage


def incident_templates(logs: DataFrame, levels: tuple[str, ...] = ("WARN", "ERROR")) -> DataFrame:
    """Distinct (incident, template) of the given levels."""
    return logs.where(F.col("level").isin(*levels)).select(
        "incident_id", template_of(F.col("message")).alias("template")).distinct()


def template_coverage(logs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per failure scenario and template: share of its cases with the template, and cases outside."""
    seen = incident_templates(logs).join(labels.select("incident_id", "scenario"), "incident_id")
    inside = [F.count_if(F.col("scenario") == s).alias(f"_{s}") for s in FAILURES]
    counts = seen.groupBy("template").agg(F.count("*").alias("_all"), *inside)
    sizes = labels.groupBy("scenario").agg(F.count("*").alias("_size"))
    per = F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), F.col(f"_{s}").alias("n")) for s in FAILURES]))
    long = counts.select("template", "_all", per.alias("p")).select("template", "_all", "p.scenario", "p.n")
    # At most four rows: one per scenario.
    return long.join(F.broadcast(sizes.where(F.col("scenario").isin(*FAILURES))), "scenario").select(
        "scenario", "template", (F.col("n") / F.col("_size")).alias("coverage_in"), (F.col("_all") - F.col("n")).alias("cases_outside"))


def best_templates(coverage: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` best exclusive and the ``n`` most common templates of each scenario; ties go by template."""
    exclusive = coverage.where(F.col("cases_outside") == 0).withColumn("kind", F.lit("exclusive"))
    rows = exclusive.unionByName(coverage.withColumn("kind", F.lit("common")))
    order = Window.partitionBy("kind", "scenario").orderBy(F.desc("coverage_in"), "cases_outside", "template")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def template_totals(logs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per failure scenario: distinct ERROR templates and how many templates mark every case, or only its cases."""
    coverage = template_coverage(logs, labels).groupBy("scenario").agg(
        F.count_if(F.col("coverage_in") == 1).alias("in_every_case"),
        F.count_if((F.col("coverage_in") == 1) & (F.col("cases_outside") == 0)).alias("in_every_case_and_nowhere_else"))
    errors = incident_templates(logs, ("ERROR",)).join(labels.select("incident_id", "scenario"), "incident_id")
    distinct = errors.groupBy("scenario", "template").agg(F.count("*").alias("_n")).groupBy("scenario").agg(
        F.count("*").alias("unique_error_templates"))
    return coverage.join(distinct, "scenario", "left").na.fill(0, ["unique_error_templates"])


def _set_blocks(rows: int):
    """Consecutive sets of one scenario in blocks: their numbers and cases, their templates end to end, and all templates."""
    names = ["scenario", "block", "sigs", "cases", "sizes", "templates", "known"]

    def emit(scenario: str, number: int, sets: list[tuple]) -> pa.RecordBatch:
        flat = np.concatenate([np.array(x[2], np.int64) for x in sets])
        parts = [[x[0] for x in sets], [x[1] for x in sets], [len(x[2]) for x in sets], flat, np.unique(flat)]
        lists = [pa.array([np.asarray(part, np.int64)], pa.list_(pa.int64())) for part in parts]
        return pa.record_batch([pa.array([scenario]), pa.array([number]), *lists], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, current, held = TaskContext.get().partitionId() << 32, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["scenario"] != current or len(held) == rows):
                    yield emit(current, number, held)
                    number, held = number + 1, []
                current = row["scenario"]
                held.append((row["sig"], row["cases"], row["templates"]))
        if held:
            yield emit(current, number, held)
    return run


def _postings(sizes: np.ndarray, templates: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
    """Per wanted template the sets that hold it."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.searchsorted(wanted, templates)
    place[place == len(wanted)] = 0
    kept = wanted[place] == templates if len(wanted) else np.zeros(len(templates), bool)
    order = np.argsort(place[kept], kind="stable")
    return np.split(owner[kept][order], np.searchsorted(place[kept][order], np.arange(1, len(wanted))))


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum and maximum of the Jaccard scores of two blocks, counted along the posting lists of their common templates."""
    def numbers(batch: pa.RecordBatch, name: str, at: int) -> np.ndarray:
        return np.asarray(batch.column(name)[at].values, dtype=np.int64)

    for batch in batches:
        for at in range(batch.num_rows):
            (sizes, cases), (others, other_cases) = ([numbers(batch, f"{side}_{n}", at) for n in ("sizes", "cases")] for side in "ab")
            common = np.intersect1d(numbers(batch, "a_known", at), numbers(batch, "b_known", at), assume_unique=True)
            shared = np.zeros((len(sizes), len(others)), np.int32)
            for rows, columns in zip(_postings(sizes, numbers(batch, "a_templates", at), common),
                                     _postings(others, numbers(batch, "b_templates", at), common), strict=True):
                shared[np.ix_(rows, columns)] += 1
            if batch.column("same")[at].as_py():
                # Each pair of different sets of a block counts once.
                shared = np.triu(shared, 1)
            row, column = np.nonzero(shared)
            both = shared[row, column]
            score = both / (sizes[row] + others[column] - both)
            pairs = cases[row].astype(float) * other_cases[column]
            yield pa.record_batch([batch.column("scenario").slice(at, 1), pa.array([float((score * pairs).sum())]),
                                   pa.array([float(score.max(initial=0.0))])], names=["scenario", "_sum", "_max"])


def template_similarity(logs: DataFrame, labels: DataFrame, block_sets: int = 1024) -> DataFrame:
    """Mean and largest Jaccard similarity of the ERROR template sets of two cases of one failure scenario.

    Cases with equal sets are one row with a count, and pairs without a common template add to the number of pairs alone.
    Sets lie in blocks of similar ones; two blocks meet only if a template occurs in both, and there the overlaps are counted
    along posting lists. So no pair is a row, and the work follows the pairs that overlap.
    """
    chosen = labels.where(F.col("scenario").isin(*FAILURES)).select("incident_id", "scenario")
    rows = incident_templates(logs, ("ERROR",)).join(chosen, "incident_id")
    per_case = rows.groupBy("scenario", "incident_id").agg(F.sort_array(F.collect_set(F.xxhash64("template"))).alias("templates"))
    sets = cut_lineage(per_case.withColumn("sig", F.xxhash64("templates")).groupBy("scenario", "sig").agg(
        F.count("*").alias("cases"), F.first("templates").alias("templates")))
    near = sets.repartitionByRange("scenario", "templates").sortWithinPartitions("scenario", "templates")
    longs = ", ".join(f"{n} array<bigint>" for n in ("sigs", "cases", "sizes", "templates", "known"))
    blocks = cut_lineage(near.mapInArrow(_set_blocks(block_sets), f"scenario string, block bigint, {longs}"))
    postings = blocks.select("scenario", F.explode("known").alias("template"), "block")
    others = postings.withColumnRenamed("block", "other")
    pairs = postings.join(others, ["scenario", "template"]).where("block <= other").groupBy("block", "other").agg(F.first("scenario").alias("scenario"))
    kept = ("sizes", "cases", "templates", "known")
    left = blocks.select("block", *[F.col(n).alias(f"a_{n}") for n in kept])
    right = blocks.select(F.col("block").alias("other"), *[F.col(n).alias(f"b_{n}") for n in kept])
    met = pairs.join(left, "block").join(right, "other").withColumn("same", F.col("block") == F.col("other"))
    scores = met.drop("block", "other").mapInArrow(_overlaps, "scenario string, _sum double, _max double")
    n = F.col("cases")
    totals = sets.groupBy("scenario").agg(
        F.sum(n).alias("_n"), F.sum(n * (n - 1) / 2).alias("_equal"), F.max(n).alias("_most"))
    count = (F.col("_n") * (F.col("_n") - 1) / 2).cast("long")
    best = F.greatest(F.coalesce("_best", F.lit(0.0)), F.when(F.col("_most") > 1, 1.0).otherwise(0.0))
    found = totals.join(scores.groupBy("scenario").agg(F.sum("_sum").alias("_total"), F.max("_max").alias("_best")), "scenario", "left")
    return found.select("scenario", F.try_divide(F.coalesce("_total", F.lit(0.0)) + F.col("_equal"), count).alias("mean_similarity"),
                        best.alias("max_similarity"), count.alias("pairs"))


def keyword_presence(logs: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of each scenario's cases with a WARN or ERROR line that matches the keyword."""
    loud = logs.where(F.col("level").isin("WARN", "ERROR"))
    names = list(KEYWORDS)
    hits = loud.groupBy("incident_id").agg(*[
        F.bool_or(F.col("message").rlike(p)).alias(f"k{i}") for i, p in enumerate(KEYWORDS.values())])
    cases = labels.select("incident_id", "scenario").join(hits, "incident_id", "left")
    shares = cases.groupBy("scenario").agg(*[
        F.avg(F.coalesce(F.col(f"k{i}"), F.lit(False)).cast("int")).alias(f"k{i}") for i in range(len(names))])
    pairs = F.explode(F.array(*[
        F.struct(F.lit(n).alias("keyword"), F.col(f"k{i}").alias("share")) for i, n in enumerate(names)]))
    return shares.select("scenario", pairs.alias("p")).select("scenario", "p.keyword", "p.share")


def description_words(incidents: DataFrame, labels: DataFrame) -> DataFrame:
    """How many titles and descriptions of a scenario hold each word."""
    text = F.lower(F.concat_ws(" ", "title", "description"))
    rows = incidents.select("incident_id", text.alias("_text")).join(labels.select("incident_id", "scenario"), "incident_id")
    words = F.explode(F.array(*[
        F.struct(F.lit(w).alias("word"), F.col("_text").contains(w).alias("hit")) for w in DESCRIPTION_WORDS]))
    return rows.select("scenario", words.alias("w")).groupBy("scenario", "w.word").agg(F.count_if("w.hit").alias("cases"))


def shared_metric_rows(metrics: DataFrame) -> DataFrame:
    """Metric rows (service and all values) that appear in more than one incident; nulls are equal."""
    per = metrics.groupBy("service", *METRICS, "incident_id").agg(F.count("*").alias("_n"))
    return per.groupBy("service", *METRICS).agg(F.count("*").alias("incidents")).where(F.col("incidents") > 1)


def level_mix(logs: DataFrame, labels: DataFrame, least_info: float = 0.4) -> DataFrame:
    """Per case: shares of the levels, and the problems of its mix."""
    counts = logs.groupBy("incident_id").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("level") == v).alias(v.lower()) for v in ("INFO", "WARN", "ERROR")])
    rows = counts.join(labels.select("incident_id", "scenario"), "incident_id")
    failure = F.col("scenario").isin(*FAILURES)
    found = F.array_compact(F.array(
        F.when(F.col("info") == 0, "no INFO"),
        F.when(failure & ((F.col("error") == 0) | (F.col("warn") == 0)), "failure without WARN or ERROR"),
        F.when(failure & (F.col("info") / F.greatest(F.lit(1), F.col("n")) < least_info), "too few INFO"),
        F.when(~failure & (F.col("warn") == 0), "normal without WARN")))
    return rows.withColumn("problems", found)

