"""Whole-dataset summaries and variation checks."""

from __future__ import annotations

import operator
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pyrewatch.functions.times import minutes_between
from pyrewatch.operators.quality import flagged
from pyrewatch.operators.templates import incident_templates
from pyrewatch.schemas import FAILURES, LEVELS, METRICS


def dataset_summary(incidents: DataFrame, labels: DataFrame, metrics: DataFrame, logs: DataFrame) -> DataFrame:
    """(section, name, value) counts: cases per scenario, raw log levels, rows, blanks per metric."""
    def rows(df, section, name, value):
        return df.select(F.lit(section).alias("section"), name.alias("name"), value.cast("long").alias("value"))
    level = F.when(F.col("raw_level").isin(*LEVELS), F.col("raw_level")).otherwise("other")
    by_level = logs.groupBy(level.alias("l")).count()
    blanks = metrics.agg(*[F.count_if(F.col(m).isNull()).alias(m) for m in METRICS], F.count("*").alias("rows"))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("n"), F.col(c).alias("v")) for c in (*METRICS, "rows")]))
    return (
        rows(labels.groupBy("scenario").count(), "cases", F.col("scenario"), F.col("count"))
        .unionByName(rows(by_level, "log level", F.col("l"), F.col("count")))
        .unionByName(rows(blanks.select(pairs.alias("p")), "blank", F.col("p.n"), F.col("p.v")))
        .unionByName(rows(incidents.agg(F.count("*").alias("c")), "cases", F.lit("all"), F.col("c")))
    )


def blank_services(metrics: DataFrame) -> DataFrame:
    """Services with blanks, per metric."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric_name"), F.col(m).isNull().alias("blank")) for m in METRICS]))
    rows = metrics.select("service", pairs.alias("p")).where("p.blank").groupBy("p.metric_name", "service").count()
    return rows.groupBy("metric_name").agg(F.array_sort(F.collect_set("service")).alias("services"))


def date_range(incidents: DataFrame) -> DataFrame:
    return incidents.agg(F.min("window_start").alias("first"), F.max("window_end").alias("last"))


def log_profile(logs: DataFrame) -> DataFrame:
    """Per incident: lines, levels, services, and event types by count, then name."""
    counts = logs.groupBy("incident_id", "service", "level", "event_type").agg(F.count("*").alias("_n"))
    by_type = counts.groupBy("incident_id", "event_type").agg(F.sum("_n").alias("_n")).groupBy("incident_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("a"), F.col("event_type").alias("b")))).alias("_types"))
    totals = counts.groupBy("incident_id").agg(
        F.sum("_n").alias("line_count"),
        *[F.coalesce(F.sum(F.when(F.col("level") == v, F.col("_n"))), F.lit(0)).alias(f"{v.lower()}_lines") for v in LEVELS],
        F.array_sort(F.collect_set("service")).alias("log_services"))
    named = F.transform("_types", lambda t: F.struct(t["b"].alias("name"), (-t["a"]).alias("count")))
    return totals.join(by_type, "incident_id").withColumn("event_types", named).drop("_types")


def metric_profile(metrics: DataFrame) -> DataFrame:
    """Per incident: rows, services, and the series that have any value, by service and metric order."""
    rows = metrics.groupBy("incident_id", "service").agg(
        F.count("*").alias("_n"), *[F.count(m).alias(m) for m in METRICS])
    present = F.array_compact(F.array(*[F.when(F.col(m) > 0, F.concat_ws(":", "service", F.lit(m))) for m in METRICS]))
    lists = F.array_sort(F.collect_list(F.struct("service", present.alias("names"))))
    return rows.groupBy("incident_id").agg(
        F.sum("_n").alias("row_count"), F.array_sort(F.collect_set("service")).alias("metric_services"),
        F.flatten(F.transform(lists, lambda s: s["names"])).alias("series"))


def describe(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """min, max, mean, sample std, n and coefficient of variation of several columns; nulls are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names]))
    return rows.select(*keys, pairs.alias("p")).where("p.value IS NOT NULL").groupBy(*keys, "p.name").agg(
        F.min("p.value").alias("min"), F.max("p.value").alias("max"), F.avg("p.value").alias("mean"),
        F.stddev_samp("p.value").alias("std"), F.count("p.value").alias("n"),
        F.try_divide(F.stddev_samp("p.value"), F.avg("p.value")).alias("cv"))


def severity_mix(cases: DataFrame) -> DataFrame:
    return cases.groupBy("scenario").pivot("severity", ["LOW", "MEDIUM", "HIGH", "CRITICAL"]).count().na.fill(0)


def start_variation(cases: DataFrame) -> DataFrame:
    """Dates, distinct starts and hours of day per scenario."""
    start = F.col("start_time")
    return cases.groupBy("scenario").agg(
        F.min(start.cast("date")).alias("first_date"), F.max(start.cast("date")).alias("last_date"),
        F.countDistinct("start_time").alias("unique_starts"), F.array_sort(F.collect_set(F.hour(start))).alias("start_hours"))


def value_counts(cases: DataFrame, names: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in names]))
    return cases.select("scenario", pairs.alias("p")).where("p.value IS NOT NULL").groupBy(
        "scenario", "p.field", "p.value").agg(F.count("*").alias("cases"))


def variation_problems(cases: DataFrame, metrics: DataFrame, logs: DataFrame, least_cv: float = 0.1,
                       least_unique: float = 0.8) -> DataFrame:
    """Failure scenarios whose cases look too much alike."""
    failures = cases.where(F.col("scenario").isin(*FAILURES))
    alert = failures.select("incident_id", "service", "start_time", "end_time")
    peaks = metrics.join(alert, ["incident_id", "service"]).where(
        F.col("timestamp").between(F.col("start_time"), F.col("end_time"))).groupBy("incident_id").agg(
        F.max("error_rate").alias("_error"), F.max("latency_ms").alias("_latency"))
    # An error set is told apart by the sum and the xor of its templates' hashes, so no set is collected.
    sets = incident_templates(logs, ("ERROR",)).groupBy("incident_id").agg(
        F.concat_ws(":", F.count("*"), F.bit_xor(F.xxhash64("template")),
                    F.sum(F.xxhash64(F.lit("s"), "template").cast("decimal(38,0)"))).alias("_set"))
    lines = logs.groupBy("incident_id").agg(F.count("*").alias("_lines"))
    rows = failures.join(peaks, "incident_id", "left").join(sets, "incident_id", "left").join(lines, "incident_id", "left")
    rows = rows.na.fill(0, ["_error", "_latency", "_lines"]).na.fill("none", ["_set"])

    def cv(name: str) -> Column:
        return F.coalesce(F.try_divide(F.stddev_pop(name), F.avg(name)), F.lit(0.0))

    found = rows.groupBy("scenario").agg(
        F.count("*").alias("cases"), F.countDistinct(F.struct("service", "root_cause_service")).alias("pairs"),
        F.countDistinct("severity").alias("severities"), F.countDistinct("duration_minutes").alias("durations"),
        F.countDistinct("start_time").alias("starts"), cv("_error").alias("error_cv"), cv("_latency").alias("latency_cv"),
        cv("_lines").alias("lines_cv"), F.try_divide(F.countDistinct("_set"), F.count("_set")).alias("unique_sets"))
    return flagged(found, {
        "same services": F.col("pairs") < 2, "same severity": F.col("severities") < 2,
        "same durations": F.col("durations") < 0.8 * F.col("cases"), "same starts": F.col("starts") != F.col("cases"),
        **{f"{c} too even": F.col(c) < least_cv for c in ("error_cv", "latency_cv", "lines_cv")},
        "same error sets": F.coalesce(F.col("unique_sets"), F.lit(0.0)) < least_unique,
    }, F.col("scenario"))


VARIATION_CHECKS = ["same services", "same severity", "same durations", "same starts", "error_cv too even",
                    "latency_cv too even", "lines_cv too even", "same error sets"]


def signature_problems(measured: DataFrame, shapes: DataFrame, cases: DataFrame, runs: DataFrame) -> DataFrame:
    """Cases whose metrics do not follow their scenario, or normal cases that do not stay calm.

    ``runs`` has the longest run of error rates above 5% and the highest utilization per incident.
    """
    rows = cases.join(measured, "incident_id").join(shapes, "incident_id", "left").join(runs, "incident_id", "left")
    db, leak, downstream = FAILURES
    scenario, normal = F.col("scenario"), F.col("scenario") == "NORMAL"
    top = F.col("base_memory_usage") + F.col("mem_rise")
    grown = (top >= 80) & (F.col("mem_rise") >= 15)
    return flagged(rows, {
        "sustained errors": normal & (F.col("longest_run") >= 3),
        "saturated pool": normal & (F.col("max_db_util") >= 90),
        "no visible impact": ~normal & (F.col("reported_error_delta") < 0.5) & (F.col("reported_latency_ratio") < 1.5),
        "pool does not saturate": (scenario == db) & (
            (F.col("peak_db_connection_utilization") < 90) | (F.col("base_db_connection_utilization") > 75)),
        "memory does not grow": (scenario == leak) & ((top < 80) | (F.col("mem_rise") < 15)),
        "memory jumps": (scenario == leak) & grown & (F.col("largest_step") > 0.3 * F.col("mem_rise")),
        "downstream latency flat": (scenario == downstream) & F.coalesce(F.col("reported_ds_ratio") < 2.5, F.lit(True)),
        "local memory moves": (scenario == downstream) & (F.col("reported_memory_delta") > 10),
    }, F.col("incident_id"))


SIGNATURE_CHECKS = ["sustained errors", "saturated pool", "no visible impact", "pool does not saturate",
                    "memory does not grow", "memory jumps", "downstream latency flat", "local memory moves"]


# The published patterns of each scenario as (name, tests); a test is a measure, a relation and a limit,
# which is a number or another measure.
SCENARIO_PATTERNS = {
    "DB_CONNECTION_POOL_EXHAUSTION": (
        ("db util baseline <= 75% and peak >= 90%", ("base_db_connection_utilization", "<=", 75), ("peak_db_connection_utilization", ">=", 90)),
        ("latency peak >= 2x baseline", ("latency_ratio", ">=", 2)),
        ("error rate rises >= 1 pp", ("error_delta", ">=", 1)),
        ("timeout-related WARN/ERROR rate higher than baseline", ("timeout_per_min_incident", ">", "timeout_per_min_baseline")),
        ("CPU ratio smaller than DB-util ratio and latency ratio", ("cpu_ratio", "<", "db_ratio"), ("cpu_ratio", "<", "latency_ratio")),
        ("CPU peak/baseline >= 2 (CPU strongly elevated)", ("cpu_ratio", ">=", 2)),
        ("memory change within +/-5 pp", ("memory_change", "<=", 5), ("memory_change", ">=", -5)),
    ),
    "MEMORY_LEAK": (
        ("memory rises >= 15 pp", ("mem_rise", ">=", 15)),
        ("leak phase linear-fit R^2 >= 0.9 (gradual trend)", ("linear_r2", ">=", 0.9)),
        ("largest 1-min step < 10% of total rise (no single jump)", ("max_step_share", "<", 0.1)),
        ("latency peak >= 1.5x baseline", ("latency_ratio", ">=", 1.5)),
        ("Spearman(memory, latency) >= 0.5 during fault..end", ("spearman", ">=", 0.5)),
        ("error rate rises >= 1 pp", ("error_delta", ">=", 1)),
        ("error onset after memory onset", ("onset_error", ">", "onset_primary")),
        ("db util peak < 60%", ("peak_db_connection_utilization", "<", 60)),
    ),
    "DOWNSTREAM_SERVICE_TIMEOUT": (
        ("reported service downstream p95 >= 2.5x baseline", ("reported_ds_ratio", ">=", 2.5)),
        ("timeout-related WARN/ERROR rate higher than baseline", ("timeout_per_min_incident", ">", "timeout_per_min_baseline")),
        ("reported service error rate rises >= 1 pp", ("reported_error_delta", ">=", 1)),
        ("focus CPU peak/baseline < 1.3", ("cpu_ratio", "<", 1.3)),
        ("focus memory change < 5 pp", ("memory_change", "<", 5)),
        ("focus db util peak < 90% (no pool saturation)", ("db_peak_or_none", "<", 90)),
    ),
    "NORMAL": (
        ("no service with error rate > 2% for >= 1 min", ("longest_error_run", "=", 0)),
        ("no DB utilization >= 90%", ("max_db_util", "<", 90)),
        ("WARN logs present", ("warn_logs", ">", 0)),
        ("latency fluctuates (CV > 0.05 on alerting service)", ("latency_cv", ">", 0.05)),
    ),
}
_RELATIONS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "=": operator.eq}


def _holds(tests: Iterable[tuple]) -> Column:
    """Whether all tests of a pattern hold; an unknown measure fails."""
    each = [_RELATIONS[relation](F.col(measure), F.col(limit) if isinstance(limit, str) else F.lit(limit))
            for measure, relation, limit in tests]
    return F.coalesce(reduce(operator.and_, each), F.lit(False))


def scenario_checks(measured: DataFrame, cases: DataFrame, rates: DataFrame, shapes: DataFrame, correlation: DataFrame,
                    onset: DataFrame, normals: DataFrame) -> DataFrame:
    """How many cases of a scenario show each published pattern, as ``k/n``."""
    wide = onset.groupBy("incident_id").pivot("signal", ["primary", "latency", "error"]).agg(F.first("onset"))
    wide = wide.withColumnsRenamed({s: f"onset_{s}" for s in ("primary", "latency", "error")})
    rows = cases.select("incident_id", "scenario")
    for side in (measured, rates, shapes, correlation, wide):
        rows = rows.join(side, "incident_id", "left")
    rows = rows.join(normals.drop("warn_logs", "error_logs", "warn_per_min"), "incident_id", "left").withColumns({
        "memory_change": F.col("peak_memory_usage") - F.col("base_memory_usage"),
        "db_peak_or_none": F.coalesce("peak_db_connection_utilization", F.lit(0.0))})
    hits = F.lit(None).cast("array<struct<pattern:string,hit:boolean>>")
    for scenario, patterns in SCENARIO_PATTERNS.items():
        pairs = F.array(*[F.struct(F.lit(name).alias("pattern"), _holds(tests).alias("hit")) for name, *tests in patterns])
        hits = F.when(F.col("scenario") == scenario, pairs).otherwise(hits)
    counts = rows.select("scenario", F.explode(hits).alias("h")).groupBy("scenario", "h.pattern").agg(
        F.count_if("h.hit").alias("k"), F.count("*").alias("n"))
    names = [(scenario, name) for scenario, patterns in SCENARIO_PATTERNS.items() for name, *_ in patterns]
    listed = cases.sparkSession.createDataFrame(names, "scenario string, pattern string")
    share = F.concat_ws("/", F.coalesce("k", F.lit(0)).cast("string"), F.coalesce("n", F.lit(0)).cast("string"))
    return listed.join(counts, ["scenario", "pattern"], "left").select("scenario", "pattern", share.alias("share"))


def minute_histogram(logs: DataFrame, cases: DataFrame) -> DataFrame:
    """Lines per incident, whole minute after the case window's start, and level."""
    minute = F.floor(minutes_between(F.col("window_start"), F.col("timestamp")))
    return logs.join(cases.select("incident_id", "window_start"), "incident_id").groupBy(
        "incident_id", minute.alias("minute"), "level").agg(F.count("*").alias("lines"))

