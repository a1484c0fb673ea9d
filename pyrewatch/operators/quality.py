"""Data checks. Each one yields problem rows; a report counts them and shows the first few."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pyrewatch import schemas as S
from pyrewatch.functions.text import LABEL_LEAK
from pyrewatch.functions.times import day_of
from pyrewatch.operators.ordered import with_previous
from pyrewatch.session import cut_lineage

FEW = 5


def problems(df: DataFrame, check: str, bad: Column, text: Column) -> DataFrame:
    return df.where(bad).select(F.lit(check).alias("name"), text.cast("string").alias("problem"))


def flagged(df: DataFrame, checks: dict[str, Column], text: Column) -> DataFrame:
    """Problem rows of several checks on the same table, in one pass."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in checks.items()]))
    return df.select(F.explode(found).alias("name"), text.cast("string").alias("problem"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def report(found: DataFrame, names: list[str]) -> DataFrame:
    """Per check: verdict, number of problems and the first five texts. Checks without problems pass.

    The rank filter is applied in every partition before the shuffle, so a check with very many problems is cheap.
    """
    found = cut_lineage(found)
    checks = found.sparkSession.createDataFrame([(n,) for n in names], "name string")
    counts = found.groupBy("name").agg(F.count("*").alias("n_problems"))
    place = F.row_number().over(Window.partitionBy("name").orderBy("problem"))
    few = found.withColumn("_place", place).where(F.col("_place") <= FEW).groupBy("name").agg(
        F.array_sort(F.collect_list("problem")).alias("samples"))
    none = F.array().cast("array<string>")
    return checks.join(counts, "name", "left").join(few, "name", "left").select(
        "name", F.col("n_problems").isNull().alias("ok"), F.coalesce("n_problems", F.lit(0)).alias("n_problems"),
        F.coalesce("samples", none).alias("samples"))


def verdict(checked: DataFrame) -> DataFrame:
    return checked.agg(F.bool_and("ok").alias("ok"), F.count_if("ok").alias("passed"), F.count("*").alias("total"))


def orphans(evidence: DataFrame, incidents: DataFrame, key: str = "incident_id") -> DataFrame:
    """Keys on one side only: evidence of unknown incidents, and incidents without evidence.

    One aggregate tells per key on which sides it stands, so nothing is joined or sorted. A null matches nothing.
    """
    sides = evidence.select(key, F.lit(True).alias("_ours")).unionByName(incidents.select(key, F.lit(False).alias("_ours")))
    found = sides.groupBy(key).agg(F.bool_or("_ours").alias("_ours"), F.bool_or(~F.col("_ours")).alias("_known"))
    alone = F.col(key).isNull()
    problem = F.array_compact(F.array(
        F.when(F.col("_ours") & (~F.col("_known") | alone), "unknown incident"),
        F.when(F.col("_known") & (~F.col("_ours") | alone), "no evidence")))
    return found.select(key, F.explode(problem).alias("problem"))


def _ordered(rows: DataFrame, keys: list[str], sequence: str, bucket_rows: int = 100_000) -> DataFrame:
    bucket = F.floor(F.col(sequence) / bucket_rows)
    return with_previous(rows, keys, bucket, [sequence], {"_before": "timestamp"})


def log_row_problems(logs: DataFrame, incidents: DataFrame) -> DataFrame:
    """Row checks of raw log events (columns ``raw_level``, ``seq`` in file order) against their case window."""
    windows = incidents.select("incident_id", "window_start", "window_end", F.lit(True).alias("_known"))
    rows = _ordered(logs, ["incident_id"], "seq").join(windows, "incident_id", "left")
    at = F.col("timestamp")
    where = F.concat_ws(":", "incident_id", F.col("seq").cast("string"))
    checks = {
        "unknown incident": F.col("_known").isNull(),
        "unknown level": ~F.col("raw_level").isin(*S.LEVELS),
        "empty message or service": (F.coalesce("message", F.lit("")) == "") | (F.coalesce("service", F.lit("")) == ""),
        "not in order": at < F.col("_before"),
        "outside the case window": ~at.between(F.col("window_start"), F.col("window_end")),
        "label in message": F.col("message").rlike(LABEL_LEAK),
    }
    return flagged(rows, checks, where)


LOG_CHECKS = ["unknown incident", "unknown level", "empty message or service", "not in order",
              "outside the case window", "label in message"]
METRIC_CHECKS = ["unknown incident", "outside the case window", "missing value", "below 0", "above 100",
                 "not strictly increasing"]


def metric_row_problems(metrics: DataFrame, incidents: DataFrame, sequence: str | None = None) -> DataFrame:
    """Row checks of metrics. ``sequence`` is the file order; without it the time order is used."""
    windows = incidents.select("incident_id", "window_start", "window_end", F.lit(True).alias("_known"))
    keys = ["incident_id", "service"]
    if sequence:
        rows = _ordered(metrics, keys, sequence)
    else:
        day = day_of(F.col("timestamp"))
        rows = with_previous(metrics, keys, day, ["timestamp"], {"_before": "timestamp"})
    rows = rows.join(windows, "incident_id", "left")
    at = F.col("timestamp")

    def any_of(columns, test):
        return reduce(lambda a, b: a | b, [F.coalesce(test(F.col(c)), F.lit(False)) for c in columns])

    required = [c for c in S.METRICS if c not in S.NULLABLE_METRICS]
    checks = {
        "unknown incident": F.col("_known").isNull(),
        "outside the case window": ~at.between(F.col("window_start"), F.col("window_end")),
        "missing value": any_of(required, lambda c: c.isNull()),
        "below 0": any_of(S.METRICS, lambda c: c < 0),
        "above 100": any_of(S.PERCENT_METRICS, lambda c: c > 100),
        "not strictly increasing": at <= F.col("_before"),
    }
    return flagged(rows, checks, F.concat_ws(":", "incident_id", "service", at.cast("string")))


def case_problems(incidents: DataFrame, labels: DataFrame, least: dict[str, int]) -> DataFrame:
    """Case checks: duplicate ids, severity, times, labels, and at least ``least[scenario]`` cases each."""
    start, end = F.col("start_time"), F.col("end_time")
    duplicates = incidents.groupBy("incident_id").count().where("count > 1")
    cases = incidents.join(labels, "incident_id", "left")
    fault, normal = F.col("fault_start_time"), F.col("scenario") == S.NORMAL
    ordered = (F.col("window_start") <= start) & (start < end) & (end <= F.col("window_end"))
    known = F.coalesce(F.col("scenario").isin(*S.SCENARIOS), F.lit(False))
    sizes = labels.groupBy("scenario").count()
    wanted = incidents.sparkSession.createDataFrame(sorted(least.items()), "scenario string, least long")
    short = wanted.join(sizes, "scenario", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    case = F.col("incident_id")
    return union([
        problems(duplicates, "duplicate id", F.lit(True), case),
        flagged(cases, {
            "unknown severity": ~F.col("severity").isin(*S.SEVERITIES), "times out of order": ~ordered,
            "unknown scenario": ~known,
            "fault outside window_start..start": known & ~normal & ~F.coalesce(
                fault.between(F.col("window_start"), start), F.lit(False)),
            "normal case with fault": known & normal & fault.isNotNull(),
        }, case),
        problems(short, "too few cases", F.col("count") < F.col("least"), F.concat_ws(
            "=", "scenario", F.col("count").cast("string"))),
    ])


CASE_CHECKS = ["duplicate id", "unknown severity", "times out of order", "unknown scenario",
               "fault outside window_start..start", "normal case with fault", "too few cases"]


def label_leaks(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.col(text).rlike(LABEL_LEAK))


def label_columns(df: DataFrame) -> list[str]:
    """Label names anywhere in a schema, nested fields included."""
    hidden = set(S.LABEL_FIELDS) - {"incident_id"}

    def walk(kind) -> list[str]:
        if hasattr(kind, "fields"):
            return [n for f in kind.fields for n in ([f.name] if f.name in hidden else []) + walk(f.dataType)]
        return walk(kind.elementType) if hasattr(kind, "elementType") else []

    return walk(df.schema)
