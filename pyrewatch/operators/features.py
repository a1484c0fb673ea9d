"""Measured features of each incident: levels before and during it, onsets, runs, shapes and log rates.

``cases`` is one row per incident with its labels joined on (evaluation data), see ``case_table``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pyrewatch.functions.text import TIMEOUT_WORDS
from pyrewatch.functions.times import day_of, minutes, minutes_between
from pyrewatch.operators.ordered import with_previous, with_running_total
from pyrewatch.operators.series import long_series
from pyrewatch.schemas import FAILURES, LEVELS, METRICS, NORMAL

BASELINE_MINUTES = 30.0


def case_table(incidents: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds the focus service, the reference time and position features of every case."""
    cases = incidents.join(labels, "incident_id")
    ref = F.coalesce("fault_start_time", "start_time")
    focus = F.when(F.col("scenario").isin(*FAILURES[:2]), F.col("root_cause_service")).otherwise(F.col("service"))
    return cases.withColumns({
        "focus": focus, "ref": ref,
        "window_min": minutes_between(F.col("window_start"), F.col("window_end")),
        "fault_offset_min": minutes_between(F.col("window_start"), ref),
        "alert_lag_min": minutes_between(ref, F.col("start_time")),
        "minutes_before_start": minutes_between(F.col("window_start"), F.col("start_time")),
    })


def _with_case(rows: DataFrame, cases: DataFrame, baseline_minutes: float) -> DataFrame:
    """Join case bounds; add where a row lies. Columns of the case carry a leading underscore."""
    bounds = cases.select("incident_id", *[
        F.col(c).alias(f"_{c}") for c in ("scenario", "service", "focus", "ref", "start_time", "end_time")])
    at = F.col("timestamp")
    return rows.join(bounds, "incident_id").withColumns({
        "_in_base": at.between(F.col("_ref") - minutes(baseline_minutes), F.col("_ref") - minutes(1)),
        "_in_alert": at.between(F.col("_start_time"), F.col("_end_time")),
        "_in_fault": at.between(F.col("_ref"), F.col("_end_time")),
    })


def phase_stats(metrics: DataFrame, cases: DataFrame, baseline_minutes: float = BASELINE_MINUTES) -> DataFrame:
    """n, mean, sample std, min and max per scenario, phase and metric on the focus service."""
    rows = _with_case(long_series(metrics), cases, baseline_minutes).where(F.col("service") == F.col("_focus"))
    phase = F.explode(F.array_compact(F.array(
        F.when(F.col("_in_base"), "baseline"), F.when(F.col("_in_alert"), "incident"))))
    return rows.select(F.col("_scenario").alias("scenario"), phase.alias("phase"), "metric_name", "value").groupBy(
        "scenario", "phase", "metric_name").agg(*_describe("value"))


def _describe(column: str) -> list[Column]:
    return [F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
            F.min(column).alias("min"), F.max(column).alias("max")]


def scenario_stats(metrics: DataFrame, cases: DataFrame) -> DataFrame:
    """The same figures over all rows of a scenario."""
    return long_series(metrics).join(cases.select("incident_id", "scenario"), "incident_id").groupBy(
        "scenario", "metric_name").agg(*_describe("value"))


def signals(metrics: DataFrame, cases: DataFrame, baseline_minutes: float = BASELINE_MINUTES) -> DataFrame:
    """Baseline medians, alert peaks, rises and ratios per incident, in one grouped pass."""
    rows = _with_case(metrics, cases, baseline_minutes).where("_in_base or _in_alert or _in_fault")
    focus, reported = F.col("service") == F.col("_focus"), F.col("service") == F.col("_service")

    def base(service, name):
        return F.median(F.when(F.col("_in_base") & service, F.col(name)))

    def peak(service, name, phase="_in_alert"):
        return F.max(F.when(F.col(phase) & service, F.col(name)))

    wanted = []
    for name in METRICS:
        wanted += [base(focus, name).alias(f"base_{name}"), peak(focus, name).alias(f"peak_{name}")]
    wanted.append(peak(focus, "memory_usage", "_in_fault").alias("_memory_top"))
    for name in ("latency_ms", "error_rate", "downstream_latency_ms", "memory_usage"):
        wanted += [base(reported, name).alias(f"_rbase_{name}"), peak(reported, name).alias(f"_rpeak_{name}")]
    wanted.append(F.max(F.when(F.col("_in_alert"), F.col("error_rate"))).alias("max_error_any_service"))
    found = rows.groupBy("incident_id").agg(*wanted)

    def ratio(top, bottom):
        return F.try_divide(F.col(top), F.col(bottom))

    out = cases.select("incident_id").join(found, "incident_id", "left").withColumns({
        "mem_rise": F.col("_memory_top") - F.col("base_memory_usage"),
        "latency_ratio": ratio("peak_latency_ms", "base_latency_ms"),
        "error_delta": F.col("peak_error_rate") - F.col("base_error_rate"),
        "cpu_ratio": ratio("peak_cpu_usage", "base_cpu_usage"),
        "request_rate_ratio": ratio("peak_request_rate", "base_request_rate"),
        "db_ratio": ratio("peak_db_connection_utilization", "base_db_connection_utilization"),
        "reported_ds_ratio": ratio("_rpeak_downstream_latency_ms", "_rbase_downstream_latency_ms"),
        "reported_latency_ratio": ratio("_rpeak_latency_ms", "_rbase_latency_ms"),
        "reported_error_delta": F.col("_rpeak_error_rate") - F.col("_rbase_error_rate"),
        "reported_memory_delta": F.col("_rpeak_memory_usage") - F.col("_rbase_memory_usage"),
    })
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def log_rates(logs: DataFrame, cases: DataFrame, baseline_minutes: float = BASELINE_MINUTES) -> DataFrame:
    """Lines by level, and WARN, ERROR and timeout lines per minute before and during the alert."""
    bounds = cases.select("incident_id", "ref", "start_time", "end_time")
    at, level = F.col("timestamp"), F.col("level")
    loud_timeout = F.col("message").rlike(TIMEOUT_WORDS) & level.isin("WARN", "ERROR")
    rows = logs.select("incident_id", "timestamp", "level", loud_timeout.alias("_timeout")).join(bounds, "incident_id")
    rows = rows.withColumns({
        "_base": at.between(F.col("ref") - minutes(baseline_minutes), F.col("ref") - minutes(1)),
        "_alert": at.between(F.col("start_time"), F.col("end_time")),
    })
    groups = {"warn": level == "WARN", "error": level == "ERROR", "timeout": F.col("_timeout")}
    counts = [F.count("*").alias("log_records"), *[F.count_if(level == v).alias(f"{v.lower()}_logs") for v in LEVELS]]
    for name, test in groups.items():
        counts += [F.count_if(test & F.col("_base")).alias(f"_{name}_base"), F.count_if(test & F.col("_alert")).alias(f"_{name}_alert")]
    late = at >= F.col("ref") - minutes(5)
    counts.append(F.min(F.when(F.col("_timeout") & late, at)).alias("_first_timeout"))
    found = rows.groupBy("incident_id").agg(*counts)
    base_len = F.greatest(F.lit(1.0), F.lit(baseline_minutes - 1))
    alert_len = F.greatest(F.lit(1.0), minutes_between(F.col("start_time"), F.col("end_time")))
    out = bounds.join(found, "incident_id", "left")
    out = out.na.fill(0, [c for c in found.columns if c not in ("incident_id", "_first_timeout")])
    rates = {"info_share": F.col("info_logs") / F.greatest(F.lit(1), F.col("log_records")),
             "timeout_logs_incident": F.col("_timeout_alert"),
             "onset_timeout_log": F.round(minutes_between(F.col("ref"), F.col("_first_timeout")), 1)}
    for name in groups:
        rates[f"{name}_per_min_baseline"] = F.col(f"_{name}_base") / base_len
        rates[f"{name}_per_min_incident"] = F.col(f"_{name}_alert") / alert_len
    out = out.withColumns(rates)
    return out.drop("ref", "start_time", "end_time", *[c for c in out.columns if c.startswith("_")])


def onsets(rows: DataFrame, keys: list[str], run: int = 2) -> DataFrame:
    """First run of two rows above ``threshold`` from five minutes before ``ref`` on, in minutes after ``ref``.

    ``rows`` has keys, timestamp, value, threshold and ref. The run's first minute counts, one minute before
    the row that completes it.
    """
    if run != 2:
        raise ValueError("a run is two consecutive rows")
    late = rows.where(F.col("timestamp") >= F.col("ref") - minutes(5))
    late = late.withColumn("_over", F.coalesce(F.col("value") > F.col("threshold"), F.lit(False)))
    pairs = with_previous(late, keys, day_of(F.col("timestamp")), ["timestamp"], {"_before": "_over"})
    hits = pairs.where(F.col("_over") & F.coalesce("_before", F.lit(False)))
    firsts = hits.groupBy(*keys).agg(F.min("timestamp").alias("_at"), F.first("ref").alias("_ref"))
    return firsts.select(*keys, F.round(minutes_between(F.col("_ref"), F.col("_at") - minutes(1)), 1).alias("onset"))


def signal_onsets(metrics: DataFrame, cases: DataFrame, measured: DataFrame) -> DataFrame:
    """Onsets of latency, errors and the scenario's own signal; ``measured`` holds the baselines."""
    rows = metrics.join(cases.select("incident_id", "scenario", F.col("focus").alias("service"), "ref"),
                        ["incident_id", "service"])
    base = measured.select("incident_id", *[f"base_{m}" for m in METRICS])
    db, leak, downstream = FAILURES
    scenario = F.col("scenario")
    primary = F.when(scenario == db, F.struct(F.col("db_connection_utilization").alias("v"), F.lit(85.0).alias("t"))).when(
        scenario == leak, F.struct(F.col("memory_usage").alias("v"), (F.col("base_memory_usage") + 10).alias("t"))).when(
        scenario == downstream, F.struct(
            F.col("downstream_latency_ms").alias("v"), (F.col("base_downstream_latency_ms") * 2).alias("t")))
    kinds = F.explode(F.array(
        F.struct(F.lit("latency").alias("signal"), F.col("latency_ms").alias("v"), (F.col("base_latency_ms") * 2).alias("t")),
        F.struct(F.lit("error").alias("signal"), F.col("error_rate").alias("v"), (F.col("base_error_rate") + 1).alias("t")),
        F.struct(F.lit("primary").alias("signal"), primary["v"].alias("v"), primary["t"].alias("t")),
    ))
    long = rows.join(base, "incident_id").select("incident_id", "ref", "timestamp", kinds.alias("k")).select(
        "incident_id", "ref", "timestamp", "k.signal", F.col("k.v").alias("value"), F.col("k.t").alias("threshold"))
    return onsets(long, ["incident_id", "signal"])


def signal_order(found: DataFrame) -> DataFrame:
    """Text such as ``error=primary < latency``: signals by onset, equal ones side by side."""
    ties = found.groupBy("incident_id", "onset").agg(F.array_sort(F.collect_list("signal")).alias("_names"))
    steps = F.transform(F.array_sort(F.collect_list(F.struct("onset", "_names"))), lambda s: F.array_join(s["_names"], "="))
    text = F.array_join(steps, " < ")
    out = ties.groupBy("incident_id").agg(text.alias("_text"), F.sum(F.size("_names")).alias("_n"))
    note = F.when(F.col("_n") == 3, "").otherwise(" (not all signals crossed)")
    return out.select("incident_id", F.concat("_text", note).alias("ordering"))


def longest_run(rows: DataFrame, keys: list[str], over: Column) -> DataFrame:
    """Longest run of consecutive rows where ``over`` holds."""
    flagged = rows.withColumn("_over", F.coalesce(over, F.lit(False)))
    islands = with_running_total(
        flagged, keys, day_of(F.col("timestamp")), ["timestamp"], F.when(F.col("_over"), 0).otherwise(1), "_island")
    runs = islands.groupBy(*keys, "_island").agg(F.count_if("_over").alias("_length"))
    return runs.groupBy(*keys).agg(F.max("_length").alias("longest_run"))


def steps(rows: DataFrame, keys: list[str], drop: float = -15.0) -> DataFrame:
    """Largest step up between neighbours and the time of the first drop below ``drop``."""
    moved = with_previous(rows, keys, day_of(F.col("timestamp")), ["timestamp"], {"_before": "value"})
    step = F.col("value") - F.col("_before")
    return moved.groupBy(*keys).agg(
        F.max(step).alias("largest_step"), F.min(F.when(step < drop, F.col("timestamp"))).alias("first_drop"))


def _fault_rows(metrics: DataFrame, cases: DataFrame, name: str) -> DataFrame:
    bounds = cases.select("incident_id", F.col("focus").alias("service"), "ref", F.col("end_time").alias("_end"))
    rows = metrics.join(bounds, ["incident_id", "service"]).where(F.col("timestamp").between(F.col("ref"), F.col("_end")))
    return rows.select("incident_id", "timestamp", F.col(name).alias("value"))


def growth_shape(metrics: DataFrame, cases: DataFrame, name: str = "memory_usage", drop: float = -15.0) -> DataFrame:
    """Linear fit and largest step of a growth phase: from the reference time to its maximum, before the first drop."""
    rows = _fault_rows(metrics, cases, name)
    day = day_of(F.col("timestamp"))
    moved = with_previous(rows, ["incident_id"], day, ["timestamp"], {"_before": "value"}).withColumn(
        "_step", F.col("value") - F.col("_before"))
    drops = moved.where(F.col("_step") < drop).groupBy("incident_id").agg(F.min("timestamp").alias("_drop"))
    kept = moved.join(drops, "incident_id", "left").where(
        F.col("_drop").isNull() | (F.col("timestamp") <= F.col("_drop") - minutes(1)))
    tops = kept.groupBy("incident_id").agg(
        F.min_by("timestamp", F.struct(-F.col("value"), F.col("timestamp"))).alias("_top"), F.min("timestamp").alias("_from"))
    phase = kept.join(tops, "incident_id").where(F.col("timestamp") <= F.col("_top")).withColumn(
        "_x", minutes_between(F.col("_from"), F.col("timestamp")))
    rise = F.max("value") - F.min_by("value", "timestamp")
    fit = F.when(F.var_pop("value") > 0, F.regr_r2("value", "_x"))
    return phase.groupBy("incident_id").agg(
        F.max("_x").alias("minutes_to_peak"), F.regr_slope("value", "_x").alias("slope"), fit.alias("linear_r2"),
        F.when(rise > 0, F.max("_step") / rise).alias("max_step_share"))


def rank_correlation(metrics: DataFrame, cases: DataFrame, left: str, right: str) -> DataFrame:
    """Spearman correlation of two metrics on the focus service in the fault period, ties by average rank.

    Ranks are taken over distinct values with their counts, not over the rows themselves.
    """
    bounds = cases.select("incident_id", F.col("focus").alias("service"), "ref", F.col("end_time").alias("_end"))
    rows = metrics.join(bounds, ["incident_id", "service"]).where(
        F.col("timestamp").between(F.col("ref"), F.col("_end")) & F.col(left).isNotNull() & F.col(right).isNotNull())
    rows = rows.select("incident_id", left, right)
    for name in (left, right):
        tied = rows.groupBy("incident_id", name).agg(F.count("*").alias("_n"))
        below = Window.partitionBy("incident_id").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        rank = F.coalesce(F.sum("_n").over(below), F.lit(0)) + (F.col("_n") + 1) / 2
        rows = rows.join(tied.select("incident_id", name, rank.alias(f"_rank_{name}")), ["incident_id", name])
    return rows.groupBy("incident_id").agg(F.corr(f"_rank_{left}", f"_rank_{right}").alias("spearman"))


def normal_profile(metrics: DataFrame, logs: DataFrame, cases: DataFrame, measured: DataFrame) -> DataFrame:
    """How calm the normal cases are."""
    normal = cases.where(F.col("scenario") == NORMAL).select("incident_id", "focus", "window_min")
    rows = metrics.join(normal, "incident_id")
    on_focus = F.col("service") == F.col("focus")
    latency, memory = F.when(on_focus, F.col("latency_ms")), F.when(on_focus, F.col("memory_usage"))
    figures = rows.groupBy("incident_id").agg(
        F.max("error_rate").alias("max_error_rate"), F.max("db_connection_utilization").alias("max_db_util"),
        (F.stddev_samp(latency) / F.avg(latency)).alias("latency_cv"), (F.max(memory) - F.min(memory)).alias("memory_range"))
    runs = longest_run(rows, ["incident_id", "service"], F.col("error_rate") > 2).groupBy("incident_id").agg(
        F.max("longest_run").alias("longest_error_run"))
    lines = logs.join(normal, "incident_id", "left_semi").groupBy("incident_id").agg(
        F.count_if(F.col("level") == "WARN").alias("warn_logs"), F.count_if(F.col("level") == "ERROR").alias("error_logs"))
    out = normal.join(figures, "incident_id", "left").join(runs, "incident_id", "left").join(lines, "incident_id", "left")
    out = out.join(measured.select("incident_id", F.col("latency_ratio").alias("latency_peak_ratio")), "incident_id", "left")
    out = out.na.fill(0, ["warn_logs", "error_logs"])
    return out.withColumn("warn_per_min", F.col("warn_logs") / F.col("window_min")).drop("focus", "window_min")


def service_impact(metrics: DataFrame, cases: DataFrame, baseline_minutes: float = BASELINE_MINUTES) -> DataFrame:
    """Per service: baseline median against alert peak, and whether the service was affected."""
    rows = _with_case(metrics, cases, baseline_minutes).where("_in_base or _in_alert")
    figures = []
    for name in ("error_rate", "latency_ms"):
        figures += [F.median(F.when(F.col("_in_base"), F.col(name))).alias(f"base_{name}"),
                    F.max(F.when(F.col("_in_alert"), F.col(name))).alias(f"peak_{name}")]
    out = rows.groupBy("incident_id", "service").agg(*figures)
    rise = F.col("peak_latency_ms") - F.col("base_latency_ms")
    affected = (F.col("peak_error_rate") - F.col("base_error_rate") >= 1.0) | (
        (F.col("peak_latency_ms") >= 2 * F.col("base_latency_ms")) & (rise > 50))
    return out.withColumn("affected", F.coalesce(affected, F.lit(False)))


def impact_severity(impact: DataFrame, cases: DataFrame) -> DataFrame:
    """Severity from the largest error rise on the alerting and root services, duration and latency ratio."""
    rows = impact.join(cases.select("incident_id", F.col("service").alias("_alerting"), "root_cause_service",
                                    "duration_minutes"), "incident_id")
    service = F.col("service")
    named = (service == F.col("_alerting")) | (service == "api-gateway") | F.coalesce(
        service == F.col("root_cause_service"), F.lit(False))
    ratio = F.try_divide("peak_latency_ms", "base_latency_ms")
    found = rows.groupBy("incident_id", "duration_minutes").agg(
        F.max(F.when(named, F.col("peak_error_rate") - F.col("base_error_rate"))).alias("error_rise"),
        F.max(F.when(service == F.col("_alerting"), ratio)).alias("latency_ratio"))
    rise, length = F.col("error_rise"), F.col("duration_minutes")
    severity = (
        F.when((rise >= 25) | ((rise >= 15) & (length >= 40)), "CRITICAL")
        .when((rise >= 8) | ((rise >= 5) & (length >= 45)), "HIGH")
        .when((rise >= 2.5) | (F.col("latency_ratio") >= 6), "MEDIUM").otherwise("LOW"))
    return found.select("incident_id", "error_rise", "latency_ratio", severity.alias("impact_severity"))
