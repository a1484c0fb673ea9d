"""Evidence of an incident: selected logs, anomaly onsets and windows on one timeline, with stable ids.

Everything is keyed by incident. Interval conditions are equi-joins on (incident, time step) with a range test
on top, so a busy incident spreads over its steps and a row only meets intervals that touch its own step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pyrewatch.config import CorrelationSettings
from pyrewatch.functions.events import evidence_type, is_change, is_rare, is_relevant, with_event_type
from pyrewatch.functions.text import clip, fixed, has_causal_phrase, spaced
from pyrewatch.functions.times import day_of, iso_text, minutes, step_of
from pyrewatch.operators.ordered import with_row_number, with_session_number
from pyrewatch.schemas import COLLAPSED_EVENTS, EVIDENCE
from pyrewatch.session import cut_lineage

DEFAULTS = CorrelationSettings()
STEP_MINUTES = 60
# Order of the sources at one instant.
SOURCES = ("LOG", "METRIC_ANOMALY", "ANOMALY_WINDOW")


def source_rank(source: Column) -> Column:
    return F.when(source == "LOG", 0).when(source == "METRIC_ANOMALY", 1).otherwise(2)


def with_spans(incidents: DataFrame, settings: CorrelationSettings = DEFAULTS) -> DataFrame:
    """Add the padded alert period and the longer lookback for changes, cut to the case window."""
    start, end = F.col("start_time"), F.col("end_time")
    return incidents.withColumns({
        "investigation_start": F.greatest(start - minutes(settings.lookback), F.col("window_start")),
        "investigation_end": F.least(end + minutes(settings.after_pad), F.col("window_end")),
        "change_start": F.greatest(start - minutes(settings.change_lookback), F.col("window_start")),
    })


def _span_of(incidents: DataFrame, settings: CorrelationSettings) -> DataFrame:
    return with_spans(incidents, settings).select(
        "incident_id", F.col("service").alias("_alerting"), "investigation_start", "investigation_end", "change_start"
    )


_SPAN = ("_alerting", "investigation_start", "investigation_end", "change_start")


def select_windows(windows: DataFrame, incidents: DataFrame, settings: CorrelationSettings = DEFAULTS) -> DataFrame:
    """Windows that overlap the investigation span of their incident."""
    joined = windows.join(_span_of(incidents, settings), "incident_id")
    overlap = (F.col("start_time") <= F.col("investigation_end")) & (F.col("end_time") >= F.col("investigation_start"))
    return joined.where(overlap).drop(*_SPAN)


def select_points(points: DataFrame, incidents: DataFrame, settings: CorrelationSettings = DEFAULTS) -> DataFrame:
    """Points inside the investigation span of their incident."""
    joined = points.join(_span_of(incidents, settings), "incident_id")
    return joined.where(F.col("timestamp").between(F.col("investigation_start"), F.col("investigation_end"))).drop(*_SPAN)


def covered_periods(windows: DataFrame, link_minutes: float) -> DataFrame:
    """Padded windows merged into disjoint periods, one row per (period, time step it touches)."""
    pad = minutes(link_minutes)
    spans = windows.select("incident_id", "start_time", "end_time")
    numbered = with_session_number(
        spans, ["incident_id"], day_of(F.col("start_time")), "start_time", "end_time", minutes(2 * link_minutes), "_period")
    periods = numbered.groupBy("incident_id", "_period").agg(
        (F.min("start_time") - pad).alias("covered_from"), (F.max("end_time") + pad).alias("covered_to")
    )
    steps = F.sequence(step_of(F.col("covered_from"), STEP_MINUTES), step_of(F.col("covered_to"), STEP_MINUTES))
    return periods.select("incident_id", "covered_from", "covered_to", F.explode(steps).alias("_step"))


def with_near_window(logs: DataFrame, windows: DataFrame, link_minutes: float = DEFAULTS.link) -> DataFrame:
    """Add ``near_window``: the line lies in some window widened by ``link_minutes`` on both sides.

    Covered periods are disjoint, so a line meets at most one and the left join adds no rows.
    """
    left = logs.withColumn("_step", step_of(F.col("timestamp"), STEP_MINUTES)).alias("l")
    right = covered_periods(windows, link_minutes).alias("c")
    inside = F.col("l.timestamp").between(F.col("c.covered_from"), F.col("c.covered_to"))
    same = (F.col("l.incident_id") == F.col("c.incident_id")) & (F.col("l._step") == F.col("c._step"))
    joined = left.join(right, same & inside, "left")
    return joined.select(
        *[F.col(f"l.{c}") for c in logs.columns], F.col("c.covered_from").isNotNull().alias("near_window")
    )


def reach_of(incidents: DataFrame, windows: DataFrame, settings: CorrelationSettings = DEFAULTS) -> DataFrame:
    """(incident_id, reach_from, reach_to): the time that the spans and the widened windows of an incident lie in."""
    pad = minutes(settings.link)
    covered = windows.groupBy("incident_id").agg(
        (F.min("start_time") - pad).alias("_covered_from"), (F.max("end_time") + pad).alias("_covered_to"))
    return _span_of(incidents, settings).join(covered, "incident_id", "left").groupBy("incident_id").agg(
        F.min(F.least("change_start", "investigation_start", "_covered_from")).alias("reach_from"),
        F.max(F.greatest("investigation_end", "_covered_to")).alias("reach_to"))


def select_logs(logs: DataFrame | Callable[[DataFrame], DataFrame], incidents: DataFrame, windows: DataFrame,
                settings: CorrelationSettings = DEFAULTS) -> DataFrame:
    """Relevant lines worth citing; ``windows`` are the selected ones.

    A change inside the change span, a rare event inside the investigation span, a line near a window, or a
    line inside the span on a service that a window or the alert names (any service when there is no window).
    Each of these asks for a time within the incident's spans and windows, so lines outside are left out first; ``logs``
    may come without ``event_type``, which is then told for the others alone. A source that can leave them out before it makes
    a line's text is given as a function of ``reach_of``.
    """
    at, event = F.col("timestamp"), F.col("event_type")
    # A row per incident, stored so that the planner knows its size and need not shuffle the lines to meet it.
    reach = cut_lineage(reach_of(incidents, windows, settings))
    if not isinstance(logs, DataFrame):
        logs = logs(reach)
    reached = logs.join(_span_of(incidents, settings), "incident_id").join(reach, "incident_id").where(
        at.between(F.col("reach_from"), F.col("reach_to"))).drop("reach_from", "reach_to")
    if "event_type" not in logs.columns:
        reached = with_event_type(reached, F.col("message"), F.col("level"))
    relevant = reached.where(is_relevant(event, F.col("level")))
    named = windows.select("incident_id", F.explode("affected_services").alias("service")).distinct()
    anomalous = windows.select("incident_id").distinct()
    rows = (
        with_near_window(relevant, windows, settings.link)
        .join(anomalous.withColumn("_has_windows", F.lit(True)), "incident_id", "left")
        .join(named.withColumn("_named", F.lit(True)), ["incident_id", "service"], "left")
    )
    in_span = at.between(F.col("investigation_start"), F.col("investigation_end"))
    in_change_span = at.between(F.col("change_start"), F.col("investigation_end"))
    on_service = F.col("_has_windows").isNull() | F.col("_named").isNotNull() | (F.col("service") == F.col("_alerting"))
    keep = (is_change(event) & in_change_span) | (is_rare(event) & in_span) | F.col("near_window") | (in_span & on_service)
    return rows.where(keep).select(*[c for c in reached.columns if c not in _SPAN])


def collapse_logs(logs: DataFrame) -> DataFrame:
    """High-volume event types shrink to their first line per service, with a count and the last time.

    Lines of other types form groups of one through their ``seq``, so one aggregate serves both kinds.
    """
    many = F.col("event_type").isin(*COLLAPSED_EVENTS)
    kept = ["timestamp", "level", "message", "seq"]
    first = F.min_by(F.struct(*kept), F.struct("timestamp", "message", "seq")).alias("_first")
    groups = logs.withColumn("_single", F.when(~many, F.col("seq"))).groupBy(
        "incident_id", "service", "event_type", "_single").agg(
        first, F.count("*").alias("occurrence_count"), F.max("timestamp").alias("_last"))
    return groups.select(
        "incident_id", "service", "event_type", *[F.col(f"_first.{c}").alias(c) for c in kept], "occurrence_count",
        F.when(F.col("occurrence_count") > 1, F.col("_last")).alias("last_timestamp"),
        F.col("_single").isNull().alias("collapsed"))


def first_points(points: DataFrame) -> DataFrame:
    """Earliest point of each (incident, service, metric)."""
    row = F.struct(*points.columns)
    firsts = points.groupBy("incident_id", "service", "metric_name").agg(F.min_by(row, "timestamp").alias("_first"))
    return firsts.select("_first.*")


def notable_onsets(points: DataFrame, incidents: DataFrame, windows: DataFrame) -> DataFrame:
    """First points on the alerting service, on a window's peak series, or of high severity themselves."""
    peaks = windows.select(
        "incident_id", F.col("peak_service").alias("service"), F.col("peak_metric").alias("metric_name")
    ).distinct().withColumn("_peak", F.lit(True))
    alerting = incidents.select("incident_id", F.col("service").alias("_alerting"))
    rows = first_points(points).join(alerting, "incident_id").join(
        peaks, ["incident_id", "service", "metric_name"], "left"
    )
    keep = (F.col("service") == F.col("_alerting")) | F.col("_peak").isNotNull() | (F.col("severity") == "HIGH")
    return rows.where(keep).select(*points.columns)


def with_ids(items: DataFrame, prefix: str, order: list[str]) -> DataFrame:
    """Number the items of each incident in ``order``: ``PREFIX-000001`` and on."""
    # An incident lasts hours, so its items are numbered minute by minute.
    numbered = with_row_number(items, ["incident_id"], step_of(F.col(order[0]), 1), order, "_number")
    digits = F.lpad(F.col("_number").cast("string"), 6, "0")
    digits = F.when(F.col("_number") > 999_999, F.col("_number").cast("string")).otherwise(digits)
    return numbered.withColumn("evidence_id", F.concat(F.lit(f"{prefix}-"), digits)).drop("_number")


def log_summary() -> Column:
    head = F.concat_ws(" ", F.lit("Observed"), "level", spaced(F.col("event_type")), F.lit("on"), "service")
    records = F.concat(
        F.lit(" ("), F.col("occurrence_count").cast("string"), F.lit(" records, last at "),
        iso_text(F.col("last_timestamp")), F.lit(")"),
    )
    return F.concat(head, F.coalesce(records, F.lit("")), F.lit(": "), clip(F.col("message"), 180))


def point_summary() -> Column:
    z = F.coalesce(F.concat(F.lit("|z|="), fixed(F.abs("z_score"), 1)), F.lit("z-score unavailable"))
    base = F.coalesce(F.concat(F.lit("baseline "), fixed(F.col("baseline_mean"), 1)), F.lit("no baseline yet"))
    heading = F.coalesce(F.concat(F.lit(", "), "direction"), F.lit(""))
    return F.concat(
        F.lit("Observed "), "metric_name", F.lit("="), fixed(F.col("value"), 1), F.lit(" on "), "service",
        F.lit(" ("), z, F.lit(", "), base, heading, F.lit("; "), "detection_method", F.lit(")"),
    )


def window_summary() -> Column:
    z = F.coalesce(F.concat(F.lit("|z|="), fixed(F.col("peak_deviation"), 1)), F.lit("no z-score"))
    return F.concat(
        F.lit("Observed anomaly window on "), F.array_join("affected_services", ", "), F.lit(" ("),
        F.col("anomaly_count").cast("string"), F.lit(" points, peak "), "peak_service", F.lit(" "), "peak_metric",
        F.lit(" "), z, F.lit(", "), fixed(F.col("duration_minutes"), 1), F.lit(" min)"),
    )


def _as_evidence(items: DataFrame, **columns: Column) -> DataFrame:
    """Bring items to the evidence layout; columns not given become null."""
    fields = []
    for field in EVIDENCE.fields:
        column = columns.get(field.name)
        if column is None:
            column = F.col(field.name) if field.name in items.columns else F.lit(None)
        fields.append(column.cast(field.dataType).alias(field.name))
    return items.select(*fields)


def log_evidence(selected_logs: DataFrame) -> DataFrame:
    items = with_ids(cut_lineage(collapse_logs(selected_logs)), "LOG", ["timestamp", "service", "event_type", "collapsed", "seq"])
    return _as_evidence(
        items, source_type=F.lit("LOG"), evidence_type=evidence_type(F.col("event_type"), F.col("level")),
        summary=log_summary(), severity=F.col("level"),
        source_reference=F.concat_ws(":", F.lit("log"), "service", iso_text(F.col("timestamp")), "event_type"),
    )


def point_evidence(onsets: DataFrame) -> DataFrame:
    items = with_ids(onsets, "ANOM", ["timestamp", "service", "metric_name"])
    return _as_evidence(
        items, source_type=F.lit("METRIC_ANOMALY"), evidence_type=F.lit("ANOMALY"), summary=point_summary(),
        source_reference=F.concat_ws(":", F.lit("anomaly"), "service", "metric_name", iso_text(F.col("timestamp"))),
        occurrence_count=F.lit(1),
    )


def window_evidence(windows: DataFrame) -> DataFrame:
    items = with_ids(windows, "ANOMWIN", ["start_time"])
    reference = F.concat_ws(
        ":", F.lit("anomaly_window"), iso_text(F.col("start_time")), iso_text(F.col("end_time")), "peak_service",
        "peak_metric",
    )
    return _as_evidence(
        items, timestamp=F.col("start_time"), service=F.col("peak_service"), source_type=F.lit("ANOMALY_WINDOW"),
        evidence_type=F.lit("ANOMALY_WINDOW"), summary=window_summary(), source_reference=reference,
        metric_name=F.col("peak_metric"), occurrence_count=F.col("anomaly_count"), last_timestamp=F.col("end_time"),
    )


def correlate(logs: DataFrame | Callable[[DataFrame], DataFrame], incidents: DataFrame, points: DataFrame, windows: DataFrame,
              settings: CorrelationSettings = DEFAULTS) -> DataFrame:
    """All evidence of all incidents, in the evidence layout, as a written table.

    The incidents, the selected windows, the collapsed lines and the evidence are read several times and are far smaller
    than their inputs, so each is written once. ``logs`` is what ``select_logs`` takes.
    """
    incidents = cut_lineage(incidents)
    picked = cut_lineage(select_windows(windows, incidents, settings))
    onsets = notable_onsets(select_points(points, incidents, settings), incidents, picked)
    return cut_lineage(
        log_evidence(select_logs(logs, incidents, picked, settings))
        .unionByName(point_evidence(onsets))
        .unionByName(window_evidence(picked))
    )


def window_links(evidence: DataFrame, link_minutes: float = DEFAULTS.link) -> DataFrame:
    """(incident, window id, log id) for every log item whose span touches the widened window.

    Both spans are cut into time steps; a pair is kept only in the first step they share, so it appears once.
    """
    pad = minutes(link_minutes)
    is_log = F.col("source_type") == "LOG"
    spans = evidence.where(F.col("source_type").isin("LOG", "ANOMALY_WINDOW")).select(
        "incident_id", "evidence_id", "source_type",
        F.when(is_log, F.col("timestamp")).otherwise(F.col("timestamp") - pad).alias("_from"),
        F.when(is_log, F.coalesce("last_timestamp", "timestamp")).otherwise(F.col("last_timestamp") + pad).alias("_to"),
    )
    first = step_of(F.col("_from"), STEP_MINUTES)
    spans = spans.withColumn("_first", first).withColumn(
        "_step", F.explode(F.sequence(first, step_of(F.col("_to"), STEP_MINUTES))))
    log, window = spans.where(is_log).alias("l"), spans.where(~is_log).alias("w")
    same = (F.col("l.incident_id") == F.col("w.incident_id")) & (F.col("l._step") == F.col("w._step"))
    touch = (F.col("l._from") <= F.col("w._to")) & (F.col("l._to") >= F.col("w._from"))
    once = F.col("l._step") == F.greatest("l._first", "w._first")
    return window.join(log, same & touch & once).select(
        F.col("w.incident_id").alias("incident_id"), F.col("w.evidence_id").alias("window_id"),
        F.col("l.evidence_id").alias("evidence_id"),
    )


def with_related(evidence: DataFrame, links: DataFrame) -> DataFrame:
    """Add ``related_evidence_ids`` for export; empty when nothing is linked. Large analyses read the links."""
    lists = links.groupBy("incident_id", F.col("window_id").alias("evidence_id")).agg(
        F.array_sort(F.collect_list(links["evidence_id"])).alias("related_evidence_ids"))
    none = F.array().cast("array<string>")
    return evidence.join(lists, ["incident_id", "evidence_id"], "left").withColumn(
        "related_evidence_ids", F.coalesce("related_evidence_ids", none))


def title() -> Column:
    many = F.when(F.col("occurrence_count") > 1, F.concat(F.lit(" x"), F.col("occurrence_count").cast("string")))
    label = F.coalesce(spaced(F.col("event_type")), F.lit("log event"))
    return (
        F.when(F.col("evidence_type") == "ANOMALY_WINDOW",
               F.concat(F.lit("anomaly window ("), "metric_name", F.lit(") on "), "service"))
        .when(F.col("evidence_type") == "ANOMALY", F.concat("metric_name", F.lit(" anomaly on "), "service"))
        .otherwise(F.concat(label, F.lit(" on "), "service", F.coalesce(many, F.lit(""))))
    )


def timeline(evidence: DataFrame) -> DataFrame:
    """Timeline rows with their place in the incident."""
    events = evidence.withColumn("title", title()).withColumn("_rank", source_rank(F.col("source_type")))
    order = ["timestamp", "_rank", "service", "evidence_id"]
    return with_row_number(events, ["incident_id"], step_of(F.col("timestamp"), 1), order, "position").select(
        "incident_id", "position", "timestamp", "title", F.col("summary").alias("description"), "service",
        "source_type", "evidence_id", "severity",
    )


def timeline_summary(evidence: DataFrame, incidents: DataFrame) -> DataFrame:
    """Per incident: involved services, and the first event, first log and first anomaly by id and time."""
    rows = evidence.withColumn("_rank", source_rank(F.col("source_type")))
    order = F.struct("timestamp", "_rank", "service", "evidence_id")
    event = F.struct("evidence_id", "timestamp", title().alias("title"))
    is_log = F.col("source_type") == "LOG"

    def earliest(condition: Column | None) -> Column:
        return F.min_by(event, order if condition is None else F.when(condition, order))

    summary = rows.groupBy("incident_id").agg(
        F.count("*").alias("events"), F.array_sort(F.collect_set("service")).alias("involved_services"),
        earliest(None).alias("first_event"), earliest(is_log).alias("first_log"),
        earliest(~is_log).alias("first_anomaly"),
    )
    empty = F.array().cast("array<string>")
    return incidents.select("incident_id", F.col("service").alias("alerting_service")).join(
        summary, "incident_id", "left"
    ).withColumns({
        "events": F.coalesce("events", F.lit(0)), "involved_services": F.coalesce("involved_services", empty),
    })


def causal_wording(evidence: DataFrame) -> DataFrame:
    """Our own titles, and the summaries of anomalies, that claim a cause. Quoted log text is exempt."""
    texts = evidence.select("incident_id", "evidence_id", title().alias("text")).unionByName(
        evidence.where(F.col("source_type") != "LOG").select("incident_id", "evidence_id", F.col("summary").alias("text")))
    return texts.where(has_causal_phrase(F.col("text")))
