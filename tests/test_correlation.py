import os

import pytest
from builders import LOGS, collect, incident, log, logs, minute, points
from pyspark.sql import functions as F

from pyrewatch.functions.events import is_relevant
from pyrewatch.operators import correlate as c
from pyrewatch.operators.quality import label_columns
from pyrewatch.operators.timelines import with_boundaries
from pyrewatch.operators.windows import anomaly_windows
from pyrewatch.plans import tables

SMALL = "/root/testdata/sf0.001"


def correlated(spark, log_rows, point_rows):
    found = points(spark, *point_rows)
    table = logs(spark, *log_rows) if log_rows else spark.createDataFrame([], LOGS)
    return c.cut_lineage(c.correlate(table, incident(spark), found, anomaly_windows(found)))


BURST = [(45, "payment-api", "latency_ms", 60, "HIGH"), (47, "payment-api", "latency_ms", 20, "MEDIUM"),
         (49, "payment-api", "latency_ms", 12, "MEDIUM"), (50, "payment-api", "latency_ms", 11, "MEDIUM")]


def test_relevance(spark):
    rows = logs(spark, log(1, event_type="oom_killed", level="INFO"), log(2, event_type="retry", level="INFO"),
                log(3, event_type="retry", level="WARN"), log(4, event_type="cache_hit", level="ERROR"))
    kept = rows.where(is_relevant(F.col("event_type"), F.col("level")))
    assert {(r["event_type"], r["level"]) for r in collect(kept, "seq")} == {("oom_killed", "INFO"), ("retry", "WARN")}


def test_timeline_is_ordered_and_links_near_logs(spark):
    evidence = correlated(spark, [log(47), log(2, event_type="slow_request", level="WARN"),
                                  log(30, event_type="deployment_started", level="INFO", message="rolling update started")], BURST)
    events = collect(c.timeline(evidence), "position")
    assert [e["timestamp"] for e in events] == sorted(e["timestamp"] for e in events)
    assert events[0]["title"] == "deployment started on payment-api"
    assert minute(2) not in {e["timestamp"] for e in events}
    links = {(r["window_id"], r["evidence_id"]) for r in collect(c.window_links(evidence), "evidence_id")}
    ids = {r["timestamp"]: r["evidence_id"] for r in collect(evidence.where("source_type = 'LOG'"), "evidence_id")}
    assert links == {("ANOMWIN-000001", ids[minute(47)])}


def test_ids_are_unique_and_prefixed(spark):
    evidence = collect(correlated(spark, [log(45 + i, event_type="oom_killed", message=str(i)) for i in range(5)], BURST), "evidence_id")
    ids = [e["evidence_id"] for e in evidence]
    assert len(set(ids)) == len(ids)
    assert {i.rsplit("-", 1)[0] for i in ids} == {"LOG", "ANOM", "ANOMWIN"}


def test_equal_times_are_ordered_by_service(spark):
    rows = [log(46, service=s, event_type="oom_killed", seq=n) for n, s in enumerate(("zeta", "payment-api", "alpha"))]
    events = collect(c.timeline(correlated(spark, rows, [])), "position")
    assert [e["service"] for e in events] == ["alpha", "payment-api", "zeta"]
    again = collect(c.timeline(correlated(spark, rows[::-1], [])), "position")
    assert events == again


def test_collapse_counts_through_the_last(spark):
    rows = logs(spark, *[log(40 + i, message=f"m{i}", seq=i) for i in range(4)], log(41, event_type="oom_killed", seq=9),
                log(42, event_type="oom_killed", seq=10))
    out = collect(c.collapse_logs(rows), "timestamp", "event_type")
    assert [(r["event_type"], r["occurrence_count"], r["last_timestamp"]) for r in out] == [
        ("request_failed", 4, minute(43)), ("oom_killed", 1, None), ("oom_killed", 1, None)]
    assert out[0]["message"] == "m0"


def test_notable_onsets_look_at_the_first_point_only(spark):
    rows = [(45, "other", "cpu_usage", 5, "LOW"), (46, "other", "cpu_usage", 99, "HIGH"), (45, "x", "cpu_usage", 60, "HIGH"),
            (45, "payment-api", "error_rate", 4, "LOW")]
    none = anomaly_windows(points(spark, *rows)).where("false")
    out = collect(c.notable_onsets(points(spark, *rows), incident(spark), none), "service")
    assert [r["service"] for r in out] == ["payment-api", "x"]


def test_selection_without_windows_keeps_every_service(spark):
    rows = [log(50, service="far", event_type="db_error"), log(100, service="far", event_type="db_error", seq=2)]
    evidence = collect(correlated(spark, rows, []), "evidence_id")
    assert [(e["service"], e["timestamp"]) for e in evidence] == [("far", minute(50))]


def test_summaries(spark):
    evidence = collect(correlated(spark, [log(46 + i, message="two  words", seq=i) for i in range(3)], BURST), "evidence_id")
    by_id = {e["evidence_id"]: e for e in evidence}
    assert by_id["LOG-000001"]["summary"] == (
        "Observed ERROR request failed on payment-api (3 records, last at 2026-01-01T00:48:00): two words")
    assert by_id["ANOM-000001"]["summary"] == (
        "Observed latency_ms=10.0 on payment-api (|z|=60.0, baseline 5.0, up; rolling_zscore)")
    assert by_id["ANOMWIN-000001"]["summary"] == (
        "Observed anomaly window on payment-api (4 points, peak payment-api latency_ms |z|=60.0, 5.0 min)")
    assert by_id["ANOMWIN-000001"]["source_reference"] == (
        "anomaly_window:2026-01-01T00:45:00:2026-01-01T00:50:00:payment-api:latency_ms")


def test_links_across_steps_appear_once(spark):
    rows = [log(m, event_type="retry", level="WARN", seq=m) for m in range(40, 75)]
    evidence = correlated(spark, rows, [(m, "payment-api", "cpu_usage", 5, "LOW") for m in range(50, 70, 2)])
    links = collect(c.window_links(evidence), "evidence_id")
    assert [(r["window_id"], r["evidence_id"]) for r in links] == [("ANOMWIN-000001", "LOG-000001")]


def test_covered_periods_give_one_row_per_log(spark):
    rows = [(m, "a", "cpu_usage", 5, "LOW") for m in (10, 15, 21, 40)]
    windows = anomaly_windows(points(spark, *rows))
    near = collect(c.with_near_window(logs(spark, *[log(m, seq=m) for m in range(0, 60)]), windows), "seq")
    assert len(near) == 60
    expected = {m for m in range(60) if any(a - 5 <= m <= a + 5 for a in (10, 15, 21, 40))}
    assert {r["seq"] for r in near if r["near_window"]} == expected


def test_boundaries_enclose_equal_times(spark):
    evidence = correlated(spark, [log(40, event_type="oom_killed"), log(70, event_type="oom_killed", seq=2)], [])
    rows = collect(with_boundaries(evidence, incident(spark)), "position")
    assert [r["id"] for r in rows] == ["alert-start", "LOG-000001", "LOG-000002", "alert-end"]


def test_outputs_carry_no_label_column(spark):
    assert label_columns(correlated(spark, [log(47)], BURST)) == []


def test_causal_wording_is_found_in_our_text_only(spark):
    evidence = correlated(spark, [log(47, message="failed due to x")], BURST)
    assert c.causal_wording(evidence).count() == 0
    changed = evidence.withColumn("summary", F.concat("summary", F.lit(" because of load")))
    assert c.causal_wording(changed).count() == evidence.where("source_type <> 'LOG'").count()


def test_lines_out_of_reach_need_no_event_type(spark):
    """Lines without a type are typed where a span or window reaches them, and give the same items."""
    rows = [log(47, message="request failed x", event_type="request_failed"), log(2, message="request failed y", event_type="request_failed"),
            log(30, level="INFO", message="rolling update started", event_type="deployment_started"),
            log(69, message="retrying call", event_type="retry", level="WARN"), log(119, message="OOMKilled", event_type="oom_killed")]
    found = points(spark, *BURST)
    typed = logs(spark, *rows)
    far = incident(spark, start=300, end=310, closed=600, incident_id="INC-002")
    cases = incident(spark).unionByName(far)
    picked = c.select_windows(anomaly_windows(found), cases)
    want = collect(c.select_logs(typed, cases, picked), "seq")
    assert len(want) == 3
    assert collect(c.select_logs(typed.drop("event_type"), cases, picked), "seq") == want


def test_points_are_walked_once(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    plan = tables.points(spark, SMALL)._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan


def test_a_source_is_told_the_reach(spark):
    """A source may leave lines out by the reach before it makes them, and the same lines are kept."""
    rows = [log(47, message="request failed x", event_type="request_failed"), log(2, message="request failed y", event_type="request_failed"),
            log(69, message="retrying call", event_type="retry", level="WARN"), log(590, message="OOMKilled", event_type="oom_killed")]
    found, typed, asked = points(spark, *BURST), logs(spark, *rows), []
    cases = incident(spark)
    picked = c.select_windows(anomaly_windows(found), cases)

    def source(reach):
        near = typed.join(reach, "incident_id").where("timestamp between reach_from and reach_to").select(*typed.columns)
        asked.append(near.count())
        return near
    want = collect(c.select_logs(typed, cases, picked), "seq")
    assert want and collect(c.select_logs(source, cases, picked), "seq") == want
    assert asked[0] < len(rows)
