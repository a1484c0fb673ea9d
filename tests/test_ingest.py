import json

import pytest
from builders import collect, incident, minute
from pyspark.sql import functions as F

from pyrewatch.functions.events import classify
from pyrewatch.functions.text import clip, fixed, normalize_level, template_of
from pyrewatch.functions.times import iso_text, parse_iso
from pyrewatch.operators import quality as q
from pyrewatch.sources import documents as docs, logs as log_source, metrics as metric_source, reports

GOOD = {"timestamp": "2026-01-01T00:00:01.250", "incident_id": "INC-001", "service": "api", "host": "h1", "level": "warning",
        "logger": "app", "message": "retrying call", "trace_id": None}


def write_lines(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n", encoding="utf-8")


def test_valid_log_file(spark, tmp_path):
    write_lines(tmp_path / "logs/INC-001.jsonl", [GOOD, {**GOOD, "timestamp": "2026-01-01T00:00:00", "level": "INFO"}])
    lines = log_source.read_log_lines(spark, str(tmp_path / "logs"))
    valid, rejected = log_source.ingest_logs(lines, F.lit("INC-001"))
    rows = collect(valid, "seq")
    assert [(r["seq"], r["level"], r["event_type"], r["trace_id"]) for r in rows] == [
        (1, "WARN", "retry", None), (2, "INFO", "retry", None)]
    assert rejected.count() == 0


def test_every_bad_line_is_reported(spark, tmp_path):
    missing = {k: v for k, v in GOOD.items() if k != "trace_id"}
    bad = [GOOD, {**GOOD, "level": "FATAL"}, {**GOOD, "timestamp": "yesterday"}, "{broken", missing,
           {**GOOD, "incident_id": "INC-999"}, "", {**GOOD, "event_type": "retry"}, "[1]",
           {**GOOD, "timestamp": "2026-01-01T00:00:00+02:00", "host": ""}]
    write_lines(tmp_path / "logs/INC-001.jsonl", bad)
    write_lines(tmp_path / "logs/INC-002.jsonl", [{**GOOD, "incident_id": "INC-002"}])
    (tmp_path / "logs/INC-003.jsonl").write_text("")
    lines = log_source.read_log_lines(spark, str(tmp_path / "logs"))
    expected = spark.createDataFrame([("logs/INC-001.jsonl",), ("logs/INC-003.jsonl",), ("logs/INC-004.jsonl",)], "path string")
    assert [(r["path"], r["reason"]) for r in collect(log_source.files_without_logs(expected, lines), "path")] == [
        ("logs/INC-003.jsonl", "contains no log records"), ("logs/INC-004.jsonl", "contains no log records")]
    valid, rejected = log_source.ingest_logs(lines, F.regexp_extract("path", r"(INC-\d+)\.jsonl", 1))
    reasons = {r["location"]: r["reason"] for r in collect(rejected, "location_no")}
    assert reasons == {
        "line 2": "level: unknown", "line 3": "timestamp: not a zone-free ISO time", "line 4": "not a JSON object",
        "line 5": "trace_id: missing", "line 6": "record belongs to INC-999, expected INC-001", "line 7": "blank line",
        "line 8": "event_type must not be supplied", "line 9": "not a JSON object",
        "line 10": "timestamp: not a zone-free ISO time; host: empty or missing"}
    assert [r["incident_id"] for r in collect(valid, "seq")] == ["INC-002"]
    report = collect(reports.issue_report(rejected, shown=2), "path")[0]
    assert report["problems"] == 9
    assert report["message"].endswith("  - ... 7 more")


@pytest.mark.parametrize("message,level,expected", [
    ("GET /healthz 200", "INFO", "health_check_passed"), ("GET /healthz 503", "INFO", "health_check_failed"),
    ('"GET /a HTTP/1.1" 502 upstream=x', "INFO", "request_failed"), ("Completed POST /a 404 in 3ms", "INFO", "request_client_error"),
    ("request completed method=GET path=/a status=200 slow=true", "INFO", "slow_request"),
    ("duration: 3.2 ms  statement: select", "WARN", "slow_db_query"), ("duration: 3.2 ms  statement: select", "INFO", "db_query"),
    ("Retry 2 after SocketTimeoutException", "WARN", "retry"), ("GC pause 30ms (allocation failure)", "INFO", "gc_pause"),
    ("health check failed: database connection timeout", "ERROR", "health_check_failed"),
    ("read from cache timed out", "WARN", "operation_timeout"), ("nothing special", "INFO", "unknown"),
])
def test_event_types(spark, message, level, expected):
    row = spark.createDataFrame([(message, level)], "m string, l string").select(classify(F.col("m"), F.col("l")).alias("e"))
    assert row.first()["e"] == expected


# One line for each rule, and one for lines that two rules would take; typed from the rules' meaning.
LINES = {
    "health check passed": "health_check_passed", "health probe ok in 3ms": "health_check_passed", "Health check UP": "health_check_passed",
    "readiness check failed": "health_check_failed", "Health check DOWN": "health_check_failed", "Health check timed out": "health_check_failed",
    "rolling update started": "deployment_started", "rolling update complete": "deployment_completed",
    "kubectl rollout restart": "service_restart", "deployment api restarted": "service_restart", "Booting worker 3": "service_started",
    "Started App in 4s": "service_started", "HorizontalPodAutoscaler grew": "autoscaling", "scaled from 2 to 4 replicas": "autoscaling",
    "configuration reloaded": "config_change", "config key pool.size": "config_change", "feature flag x on": "feature_flag_change",
    "job nightly started": "scheduled_job_started", "job nightly finished": "scheduled_job_finished", "Pause Full 3ms": "gc_pause",
    "memstats heap=3": "memory_stats", "Heap usage at 91%": "memory_pressure", "container OOMKilled": "oom_killed",
    "worker got SIGKILL": "process_killed", "WORKER TIMEOUT (pid 3)": "worker_timeout", "java.lang.OutOfMemoryError": "memory_allocation_failed",
    "event loop blocked": "event_loop_lag", "thread starvation seen": "thread_starvation", "Received GET /a": "request_started",
    "Slow request /a": "slow_request", "request failed path=/a": "request_failed", "request aborted by client": "client_disconnected",
    "Rate limit exceeded": "rate_limited", "Request validation failed": "request_validation_failed",
    "failed to acquire connection": "db_timeout", "Unable to acquire JDBC Connection": "db_connection_error",
    "waiting for database connection": "db_connection_wait", "pool status used=3": "db_pool_stats", "Retrying call": "retry",
    "orders did not respond within 3s": "downstream_timeout", "upstream connect error": "downstream_error",
    "upstream orders slow": "downstream_slow", "Circuit breaker opened": "circuit_breaker_state_change", "ejecting host h1": "host_ejected",
    "host returned to cluster web after ejection": "host_restored", "cluster web: 3 healthy hosts": "upstream_cluster_status",
    "serving fallback response": "fallback_response", "still waiting for ShareLock": "db_lock_wait",
    "canceling statement due to conflict": "db_statement_cancelled", "checkpoint complete": "db_maintenance",
    "connection authorized": "db_connection_opened", "disconnection: session": "db_connection_closed",
    "terminating connection due to command": "db_connection_terminated", "could not receive data from client": "db_client_connection_reset",
    "slow query table=t": "slow_db_query", "query ok rows=3": "db_query", "duplicate key value": "db_error",
    "cache hit ratio 0.9": "cache_stats", "cache hit key=1": "cache_hit", "cache miss key=1": "cache_miss",
    "cache write failed": "cache_error", "order 12 created": "business_operation", "Payment p1 captured": "business_operation",
    "card declined by issuer": "business_warning", "Refund for payment p1 rejected": "business_error",
    "failed to publish event": "message_publish_failed", "Unhandled exception in x": "application_error", "TLS handshake error": "tls_error",
    "token for client 3 expires soon": "auth_token_expiring", "calling deprecated endpoint": "deprecated_api_call",
    "context deadline exceeded": "operation_timeout", "plain words": "unknown",
    # The first rule wins: a probe that mentions the database, a retry after a timeout, a pool wait that timed out.
    "health probe failed: database connection timeout": "health_check_failed", "retry after Read timed out": "retry",
    "QueuePool limit of size 5 timed out": "db_timeout", "Slow request, retrying": "slow_request", "cache hit timed out": "cache_hit",
    "upstream error 503 from x, context deadline exceeded": "downstream_error", "duration: 3 ms  statement: retry": "db_query",
    '"GET /a HTTP/1.1" 200 upstream=cache miss': "request_completed", "GET /healthz 200": "health_check_passed",
}


def test_every_rule_by_hand(spark):
    rows = spark.createDataFrame([(m, "INFO") for m in LINES], "m string, l string")
    got = {r["m"]: r["e"] for r in rows.select("m", classify(F.col("m"), F.col("l")).alias("e")).collect()}
    assert {m: (got[m], want) for m, want in LINES.items() if got[m] != want} == {}


def test_any_white_space_around_a_level_is_ignored(spark):
    table = spark.createDataFrame([("\tWarn\r\n",), (" info\u00a0",), ("\x1cERROR\x85",), ("WARN ING",)], "l string")
    assert [r["l"] for r in table.select(normalize_level(F.col("l")).alias("l")).collect()] == ["WARN", "INFO", "ERROR", None]


def test_equal_line_numbers_in_two_files_stay_two_lines(spark, tmp_path):
    """Two config changes on line 1 of two files of one incident are two items."""
    from pyrewatch.operators.correlate import collapse_logs

    change = {**GOOD, "level": "INFO"}
    write_lines(tmp_path / "logs/INC-001-a.jsonl", [{**change, "message": "config key a set"}, {**change, "message": "config key b set"}])
    write_lines(tmp_path / "logs/INC-001-b.jsonl", [{**change, "message": "config key c set"}])
    valid, _ = log_source.ingest_logs(log_source.read_log_lines(spark, str(tmp_path / "logs")), F.lit("INC-001"))
    assert [r["seq"] for r in collect(valid, "seq")] == [1, 2, (1 << 40) + 1]
    collapsed = collapse_logs(valid).collect()
    assert sorted((r["message"], r["occurrence_count"]) for r in collapsed) == [
        ("config key a set", 1), ("config key b set", 1), ("config key c set", 1)]


def test_quoted_cells(spark, tmp_path):
    row = ROW.replace("api", "{}")
    write_lines(tmp_path / "m/INC-001.csv", [
        HEADER.replace("service", '"service"'), row.format(0, '"payment-api"', 1), row.format(1, '"a,b"', 2), row.format(2, '"say ""hi"""', 3),
        row.format(3, "plain", '"4"'), row.format(4, '""', 5), row.format(5, "x", " 6\t") + "\r"])
    cells, problems = metric_source.read_metric_cells(spark, str(tmp_path / "m"))
    checked = metric_source.check_metric_cells(cells)
    assert problems.count() == 0
    assert [(r["row_no"], r["service"], r["reasons"]) for r in collect(checked, "row_no")] == [
        (2, "payment-api", []), (3, "a,b", []), (4, 'say "hi"', []), (5, "plain", []), (6, "", ["service: empty or missing"]), (7, "x", [])]


def test_collections_are_replaced_by_version(spark, tmp_path):
    path = str(tmp_path / "c")
    first = reports.replace_collection(spark.createDataFrame([("a",), ("b",), ("b",)], "id string"), path).first()
    assert (first["version"], first["documents"], first["ids"]) == (1, 3, 2)
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("id"))
    with pytest.raises(Exception):
        reports.replace_collection(broken, path)
    assert sorted(r["id"] for r in reports.read_collection(spark, path).collect()) == ["a", "b", "b"]
    assert reports.replace_collection(spark.createDataFrame([("z",)], "id string"), path).first()["version"] == 2
    assert [r["id"] for r in reports.read_collection(spark, path).collect()] == ["z"]


def test_text_and_time_columns(spark):
    row = spark.createDataFrame([("id 4f2a9c took 12.5 ms", " Warning ", 2.25, 0.15, "2026-01-01T00:00:00.5")],
                                "m string, l string, a double, b double, t string")
    out = row.select(
        template_of(F.col("m")).alias("m"), normalize_level(F.col("l")).alias("l"), fixed(F.col("a"), 1).alias("a"),
        fixed(F.col("b"), 1).alias("b"), iso_text(parse_iso(F.col("t"))).alias("t"), clip(F.lit("a  b" * 20), 10).alias("c"),
        parse_iso(F.lit("2026")).alias("year"), parse_iso(F.lit("2026-01-01T00:00:00Z")).alias("zone"),
        parse_iso(F.lit("2026-13-01")).alias("month")).first()
    assert (out["m"], out["l"]) == ("id # took # ms", "WARN")
    assert (out["a"], out["b"]) == (f"{2.25:.1f}", f"{0.15:.1f}")
    assert out["t"] == "2026-01-01T00:00:00.500000"
    assert out["c"] == "a ba ba..."
    assert (out["year"], out["zone"], out["month"]) == (None, None, None)


HEADER = "timestamp,incident_id,service,cpu_usage,memory_usage,request_rate,latency_ms,error_rate,db_connection_utilization,downstream_latency_ms"
ROW = "2026-01-01T00:0{}:00,INC-001,api,{},50,10,100,0.5,,"


def test_metric_files(spark, tmp_path):
    write_lines(tmp_path / "m/INC-001.csv", [HEADER, ROW.format(0, 1), ROW.format(1, "abc"), ROW.format(2, ""), ROW.format(3, 150),
                                             ROW.format(4, "nan"), ROW.format(5, 7), ROW.format(5, 8), "x" + ROW.format(6, 1)])
    write_lines(tmp_path / "m/INC-002.csv", [HEADER, ROW.format(0, "1e1").replace("INC-001", "INC-002")])
    write_lines(tmp_path / "m/INC-003.csv", [HEADER.replace("cpu_usage", "cpu"), "x"])
    write_lines(tmp_path / "m/INC-004.csv", [HEADER])
    cells, problems = metric_source.read_metric_cells(spark, str(tmp_path / "m"))
    valid, rejected = metric_source.ingest_metrics(cells, F.regexp_extract("path", r"(INC-\d+)\.csv", 1))
    assert {r["location"]: r["reason"] for r in collect(rejected, "location_no")} == {
        "row 3": "cpu_usage: not a number", "row 4": "cpu_usage: blank but required", "row 5": "cpu_usage: above 100",
        "row 6": "cpu_usage: not finite", "row 8": "duplicate row for api at 2026-01-01T00:05:00 (first seen in row 7)",
        "row 9": "timestamp: not a zone-free ISO time"}
    rows = collect(valid, "incident_id")
    assert [(r["incident_id"], r["cpu_usage"], r["db_connection_utilization"]) for r in rows] == [("INC-002", 10.0, None)]
    assert {(r["location"], r["reason"]) for r in collect(problems, "path")} == {
        ("header", "missing columns cpu_usage; unexpected columns cpu"), ("file", "contains no metric rows")}


CASE = {"incident_id": "INC-001", "title": "t", "scenario": "MEMORY_LEAK", "service": "api", "severity": "HIGH",
        "start_time": "2026-01-01T01:00:00", "end_time": "2026-01-01T02:00:00", "duration_minutes": 60.0,
        "window_start": "2026-01-01T00:00:00", "window_end": "2026-01-01T03:00:00", "description": "d",
        "true_root_cause": "MEMORY_LEAK", "root_cause_service": "api", "root_cause_variant": "v", "root_cause_detail": "x",
        "fault_start_time": "2026-01-01T00:50:00", "expected_symptoms": ["s"], "affected_services": ["api"], "resolution": "r",
        "evidence_files": {"logs": "l", "metrics": "m"}}


def test_incident_documents(spark, tmp_path):
    cases = {"INC-001": CASE, "INC-002": CASE, "INC-003": {**CASE, "incident_id": "INC-003", "pager": 1},
             "INC-004": {**CASE, "incident_id": "INC-004", "scenario": "NORMAL"},
             "INC-005": {**CASE, "incident_id": "INC-005", "end_time": "2026-01-01T00:30:00"}}
    for name, record in cases.items():
        write_lines(tmp_path / f"i/{name}.json", [record])
    checked = docs.check_incident_documents(docs.read_documents(spark, str(tmp_path / "i")))
    reasons = {r["stem"]: r["reasons"] for r in collect(checked, "stem")}
    assert reasons["INC-001"] == []
    assert reasons["INC-002"] == ["incident_id: differs from the file name"]
    assert reasons["INC-003"] == ["unrecognized fields: pager"]
    assert reasons["INC-004"] == ["labels: a NORMAL case has fault fields"]
    assert reasons["INC-005"] == ["times: expected window_start <= start_time <= end_time <= window_end"]
    context, labels = docs.incident_context(checked), docs.incident_labels(checked)
    docs.assert_disjoint(context, labels)
    assert q.label_columns(context) == []
    assert [r["incident_id"] for r in collect(labels, "incident_id")] == ["INC-001"]
    assert docs.incident_ids(docs.read_documents(spark, str(tmp_path / "i"))).count() == 5


def test_reports_replace_only_their_incidents(spark, tmp_path):
    path = str(tmp_path / "r")
    reports.write_reports(spark.createDataFrame([("A", 1), ("B", 2)], "incident_id string, n int"), path)
    reports.write_reports(spark.createDataFrame([("B", 3)], "incident_id string, n int"), path)
    assert {(r["incident_id"], r["n"]) for r in reports.read_reports(spark, path).collect()} == {("A", 1), ("B", 3)}


def test_manifest_and_summary_files(spark, tmp_path):
    write_lines(tmp_path / "f/a.txt", ["a"])
    write_lines(tmp_path / "f/b.txt", ["b"])
    files = reports.file_digests(spark, str(tmp_path / "f")).withColumn("path", F.element_at(F.split("path", "/"), -1))
    manifest = files.where("path = 'a.txt'").select("path", F.lit("0").alias("digest")).unionByName(
        spark.createDataFrame([("c.txt", "1")], "path string, digest string"))
    assert {r["path"]: r["problem"] for r in reports.manifest_audit(files, manifest).collect()} == {
        "a.txt": "checksum differs from manifest", "b.txt": "not listed in manifest", "c.txt": "listed in manifest but missing"}
    table = spark.createDataFrame([(1.23456, float("nan"))], "a double, b double")
    reports.write_summary(table, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).collect()[0].asDict() == {"a": 1.2346}


def test_check_report_shows_five_and_counts_all(spark):
    found = spark.range(9).select(F.lit("many").alias("name"), F.col("id").cast("string").alias("problem"))
    out = {r["name"]: r for r in collect(q.report(found, ["many", "none"]), "name")}
    assert (out["many"]["ok"], out["many"]["n_problems"], out["many"]["samples"]) == (False, 9, ["0", "1", "2", "3", "4"])
    assert (out["none"]["ok"], out["none"]["samples"]) == (True, [])
    assert q.verdict(q.report(found, ["many", "none"])).first().asDict() == {"ok": False, "passed": 1, "total": 2}


def test_case_checks_are_strict_about_times(spark):
    cases = incident(spark, start=40, end=40)
    labels = spark.createDataFrame([("INC-001", "MEMORY_LEAK", minute(60))], "incident_id string, scenario string, fault_start_time timestamp_ntz")
    found = {(r["name"], r["problem"]) for r in q.case_problems(cases, labels, {"MEMORY_LEAK": 1, "NORMAL": 1}).collect()}
    assert found == {("times out of order", "INC-001"), ("fault outside window_start..start", "INC-001"), ("too few cases", "NORMAL=0")}


def test_line_numbers_over_many_splits(spark, tmp_path):
    from pyrewatch.sources.lines import read_lines

    for name, n in (("a", 4000), ("b", 3), ("c", 900)):
        write_lines(tmp_path / f"t/{name}.txt", [f"{name} {i} " + "x" * (i % 40) for i in range(1, n + 1)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        lines = read_lines(spark, str(tmp_path / "t"))
        assert lines.count() == 4903
        wrong = lines.where(F.split("line", " ")[1].cast("long") != F.col("line_no"))
        assert wrong.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def records_of(text):
    """Records of a text by one scan: a line break counts outside quotes only."""
    out, current, quoted = [], "", False
    for letter in text:
        quoted ^= letter == '"'
        if letter == "\n" and not quoted:
            out.append(current)
            current = ""
        else:
            current += letter
    return [*out, current] if current else out


@pytest.mark.parametrize("split", [1, 7, 40, 1000])
def test_records_with_line_breaks_over_many_splits(spark, tmp_path, split):
    import random

    from pyrewatch.sources.lines import read_records

    draw = random.Random(split)
    texts = {"plain": "a,b\n1,2\n3,4\n"}
    for name in ("x", "y", "z"):
        rows = [",".join(draw.choice(['"a\nb"', '"\n"', "7", '""', '"say ""hi""\n,\n"', "word", '"x,y"', '"\n\n\n"']) for _ in range(3))
                for _ in range(40)]
        texts[name] = "\n".join(rows) + ("\n" if name != "z" else "")
    for name, text in texts.items():
        (tmp_path / "t").mkdir(exist_ok=True)
        (tmp_path / f"t/{name}.csv").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        found = read_records(spark, str(tmp_path / "t")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, text in texts.items():
        own = sorted((r["row_no"], r["line"]) for r in found if r["path"].endswith(f"/{name}.csv"))
        assert own == list(enumerate(records_of(text), 1)), name


def test_quotes_that_never_close(spark, tmp_path):
    from pyrewatch.sources.lines import read_records

    write_lines(tmp_path / "m/INC-001.csv", [HEADER, ROW.format(0, 1), 'x,"open', *["more"] * 30])
    write_lines(tmp_path / "m/INC-002.csv", [HEADER, ROW.format(0, 1).replace("INC-001", "INC-002").replace("api", '"a\n\nb"')])
    cells, problems = metric_source.read_metric_cells(spark, str(tmp_path / "m"))
    assert [(r["location"], r["reason"]) for r in problems.collect()] == [("row 3", "a quote is not closed within 31 lines")]
    assert {(r["row_no"], r["service"]) for r in cells.collect()} == {(2, "a\n\nb")}
    long = read_records(spark, str(tmp_path / "m/INC-002.csv"), most_lines=2).where("line is null").collect()
    assert [(r["row_no"], r["lines"]) for r in long] == [(2, 3)]


def test_cells_of_a_record(spark):
    texts = {'a,"b,c",d': ["a", "b,c", "d"], '"x""y",,': ['x"y', "", ""], '"l1\nl2",2\r': ["l1\nl2", "2"], "": [""], '""': [""]}
    table = spark.createDataFrame([(t,) for t in texts], "line string")
    assert {r["line"]: r["cells"] for r in table.select("line", metric_source.csv_cells(F.col("line")).alias("cells")).collect()} == texts


def test_digests_of_large_files_are_streamed(spark, tmp_path):
    """Files over the limit are read in splits and hashed in order: no last line break, a mark in front, bytes that are no text."""
    import hashlib
    import random

    draw = random.Random(8)
    contents = {"small": b"a\n", "lines": b"".join(b"line %d\r\n" % i for i in range(900)), "open": b"x\n" * 700 + b"end",
                "mark": b"\xef\xbb\xbf" + b"y\n" * 800, "bytes": bytes(draw.randrange(256) for _ in range(9000)), "breaks": b"\n" * 1500,
                "mark only in front": b"\xef\xbb\xbf" + b"z" * 1200}
    (tmp_path / "d/deep").mkdir(parents=True)
    for i, (name, data) in enumerate(contents.items()):
        (tmp_path / ("d/deep" if i % 2 else "d") / f"{name}.bin").write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        found = reports.file_digests(spark, str(tmp_path / "d"), whole=1000).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {r["path"].split("/")[-1].removesuffix(".bin").replace("%20", " "): (r["length"], r["digest"]) for r in found}
    assert got == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in contents.items()}


def test_two_writers_replace_a_collection(spark, tmp_path):
    """Writers at once get numbers of their own, and no version is lost."""
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "collection")

    def write(n):
        return reports.replace_collection(spark.range(n).withColumnRenamed("id", "id"), path).first().asDict()

    with ThreadPoolExecutor(4) as pool:
        rows = list(pool.map(write, range(1, 9)))
    assert sorted(r["version"] for r in rows) == list(range(1, 9))
    assert {(r["version"], r["documents"]) for r in reports.read_versions(spark, path).collect()} == {(r["version"], r["documents"]) for r in rows}
    newest = max(rows, key=lambda r: r["version"])
    assert reports.read_collection(spark, path).count() == newest["documents"]


def test_a_run_that_fails_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "collection")
    with pytest.raises(Exception):
        reports.replace_collection(spark.range(3).select(F.raise_error(F.lit("lost")).alias("id")), path)
    first = reports.replace_collection(spark.range(3), path).first()
    assert (first["version"], first["documents"], first["ids"]) == (1, 3, 3)
    (tmp_path / "collection/versions/000000000002.json").touch()  # a writer that died behind its claim
    (tmp_path / "collection/rows-lost").mkdir()
    assert reports.read_collection(spark, path).count() == 3
    assert reports.replace_collection(spark.range(5), path).first()["version"] == 3
    assert reports.remove_unnamed(spark, path) == 0
    assert reports.remove_unnamed(spark, path, older_than_hours=-1) >= 1
    assert not (tmp_path / "collection/rows-lost").exists() and reports.read_collection(spark, path).count() == 5


def test_technical_notes(spark, tmp_path, monkeypatch):
    """Four notes are read whole; one may be a folder; a missing and a very large one are errors before anything is read."""
    for name in docs.NOTE_NAMES[:3]:
        (tmp_path / name).write_text(f"# {name}\r\n## One\ntext")
    with pytest.raises(Exception, match="troubleshooting.md"):
        docs.read_notes(spark, str(tmp_path)).collect()
    (tmp_path / "troubleshooting.md").mkdir()
    (tmp_path / "troubleshooting.md/part-0.txt").write_text("## Two\nmore")
    notes = {r["document_name"]: r["text"] for r in docs.read_notes(spark, f"{tmp_path}/").collect()}
    assert notes == {**{n: f"# {n}\r\n## One\ntext" for n in docs.NOTE_NAMES[:3]}, "troubleshooting.md": "## Two\nmore"}
    monkeypatch.setattr(docs, "NOTE_BYTES", 20)
    with pytest.raises(ValueError, match="memory.md"):
        docs.read_notes(spark, str(tmp_path))


def test_bundles_hold_many_documents(spark, tmp_path):
    texts = {"HIST-001": '{"incident_id": "HIST-001", "title": "t"}', "HIST-002": '{"incident_id": "HIST-009"}', "HIST-003": 'no "object"\n\r\t\u0001é'}
    table = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "stem string, text string, extra int").coalesce(1)
    docs.write_bundles(table, str(tmp_path / "b"))
    found = docs.read_bundles(spark, str(tmp_path / "b"))
    assert {r["stem"]: r["text"] for r in found.collect()} == texts and len(found.inputFiles()) == 1
    reasons = {r["stem"]: r["reasons"] for r in docs.parse_postmortems(found).collect()}
    assert reasons == {"HIST-001": [], "HIST-002": ["incident_id: differs from the file name"], "HIST-003": ["not a JSON object"]}
    write_lines(tmp_path / "w/HIST-001.json", [texts["HIST-001"]])
    assert [(r["stem"], r["title"]) for r in docs.parse_postmortems(docs.read_documents(spark, str(tmp_path / "w"))).collect()] == [("HIST-001", "t")]


def incident_folder(tmp_path):
    for i in (1, 2, 3):
        write_lines(tmp_path / f"logs/INC-00{i}.jsonl", [f"{i} line {n} " + "é" * (n % 30) for n in range(1, 60 * i)])
        write_lines(tmp_path / f"metrics/of=INC-00{i}/part-0.csv", [HEADER, ROW.format(i, 1)])
        write_lines(tmp_path / f"incidents/INC-00{i}.json", [{**CASE, "incident_id": f"INC-00{i}"}])
        write_lines(tmp_path / f"postmortems/HIST-00{i}.json", ['{"incident_id": "HIST-00%d",\r' % i, '"title": "t"}'])
    (tmp_path / "logs/_SUCCESS").write_text("")
    (tmp_path / "logs/INC-009.jsonl").write_text("")
    return str(tmp_path)


@pytest.mark.parametrize("split_bytes", [1, 50, 1 << 20])
def test_a_folder_is_planned_by_file_and_offset(tmp_path, split_bytes):
    """Every line is read once, whatever the ranges are."""
    from pyrewatch.sources.folder import FolderReader

    reader = FolderReader(incident_folder(tmp_path), split_bytes)
    parts = reader.partitions()
    assert max(sum(stop - start for _, _, start, stop in p.pieces) for p in parts if len(p.pieces) > 1 or p.kind == "logs") <= max(split_bytes, 1)
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    for i in (1, 2, 3):
        want = (tmp_path / f"logs/INC-00{i}.jsonl").read_text(encoding="utf-8").splitlines()
        own = [r["value"] for r in sorted((r for r in rows if r["kind"] == "logs" and r["incident_id"] == f"INC-00{i}"), key=lambda r: (r["split"], r["place"]))]
        assert own == want
    assert sorted((r["incident_id"], r["value"].count("\n")) for r in rows if r["kind"] == "postmortems") == [(f"HIST-00{i}", 2) for i in (1, 2, 3)]


def test_a_folder_prunes_files_by_incident(spark, tmp_path):
    from pyrewatch.session import ship_package
    from pyrewatch.sources import folder

    path = incident_folder(tmp_path)
    reader = folder.FolderReader(path, kinds=["logs"], incidents=["INC-001", "INC-003"])
    assert sorted(p[0].rsplit("/", 1)[1] for part in reader.partitions() for p in part.pieces) == ["INC-001.jsonl", "INC-003.jsonl"]
    with pytest.raises(ValueError, match="traces"):
        folder.FolderReader(path, kinds=["traces"])
    ship_package(spark)
    lines = folder.numbered(folder.read_folder(spark, path, ["logs"], ["INC-002", "INC-003"], 200))
    assert lines.where(F.split("line", " ")[2].cast("long") != F.col("line_no")).count() == 0
    assert {(r["incident_id"], r["count"]) for r in lines.groupBy("incident_id").count().collect()} == {("INC-002", 119), ("INC-003", 179)}
    few, every = folder.read_folder(spark, path, ["incidents"], ["INC-001"], 200), folder.read_folder(spark, path, ["logs"], split_bytes=200)
    assert few.rdd.getNumPartitions() == 1 and every.rdd.getNumPartitions() > 10
    both = folder.read_folder(spark, path, ["incidents"]).unionByName(folder.read_folder(spark, path, ["metrics"]))
    assert {(r["kind"], r["count"]) for r in both.groupBy("kind").count().collect()} == {("incidents", 3), ("metrics", 6)}
    checked = docs.check_incident_documents(folder.documents_of(folder.read_folder(spark, path, ["incidents"])))
    assert {r["stem"]: r["reasons"] for r in checked.collect()} == {f"INC-00{i}": [] for i in (1, 2, 3)}
    assert folder.read_folder(spark, path, incidents=["INC-777"]).count() == 0


def test_orphans_come_from_one_aggregate(spark):
    """Both sides are read once and no join sorts them; a null is alone on either side."""
    from pyrewatch.operators.quality import orphans

    ours = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "incident_id string")
    known = spark.createDataFrame([("b",), ("c",), ("c",), (None,)], "incident_id string")
    found = orphans(ours, known)
    assert sorted((r["incident_id"] or "", r["problem"]) for r in found.collect()) == [
        ("", "no evidence"), ("", "unknown incident"), ("a", "unknown incident"), ("c", "no evidence")]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_issue_report_limits_ranks_before_the_shuffle(spark):
    from pyrewatch.sources.reports import issue_report

    rows = [("a", i, f"line {i}", "bad", None) for i in range(1, 13)] + [("b", 1, "line 1", "bad", "INC-001")]
    found = issue_report(spark.createDataFrame(rows, "path string, location_no long, location string, reason string, incident_id string"))
    texts = {r["path"]: (r["problems"], r["message"]) for r in found.collect()}
    assert texts["b"] == (1, "b: 1 problem(s)\n  - line 1 [INC-001]: bad")
    assert texts["a"][0] == 12 and texts["a"][1].endswith("  - line 10: bad\n  - ... 2 more")
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
