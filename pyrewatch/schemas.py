"""Table schemas and the fixed vocabularies shared by all jobs."""

from __future__ import annotations

from pyspark.sql import types as T

# Metric columns, in report order.
METRICS = (
    "cpu_usage", "memory_usage", "request_rate", "latency_ms", "error_rate",
    "db_connection_utilization", "downstream_latency_ms",
)
NULLABLE_METRICS = ("db_connection_utilization", "downstream_latency_ms")
PERCENT_METRICS = ("cpu_usage", "memory_usage", "error_rate", "db_connection_utilization")
METRIC_COLUMNS = ("timestamp", "incident_id", "service", *METRICS)

# Metric names in plain language.
METRIC_LABELS = {
    "cpu_usage": "CPU usage",
    "memory_usage": "memory usage",
    "request_rate": "request rate",
    "latency_ms": "latency",
    "error_rate": "error rate",
    "db_connection_utilization": "database connection utilization",
    "downstream_latency_ms": "downstream latency",
}

# Closed sets.
LEVELS = ("INFO", "WARN", "ERROR")
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
FAILURES = ("DB_CONNECTION_POOL_EXHAUSTION", "MEMORY_LEAK", "DOWNSTREAM_SERVICE_TIMEOUT")
NORMAL = "NORMAL"
SCENARIOS = (*FAILURES, NORMAL)
INCIDENT_ID_PATTERN = r"^INC-\d{3,}$"
INSUFFICIENT = "INSUFFICIENT_EVIDENCE"

# Which fields of an incident record the on-call engineer may see, and which are labels.
CONTEXT_FIELDS = (
    "incident_id", "title", "service", "severity", "start_time", "end_time", "duration_minutes",
    "window_start", "window_end", "description",
)
LABEL_FIELDS = (
    "incident_id", "scenario", "true_root_cause", "root_cause_service", "root_cause_variant",
    "root_cause_detail", "fault_start_time", "expected_symptoms", "affected_services", "resolution",
)
FILE_FIELDS = ("evidence_files",)

# Event types by role.
CHANGE_EVENTS = (
    "deployment_started", "deployment_completed", "service_restart", "service_started", "autoscaling",
    "config_change", "feature_flag_change", "scheduled_job_started", "scheduled_job_finished",
)
RARE_EVENTS = CHANGE_EVENTS + (
    "oom_killed", "process_killed", "worker_timeout", "memory_allocation_failed",
    "circuit_breaker_state_change", "host_ejected", "host_restored",
)
COLLAPSED_EVENTS = (
    "request_failed", "slow_request", "request_client_error", "downstream_timeout", "downstream_error",
    "downstream_slow", "db_timeout", "db_connection_error", "db_connection_wait", "db_error", "db_lock_wait",
    "db_statement_cancelled", "db_connection_terminated", "db_client_connection_reset", "operation_timeout",
    "retry", "fallback_response", "slow_db_query", "application_error", "health_check_failed",
    "memory_pressure", "event_loop_lag", "thread_starvation", "cache_error", "message_publish_failed",
    "business_error", "client_disconnected", "rate_limited",
)
OTHER_RELEVANT_EVENTS = ("tls_error", "auth_token_expiring", "deprecated_api_call")
RELEVANT_EVENTS = RARE_EVENTS + COLLAPSED_EVENTS + OTHER_RELEVANT_EVENTS
DEPLOY_EVENTS = ("deployment_started", "deployment_completed")
RESTART_EVENTS = ("service_restart", "oom_killed", "process_killed", "service_started")
CHANGE_ONLY_EVENTS = (
    "config_change", "feature_flag_change", "autoscaling", "scheduled_job_started", "scheduled_job_finished",
)
TIMEOUT_EVENTS = ("db_timeout", "downstream_timeout", "operation_timeout", "worker_timeout")
HEALTH_EVENTS = ("health_check_failed",)
ERROR_EVENTS = (
    "request_failed", "downstream_error", "db_error", "db_connection_error", "application_error",
    "business_error", "cache_error", "message_publish_failed", "memory_allocation_failed",
)
# Event types a retrieval query names.
QUERY_EVENTS = (
    "db_timeout", "db_connection_error", "db_connection_wait", "db_pool_stats", "slow_db_query", "db_error",
    "db_lock_wait", "db_statement_cancelled", "downstream_timeout", "downstream_error", "downstream_slow",
    "retry", "circuit_breaker_state_change", "operation_timeout", "health_check_failed", "gc_pause",
    "memory_pressure", "memory_allocation_failed", "oom_killed", "memory_stats", "request_failed",
    "slow_request", "application_error",
)
QUERY_CHANGES = (
    "deployment_started", "deployment_completed", "config_change", "service_restart", "feature_flag_change",
    "autoscaling",
)

_S, _D, _N = T.StringType(), T.DoubleType(), T.TimestampNTZType()
_STRINGS = T.ArrayType(T.StringType())


def _struct(*pairs) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in pairs])


RAW_LOG = _struct(
    ("timestamp", _S), ("service", _S), ("host", _S), ("level", _S), ("logger", _S), ("message", _S),
    ("trace_id", _S), ("incident_id", _S), ("event_type", _S), ("_corrupt", _S),
)
RAW_METRIC = _struct(*((name, _S) for name in METRIC_COLUMNS))
RAW_INCIDENT = _struct(
    ("incident_id", _S), ("title", _S), ("scenario", _S), ("service", _S), ("severity", _S),
    ("start_time", _S), ("end_time", _S), ("duration_minutes", _D), ("window_start", _S), ("window_end", _S),
    ("description", _S), ("true_root_cause", _S), ("root_cause_service", _S), ("root_cause_variant", _S),
    ("root_cause_detail", _S), ("fault_start_time", _S), ("expected_symptoms", _STRINGS),
    ("affected_services", _STRINGS), ("resolution", _S),
    ("evidence_files", _struct(("logs", _S), ("metrics", _S))), ("_corrupt", _S),
)
STEP = _struct(("relative_time", _S), ("event", _S))
POSTMORTEM = _struct(
    ("incident_id", _S), ("title", _S), ("occurred_at", _S), ("service", _S), ("severity", _S),
    ("duration_minutes", T.LongType()), ("root_cause", _S), ("root_cause_service", _S),
    ("environment", _S), ("status", _S), ("symptoms", _STRINGS), ("observed_signals", _STRINGS),
    ("timeline", T.ArrayType(STEP)), ("contributing_factors", _STRINGS), ("resolution", _STRINGS),
    ("lessons_learned", _STRINGS), ("tags", _STRINGS), ("affected_services", _STRINGS),
)
ANOMALY_POINT = _struct(
    ("incident_id", _S), ("timestamp", _N), ("service", _S), ("metric_name", _S), ("value", _D),
    ("baseline_mean", _D), ("baseline_std", _D), ("baseline_points", T.LongType()), ("z_score", _D),
    ("deviation", _D), ("direction", _S), ("severity", _S), ("detection_method", _S),
    ("absolute_threshold_exceeded", T.BooleanType()),
)
_HYPOTHESIS = _struct(
    ("cause", _S), ("confidence", _D), ("supporting_evidence_ids", _STRINGS),
    ("contradicting_evidence_ids", _STRINGS), ("rationale", _S),
)
_REFERENCE = _struct(("evidence_id", _S), ("source_type", _S), ("short_description", _S))
RESULT = _struct(
    ("incident_id", _S), ("summary", _S), ("root_cause", _HYPOTHESIS), ("confidence", _D),
    ("alternative_causes", T.ArrayType(_HYPOTHESIS)), ("supporting_evidence", T.ArrayType(_REFERENCE)),
    ("contradicting_evidence", T.ArrayType(_REFERENCE)),
    ("timeline", T.ArrayType(_struct(("evidence_id", _S), ("timestamp", _S), ("description", _S)))),
    ("recommended_actions", T.ArrayType(_struct(("action", _S), ("rationale", _S), ("evidence_ids", _STRINGS)))),
    ("similar_incidents", T.ArrayType(_struct(("incident_id", _S), ("similarity_note", _S)))),
)
EVIDENCE = _struct(
    ("incident_id", _S), ("evidence_id", _S), ("timestamp", _N), ("service", _S), ("source_type", _S),
    ("evidence_type", _S), ("summary", _S), ("source_reference", _S), ("event_type", _S), ("metric_name", _S),
    ("severity", _S), ("occurrence_count", T.LongType()), ("last_timestamp", _N),
)
PACK = _struct(
    ("incident_id", _S), ("evidence_id", _S), ("source_type", _S), ("short_description", _S), ("detail", _S),
    ("timestamp", _S),
)
