"""Small hand-made inputs."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F

START = dt.datetime(2026, 1, 1)


def minute(n: float) -> dt.datetime:
    return START + dt.timedelta(minutes=n)


def noise(i: int, amplitude: float) -> float:
    return amplitude * math.sin(1.7 * i) * math.cos(0.3 * i)


def series(spark, values, metric="cpu_usage", incident="INC-001", service="payment-api", every=1):
    rows = [(incident, service, metric, minute(i * every), float(v)) for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(
        rows, "incident_id string, service string, metric_name string, timestamp timestamp_ntz, value double")


def log(offset, service="payment-api", event_type="request_failed", level="ERROR", message="failed", seq=None,
        incident="INC-001"):
    return (incident, minute(offset), service, level, message, event_type, seq if seq is not None else int(offset * 1000))


LOGS = "incident_id string, timestamp timestamp_ntz, service string, level string, message string, event_type string, seq long"
INCIDENTS = ("incident_id string, title string, service string, severity string, start_time timestamp_ntz, "
             "end_time timestamp_ntz, window_start timestamp_ntz, window_end timestamp_ntz, description string, "
             "duration_minutes double")


def logs(spark, *rows):
    return spark.createDataFrame(list(rows), LOGS)


def incident(spark, start=40, end=70, opened=0, closed=120, incident_id="INC-001", service="payment-api"):
    return spark.createDataFrame(
        [(incident_id, "payment alert", service, "HIGH", minute(start), minute(end), minute(opened), minute(closed),
          "Checkouts fail", float(end - start))], INCIDENTS)


def points(spark, *rows, incident="INC-001"):
    """rows: (minute, service, metric, z, severity)."""
    data = [(incident, minute(m), s, k, 10.0, 5.0, 1.0, 15, float(z) if z is not None else None, 5.0, "up", sev,
             "rolling_zscore", False) for m, s, k, z, sev in rows]
    from pyrewatch.schemas import ANOMALY_POINT

    return spark.createDataFrame(data, ANOMALY_POINT)


def collect(df, *order):
    return [r.asDict(recursive=True) for r in df.orderBy(*[F.col(c) for c in order]).collect()]
