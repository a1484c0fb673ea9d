"""The detector over a stream of observations, with the same points as the batch form.

State per series is its last ``window + lag`` accepted values and the time of its last scored row. A row that is not later
than that is dropped. The source's rate limit (files or offsets per trigger) bounds what one call holds.

Without ``late`` rows are scored as they come, those of one trigger in time order. With ``late`` they wait, sorted, in the
state of their series until the watermark has passed them, and a timer lets them go, so input in any order within that time
gives the batch points. A series that has been silent for ``keep_hours`` starts anew, and its state goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pyrewatch.config import DetectorSettings
from pyrewatch.operators.detector import Walk
from pyrewatch.operators.scoring import POINT_COLUMNS
from pyrewatch.operators.series import SERIES
from pyrewatch.schemas import ANOMALY_POINT

#: Rows of one trigger that are scored at once.
CUT_ROWS = 50_000

_STATE = T.StructType([
    T.StructField("accepted", T.ArrayType(T.DoubleType())), T.StructField("last", T.LongType())])
_WAITING = T.StructType([*_STATE, T.StructField("times", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.DoubleType()))])


def _advance(settings: DetectorSettings):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        remembered, last = state.get if state.exists else ([], None)
        walk = Walk(settings)
        walk.accepted[tuple(key)] = [float(v) for v in remembered]
        for rows in _in_order(batches):
            times = rows["timestamp"].astype("datetime64[us]").astype("int64")
            later = ~times.duplicated() & (True if last is None else times > last)
            rows = rows[later]
            if rows.empty:
                continue
            last = int(times[later].max())
            yield walk.batch(rows)[POINT_COLUMNS]
        if last is not None:
            state.update((walk.accepted[tuple(key)], last))
    return step


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a key's trigger by time. Only times and values are held, sixteen bytes a row, and cut up again."""
    parts = [b[[*SERIES, "timestamp", "value"]] for b in batches]
    keys = parts[0].iloc[0][SERIES].to_dict()
    times = np.concatenate([p["timestamp"].to_numpy() for p in parts])
    values = np.concatenate([p["value"].to_numpy() for p in parts])
    del parts
    order = times.argsort(kind="stable")
    for at in range(0, len(order), CUT_ROWS):
        some = order[at: at + CUT_ROWS]
        yield pd.DataFrame({**{c: [v] * len(some) for c, v in keys.items()}, "timestamp": times[some], "value": values[some]})


def _release(settings: DetectorSettings, keep_ms: int):
    """Rows wait until the watermark has passed them, then they are scored in order."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accepted, last, times, values = state.get if state.exists else ([], None, [], [])
        parts = [b[["timestamp", "value"]] for b in batches if len(b)]
        at = np.concatenate([np.array(times, dtype=np.int64), *[p["timestamp"].to_numpy().astype("datetime64[us]").astype(np.int64) for p in parts]])
        value = np.concatenate([np.array(values, dtype=float), *[p["value"].to_numpy(dtype=float) for p in parts]])
        at, first = np.unique(at, return_index=True)  # of rows with one time the first one that came
        value = value[first]
        if last is not None:
            value, at = value[at > last], at[at > last]
        mark = state.getCurrentWatermarkMs()
        ready = int(np.searchsorted(at, mark * 1000))
        walk = Walk(settings)
        walk.accepted[tuple(key)] = [float(v) for v in accepted]
        before = np.concatenate([[at[0] if last is None else last], at[:ready - 1]]) if ready else at[:0]
        anew = set(np.flatnonzero(at[:ready] - before > keep_ms * 1000).tolist())
        cuts = sorted({*range(0, ready, CUT_ROWS), *anew, ready})
        for start, stop in pairwise(cuts):
            some = slice(start, stop)
            if start in anew:
                walk.accepted[tuple(key)] = []
            rows = pd.DataFrame({**{c: [k] * (some.stop - start) for c, k in zip(SERIES, key, strict=True)},
                                 "timestamp": at[some].astype("datetime64[us]"), "value": value[some]})
            yield walk.batch(rows)[POINT_COLUMNS]
        last = int(at[ready - 1]) if ready else last
        at, value = at[ready:], value[ready:]
        if not len(at) and (last is None or mark > last // 1000 + keep_ms):
            if state.exists:
                state.remove()
            return
        state.update((walk.accepted[tuple(key)], last, at.tolist(), value.tolist()))
        state.setTimeoutTimestamp(max(mark + 1, int(at[0]) // 1000 if len(at) else last // 1000 + keep_ms))
    return step


def detect_stream(series: DataFrame, settings: DetectorSettings | None = None, late: str | None = None, keep_hours: float = 24 * 7) -> DataFrame:
    """Anomaly points of a streaming series table (incident, service, metric, timestamp, value).

    With ``late``, such as ``"10 minutes"``, rows may come that much behind the newest one; later ones are dropped. The watermark
    needs a zoned time, so run such a stream with the session time zone set to UTC.
    """
    settings = settings or DetectorSettings()
    rows = series.where(F.col("metric_name").isin(*settings.active_rules)).select(*SERIES, "timestamp", "value")
    if late is None:
        return rows.groupBy(*SERIES).applyInPandasWithState(
            _advance(settings), ANOMALY_POINT, _STATE, "append", GroupStateTimeout.NoTimeout)
    marked = rows.withColumn("_event_time", F.col("timestamp").cast("timestamp")).withWatermark("_event_time", late)
    return marked.groupBy(*SERIES).applyInPandasWithState(
        _release(settings, round(keep_hours * 3_600_000)), ANOMALY_POINT, _WAITING, "append", GroupStateTimeout.EventTimeTimeout)


def stream_windows(points: DataFrame, max_gap_minutes: float = 2.0, late: str = "10 minutes") -> DataFrame:
    """Anomaly windows of a stream of points, emitted when the watermark has passed the gap.

    Spark closes a session when the next point is more than the gap away, the same rule as the batch form. The
    watermark needs a zoned time, so run the stream with the session time zone set to UTC.
    """
    gap = f"{max_gap_minutes * 60:.0f} seconds"
    marked = points.withColumn("_event_time", F.col("timestamp").cast("timestamp")).withWatermark("_event_time", late)
    grouped = marked.groupBy("incident_id", F.session_window("_event_time", gap).alias("_session"))
    sessions = grouped.agg(
        F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.count("*").alias("anomaly_count"),
        F.array_sort(F.collect_set("service")).alias("affected_services"),
        F.array_sort(F.collect_set("metric_name")).alias("affected_metrics"))
    return sessions.drop("_session")
