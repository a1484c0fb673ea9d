"""The detector with feedback: a flagged observation does not enter later baselines.

Whether an observation joins the baseline depends on all decisions before it, so no row frame can express it. One
shuffle deals whole series to partitions and sorts each partition by time, so all its series advance together in one
pass. A series keeps its last ``window + lag`` accepted values and nothing else: the state of a task is its number of
series times that, and (series, minute) is unique, so even ten years of one series are some five million rows.

Where many series share an instant, they are scored by one numpy step; a lone series is walked with plain numbers. Both take
the exact sum of a baseline, so that a value at a limit gets the same verdict whichever path it takes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import fsum, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pyrewatch.config import DetectorSettings
from pyrewatch.operators.scoring import POINT_COLUMNS, SEVERITY_RANKS, flag_without_feedback
from pyrewatch.operators.series import SERIES
from pyrewatch.schemas import ANOMALY_POINT

#: Series at one instant from which a numpy step is cheaper than walking them one by one.
TOGETHER = 12

_METHODS = (None, "rolling_zscore", "drift_zscore", "absolute_threshold")
_RANKS = (None, *SEVERITY_RANKS.values())


def _baseline(values: np.ndarray, counts: np.ndarray, least: int):
    """Mean and sample std of the last ``counts`` columns of each row; ``ready`` where there are enough."""
    width = values.shape[1]
    used = np.arange(width) >= (width - counts)[:, None]
    ready = counts >= least
    size = np.maximum(counts, 2)
    mean = _totals(np.where(used, values, 0.0)) / size
    apart = np.where(used, values - mean[:, None], 0.0)
    return mean, np.sqrt(_totals(apart * apart) / (size - 1)), ready


def _totals(rows: np.ndarray) -> np.ndarray:
    """Exact sums of the rows; numpy's own depend on the order and number of the columns in the last bit."""
    return np.fromiter(map(fsum, rows.tolist()), float, len(rows))


class Scorer:
    """Scores observations against the accepted values before them, for many series at a time or for one."""

    def __init__(self, settings: DetectorSettings):
        self.settings = settings
        rules = settings.active_rules
        self.index = {name: i for i, name in enumerate(rules)}
        ceilings = [np.inf if r.ceiling is None else r.ceiling for r in rules.values()]
        self.ceiling = np.array(ceilings, dtype=float)
        for name in ("min_std", "abs_floor", "rel_floor"):
            setattr(self, name, np.array([getattr(r, name) for r in rules.values()], dtype=float))
        self.up = np.array([r.up for r in rules.values()], dtype=bool)
        self.down = np.array([r.down for r in rules.values()], dtype=bool)
        self.limits = [(float(r.min_std), float(r.abs_floor), float(r.rel_floor), c, bool(r.up), bool(r.down))
                       for r, c in zip(rules.values(), ceilings, strict=True)]

    def _compare(self, value, rule, window, counts):
        mean, std, ready = _baseline(window, counts, self.settings.min_points)
        deviation = value - mean
        z = deviation / np.maximum(std, self.min_std[rule])
        floor = np.maximum(self.abs_floor[rule], self.rel_floor[rule] * np.abs(mean))
        allowed = np.where(deviation >= 0, self.up[rule], self.down[rule])
        fired = ready & (np.abs(z) >= self.settings.z_threshold) & (np.abs(deviation) >= floor) & allowed
        return {"mean": mean, "std": std, "ready": ready, "deviation": deviation, "z": z, "fired": fired,
                "points": np.where(ready, counts, 0)}

    def score(self, value, rule, memory: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        s = self.settings
        recent = self._compare(value, rule, memory[:, -s.window:], np.minimum(counts, s.window))
        lagged_fired = np.zeros(len(value), dtype=bool)
        shown = recent
        if s.lag:
            lagged = self._compare(value, rule, memory[:, :s.window], np.clip(counts - s.lag, 0, s.window))
            lagged_fired = lagged["fired"] & ~recent["fired"]
            shown = {k: np.where(lagged_fired, lagged[k], recent[k]) for k in recent}
        above = value >= self.ceiling[rule]
        size = np.abs(shown["z"])
        by_z = recent["fired"] | lagged_fired
        rank = np.where(by_z, np.where(size >= s.high_z, 3, np.where(size >= s.medium_z, 2, 1)), 0)
        rank = np.maximum(rank, np.where(above, s.ceiling_rank, 0))
        method = np.where(recent["fired"], 1, np.where(lagged_fired, 2, np.where(above, 3, 0)))
        return {**shown, "above": above, "rank": rank, "method": method}

    def _fires(self, value: float, limits: tuple, accepted: list[float]) -> bool:
        n = len(accepted)
        if n < self.settings.min_points:
            return False
        mean = fsum(accepted) / n
        deviation = value - mean
        least_std, floor, share, _, up, down = limits
        # Most observations lie within the floor, so the spread is seldom needed.
        if abs(deviation) < max(floor, share * abs(mean)) or not (up if deviation >= 0 else down):
            return False
        return abs(deviation) / max(_spread(accepted, mean), least_std) >= self.settings.z_threshold

    def _shown(self, value: float, limits: tuple, accepted: list[float]) -> tuple:
        """(mean, std, z, deviation, points) against ``accepted``; nothing if there are too few."""
        n = len(accepted)
        if n < self.settings.min_points:
            return None, None, None, None, 0
        mean = fsum(accepted) / n
        std = _spread(accepted, mean)
        return mean, std, (value - mean) / max(std, limits[0]), value - mean, n

    def score_one(self, value: float, rule: int, accepted: list[float]) -> tuple | None:
        """(mean, std, z, deviation, points, rank, method, above) of a flagged observation, nothing for any other."""
        s, limits = self.settings, self.limits[rule]
        window, method = accepted[-s.window:], 0
        if self._fires(value, limits, window):
            method = 1
        elif s.lag and len(accepted) - s.lag >= s.min_points:
            older = accepted[max(0, len(accepted) - s.lag - s.window):len(accepted) - s.lag]
            if self._fires(value, limits, older):
                window, method = older, 2
        above = value >= limits[3]
        if not method and not above:
            return None
        shown, rank = self._shown(value, limits, window), 0
        if method:
            size = abs(shown[2])
            rank = 3 if size >= s.high_z else 2 if size >= s.medium_z else 1
        if above:
            rank = max(rank, s.ceiling_rank)
        return (*shown, rank, method or 3, above)


def _spread(values: list[float], mean: float) -> float:
    return sqrt(fsum([(x - mean) * (x - mean) for x in values]) / (len(values) - 1))


class Walk:
    """Walks batches sorted by time. ``accepted`` holds the last accepted values of every series met so far."""

    def __init__(self, settings: DetectorSettings):
        self.settings = settings
        self.scorer = Scorer(settings)
        self.accepted: dict[tuple, list[float]] = {}

    def batch(self, batch: pd.DataFrame) -> pd.DataFrame:
        keys = list(zip(*(batch[c].tolist() for c in SERIES), strict=True))
        values = batch["value"].tolist()
        times = batch["timestamp"].to_numpy()
        borders = np.flatnonzero(np.concatenate(([True], times[1:] != times[:-1], [True]))).tolist()
        found: list[tuple] = []
        if len(keys) >= TOGETHER * (len(borders) - 1):
            self._together(keys, np.array(values), borders, found)
        else:
            self._one_by_one(keys, values, found)
        return self._frame(batch, found)

    def _one_by_one(self, keys: list[tuple], values: list[float], found: list[tuple]) -> None:
        score, rules, keep, depth = self.scorer.score_one, self.scorer.index, not self.settings.exclude_flagged, self.settings.history
        for at, (key, value) in enumerate(zip(keys, values, strict=True)):
            accepted = self.accepted.get(key)
            if accepted is None:
                accepted = self.accepted[key] = []
            flagged = score(value, rules[key[2]], accepted)
            if flagged:
                found.append((at, *flagged))
            if keep or not flagged:
                accepted.append(value)
                if len(accepted) > depth:
                    del accepted[0]

    def _together(self, keys: list[tuple], values: np.ndarray, borders: list[int], found: list[tuple]) -> None:
        depth = self.settings.history
        slots: dict[tuple, int] = {}
        slot = np.array([slots.setdefault(key, len(slots)) for key in keys])
        rule = np.array([self.scorer.index[key[2]] for key in slots])
        memory, counts = np.zeros((len(slots), depth)), np.zeros(len(slots), dtype=np.int64)
        for key, row in slots.items():
            known = self.accepted.get(key, [])
            counts[row] = len(known)
            if known:
                memory[row, depth - len(known):] = known
        for a, b in zip(borders, borders[1:], strict=False):
            rows, value = slot[a:b], values[a:b]
            score = self.scorer.score(value, rule[rows], memory[rows], counts[rows])
            flagged = score["method"] > 0
            for i in np.flatnonzero(flagged).tolist():
                warm = bool(score["ready"][i])
                shown = [float(score[c][i]) if warm else None for c in ("mean", "std", "z", "deviation")]
                found.append((a + i, *shown, int(score["points"][i]), int(score["rank"][i]), int(score["method"][i]),
                              bool(score["above"][i])))
            if self.settings.exclude_flagged:
                rows, value = rows[~flagged], value[~flagged]
            memory[rows, :-1] = memory[rows, 1:]
            memory[rows, -1] = value
            counts[rows] = np.minimum(counts[rows] + 1, depth)
        for key, row in slots.items():
            self.accepted[key] = memory[row, depth - counts[row]:].tolist()

    def _frame(self, batch: pd.DataFrame, found: list[tuple]) -> pd.DataFrame:
        at, mean, std, z, deviation, points, rank, method, above = (
            list(column) for column in zip(*found, strict=True)) if found else ([] for _ in range(9))
        out = batch.iloc[at][[*SERIES, "timestamp", "value"]].reset_index(drop=True)
        columns = {
            "baseline_mean": mean, "baseline_std": std, "z_score": z, "deviation": deviation, "baseline_points": points,
            "direction": [None if d is None else "up" if d >= 0 else "down" for d in deviation],
            "severity": [_RANKS[r] for r in rank], "detection_method": [_METHODS[m] for m in method],
            "absolute_threshold_exceeded": above}
        for name, column in columns.items():
            out[name] = pd.Series(column, dtype=object)
        return out[[f.name for f in ANOMALY_POINT.fields]]


def _walk_partition(settings: DetectorSettings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk = Walk(settings)
        for batch in batches:
            if len(batch):
                yield walk.batch(batch)
    return run


def flag_with_feedback(series: DataFrame, settings: DetectorSettings | None = None) -> DataFrame:
    """Anomaly points of the default detector; ``series`` has one row per observation. One shuffle, no job of its own."""
    settings = settings or DetectorSettings()
    active = series.where(F.col("metric_name").isin(*settings.active_rules)).select(*SERIES, "timestamp", "value")
    dealt = active.repartition(*SERIES).sortWithinPartitions("timestamp", *SERIES)
    return dealt.mapInPandas(_walk_partition(settings), ANOMALY_POINT).select(*POINT_COLUMNS)


def detect(series: DataFrame, settings: DetectorSettings | None = None, rows_per_block: int | None = None) -> DataFrame:
    """Anomaly points under ``settings``: the walk when flags feed back, plain frames otherwise.

    With ``rows_per_block`` a series is walked in blocks on many tasks, which pays from some hundred thousand rows of one series.
    """
    settings = settings or DetectorSettings()
    if settings.exclude_flagged and rows_per_block:
        from pyrewatch.operators.blockwalk import flag_in_blocks

        return flag_in_blocks(series, settings, rows_per_block)
    return (flag_with_feedback if settings.exclude_flagged else flag_without_feedback)(series, settings)
