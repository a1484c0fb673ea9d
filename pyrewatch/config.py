"""Job settings as frozen dataclasses. Each one checks its own limits."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields
from types import MappingProxyType

from pyrewatch.schemas import METRICS


def _positive(**values: float) -> None:
    for name, value in values.items():
        if not (math.isfinite(value) and value > 0):
            raise ValueError(f"{name} must be a positive number, got {value!r}")


def _not_negative(**values: float) -> None:
    for name, value in values.items():
        if not (math.isfinite(value) and value >= 0):
            raise ValueError(f"{name} must not be negative, got {value!r}")


@dataclass(frozen=True)
class MetricRule:
    """Scoring limits of one metric. ``ceiling`` is an absolute alarm level, or None."""

    min_std: float
    abs_floor: float = 0.0
    rel_floor: float = 0.0
    ceiling: float | None = None
    up: bool = True
    down: bool = True
    enabled: bool = True

    def __post_init__(self):
        _positive(min_std=self.min_std)
        _not_negative(abs_floor=self.abs_floor, rel_floor=self.rel_floor)


# Default scoring limits per metric.
DEFAULT_RULES = MappingProxyType({
    "cpu_usage": MetricRule(min_std=0.5, abs_floor=10.0, ceiling=90.0),
    "memory_usage": MetricRule(min_std=0.25, abs_floor=5.0, ceiling=90.0),
    "request_rate": MetricRule(min_std=1.0, rel_floor=0.3),
    "latency_ms": MetricRule(min_std=2.0, abs_floor=20.0, rel_floor=0.5),
    "error_rate": MetricRule(min_std=0.05, abs_floor=1.0),
    "db_connection_utilization": MetricRule(min_std=0.5, abs_floor=10.0, ceiling=90.0),
    "downstream_latency_ms": MetricRule(min_std=2.0, abs_floor=20.0, rel_floor=0.5),
})


@dataclass(frozen=True)
class DetectorSettings:
    """Detector knobs; the defaults are the fixed values results are compared on."""

    window: int = 15
    min_points: int = 10
    z_threshold: float = 3.0
    lag: int = 30
    exclude_flagged: bool = True
    medium_z: float = 10.0
    high_z: float = 50.0
    ceiling_rank: int = 2
    max_gap_minutes: float = 2.0
    rules: dict[str, MetricRule] = field(default_factory=lambda: dict(DEFAULT_RULES))

    def __post_init__(self):
        if not 2 <= self.min_points <= self.window:
            raise ValueError("min_points must lie between 2 and window")
        if self.lag < 0:
            raise ValueError("lag must not be negative")
        _positive(z_threshold=self.z_threshold, medium_z=self.medium_z, high_z=self.high_z)
        _not_negative(max_gap_minutes=self.max_gap_minutes)
        if self.medium_z >= self.high_z:
            raise ValueError("medium_z must be below high_z")
        if self.ceiling_rank not in (1, 2, 3):
            raise ValueError("ceiling_rank must be 1, 2 or 3")
        unknown = sorted(set(self.rules) - set(METRICS))
        if unknown:
            raise ValueError(f"rules for unknown metrics: {unknown}")

    @property
    def active_rules(self) -> dict[str, MetricRule]:
        return {name: rule for name, rule in self.rules.items() if rule.enabled}

    @property
    def history(self) -> int:
        """How many accepted observations one series has to remember."""
        return self.window + self.lag

    def as_dict(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "rules"}


@dataclass(frozen=True)
class CorrelationSettings:
    """Time padding, in minutes, for picking and linking evidence."""

    lookback: float = 30.0
    after_pad: float = 10.0
    change_lookback: float = 90.0
    link: float = 5.0

    def __post_init__(self):
        _not_negative(lookback=self.lookback, after_pad=self.after_pad,
                      change_lookback=self.change_lookback, link=self.link)
        if self.change_lookback < self.lookback:
            raise ValueError("change_lookback must not be shorter than lookback")
