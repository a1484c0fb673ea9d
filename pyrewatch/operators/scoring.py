"""Scores of observations against causal baselines, as native columns.

This is the form without feedback: every earlier observation belongs to the baseline, flagged or not, so the
baselines are plain row frames. ``operators.detector`` holds the form that leaves flagged rows out.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window, functions as F

from pyrewatch.config import DetectorSettings
from pyrewatch.functions.times import day_of
from pyrewatch.operators.ordered import with_halo, with_row_number
from pyrewatch.operators.series import SERIES

SEVERITY_RANKS = {1: "LOW", 2: "MEDIUM", 3: "HIGH"}
POINT_COLUMNS = [
    "incident_id", "timestamp", "service", "metric_name", "value", "baseline_mean", "baseline_std",
    "baseline_points", "z_score", "deviation", "direction", "severity", "detection_method",
    "absolute_threshold_exceeded",
]


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "HIGH", 3).when(severity == "MEDIUM", 2).when(severity == "LOW", 1)


def severity_name(rank: Column) -> Column:
    return F.when(rank == 3, "HIGH").when(rank == 2, "MEDIUM").when(rank == 1, "LOW")


def with_baselines(series: DataFrame, settings: DetectorSettings, rows_per_block: int = 65_536) -> DataFrame:
    """Add mean, sample std and count of the recent frame and, with a lag, of the lagged frame.

    Both are null below ``min_points`` earlier observations. Series are cut into blocks that carry the rows a
    frame needs, so one very long series does not sit in one task.
    """
    numbered = with_row_number(series, SERIES, day_of(F.col("timestamp")), ["timestamp"], "_position")
    blocks = with_halo(numbered, SERIES, "_position", settings.history, rows_per_block)
    by_block = Window.partitionBy(*SERIES, "_block").orderBy("_position")
    out = blocks
    for name, shift in (("recent", 0), ("lagged", settings.lag)):
        if name == "lagged" and not settings.lag:
            empty = {"mean": "double", "std": "double", "points": "long"}
            out = out.withColumns({f"{name}_{k}": F.lit(None).cast(t) for k, t in empty.items()})
            continue
        frame = by_block.rowsBetween(-shift - settings.window, -shift - 1)
        count = F.count("value").over(frame)
        warm = count >= settings.min_points
        out = out.withColumns({
            f"{name}_mean": F.when(warm, F.avg("value").over(frame)),
            f"{name}_std": F.when(warm, F.stddev_samp("value").over(frame)),
            f"{name}_points": F.when(warm, count),
        })
    return out.where(~F.col("_halo")).drop("_halo", "_block", "_position")


def _rule_struct(settings: DetectorSettings) -> Column:
    """The limits of this row's metric, from a literal map: a handful of entries, so no join."""
    def limits(rule):
        ceiling = F.lit(None).cast("double") if rule.ceiling is None else F.lit(float(rule.ceiling))
        return F.struct(
            F.lit(float(rule.min_std)).alias("min_std"), F.lit(float(rule.abs_floor)).alias("abs_floor"),
            F.lit(float(rule.rel_floor)).alias("rel_floor"), ceiling.alias("ceiling"),
            F.lit(rule.up).alias("up"), F.lit(rule.down).alias("down"),
        )
    pairs = chain.from_iterable((F.lit(name), limits(rule)) for name, rule in settings.active_rules.items())
    return F.create_map(*pairs)[F.col("metric_name")]


def with_scores(df: DataFrame, settings: DetectorSettings) -> DataFrame:
    """Add z, deviation and a fired flag per baseline, then the method, severity and reported comparison."""
    value, rule = F.col("value"), F.col("_rule")
    out = df.withColumn("_rule", _rule_struct(settings)).where(F.col("_rule").isNotNull())
    for name in ("recent", "lagged"):
        mean, std = F.col(f"{name}_mean"), F.col(f"{name}_std")
        deviation = value - mean
        z = deviation / F.greatest(std, rule["min_std"])
        allowed = F.when(deviation >= 0, rule["up"]).otherwise(rule["down"])
        floor = F.greatest(rule["abs_floor"], rule["rel_floor"] * F.abs(mean))
        fired = (F.abs(z) >= settings.z_threshold) & (F.abs(deviation) >= floor) & allowed
        out = out.withColumn(f"_{name}", F.when(mean.isNotNull(), F.struct(
            mean.alias("mean"), std.alias("std"), F.col(f"{name}_points").alias("points"), z.alias("z"),
            deviation.alias("deviation"), fired.alias("fired"),
        )))
    recent_fired = F.coalesce(F.col("_recent.fired"), F.lit(False))
    lagged_fired = F.coalesce(F.col("_lagged.fired"), F.lit(False))
    above = F.coalesce(value >= rule["ceiling"], F.lit(False))
    shown = F.when(~recent_fired & lagged_fired, F.col("_lagged")).otherwise(F.col("_recent"))
    size = F.abs(F.col("_shown.z"))
    by_z = F.when(recent_fired | lagged_fired,
                  F.when(size >= settings.high_z, 3).when(size >= settings.medium_z, 2).otherwise(1))
    by_ceiling = F.when(above, settings.ceiling_rank)
    return out.withColumn("_shown", shown).select(
        "incident_id", "timestamp", "service", "metric_name", "value",
        F.col("_shown.mean").alias("baseline_mean"), F.col("_shown.std").alias("baseline_std"),
        F.coalesce(F.col("_shown.points"), F.lit(0)).alias("baseline_points"),
        F.col("_shown.z").alias("z_score"), F.col("_shown.deviation").alias("deviation"),
        F.when(F.col("_shown.deviation") >= 0, "up").when(F.col("_shown.deviation") < 0, "down").alias("direction"),
        severity_name(F.greatest(by_z, by_ceiling)).alias("severity"),
        F.when(recent_fired, "rolling_zscore").when(lagged_fired, "drift_zscore")
        .when(above, "absolute_threshold").alias("detection_method"),
        above.alias("absolute_threshold_exceeded"),
    )


def score_all(series: DataFrame, settings: DetectorSettings | None = None, rows_per_block: int = 65_536) -> DataFrame:
    """Every observation with its score; ``detection_method`` is null where nothing fired."""
    settings = settings or DetectorSettings(exclude_flagged=False)
    return with_scores(with_baselines(series, settings, rows_per_block), settings)


def flag_without_feedback(series: DataFrame, settings: DetectorSettings | None = None,
                          rows_per_block: int = 65_536) -> DataFrame:
    """Flagged observations when earlier flags stay in the baselines."""
    return score_all(series, settings, rows_per_block).where(F.col("detection_method").isNotNull())
