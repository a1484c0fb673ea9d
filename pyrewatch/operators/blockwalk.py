"""The detector with feedback on long series: all blocks of a series are walked at once, from a guessed memory.

What a block needs from the past is the memory at its first row, the last ``window + lag`` accepted values. The first pass
guesses it by walking the rows just ahead of the block. A block then is a known step from one memory to the next, and the
steps of a series are followed from its empty beginning; where the memory that arrives is not the one a block was walked
from, that block is walked again from it. Memories forget: a wrong guess is mostly gone within a block, so few blocks repeat.

Where a memory stays for long (after a step every value is flagged, and nothing is accepted) the guess is wrong for all
blocks behind it. So the memories that arrive are also tried on the blocks ahead, on twice as many each round. If some series
is still open after ``MOST_ROUNDS`` rounds, its remaining blocks are walked one after another.

A step is kept under (block, memory before it), so nothing is walked twice from one memory. A block is one row of at most
``rows_per_block`` values, and what is followed in one task is a pair of hashes per block of a series.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pyrewatch.config import DetectorSettings
from pyrewatch.functions.times import day_of
from pyrewatch.operators.detector import Scorer
from pyrewatch.operators.ordered import with_row_number
from pyrewatch.operators.scoring import POINT_COLUMNS, severity_name
from pyrewatch.operators.series import SERIES
from pyrewatch.session import cut_lineage

ROWS_PER_BLOCK = 65_536
MOST_ROUNDS = 8
#: Rows ahead of a block that its memory is guessed from, in memories.
GUESS_DEPTH = 6

_POINT = pa.struct([("at", pa.int32()), ("mean", pa.float64()), ("std", pa.float64()), ("z", pa.float64()), ("deviation", pa.float64()),
                    ("points", pa.int64()), ("rank", pa.int32()), ("method", pa.int32()), ("above", pa.bool_())])
_STEP = pa.schema([*[(c, pa.string()) for c in SERIES], ("block", pa.int64()), ("before_id", pa.string()), ("after_id", pa.string()),
                   ("after", pa.list_(pa.float64())), ("points", pa.list_(_POINT))])
_STEP_DDL = (f"{', '.join(f'{c} string' for c in SERIES)}, block bigint, before_id string, after_id string, after array<double>, "
             "points array<struct<at: int, mean: double, std: double, z: double, deviation: double, points: bigint, rank: int, "
             "method: int, above: boolean>>")


@dataclass
class BlockWalk:
    """Points of a walk, and how many blocks each round walked; all but the first round are repetitions."""

    points: DataFrame
    walked: list[int]

    @property
    def repeated(self) -> int:
        return sum(self.walked[1:])


def _name(memory: list[float]) -> str:
    return blake2b(np.array(memory, dtype=float).tobytes(), digest_size=16).hexdigest()


_EMPTY = _name([])


def _advance(scorer: Scorer, metric: str, values: list[float], memory: list[float]) -> list[dict]:
    """Walk ``values``; ``memory`` becomes what it is behind them."""
    found, rule, keep, depth = [], scorer.index[metric], not scorer.settings.exclude_flagged, scorer.settings.history
    for at, value in enumerate(values):
        flagged = scorer.score_one(value, rule, memory)
        if flagged:
            found.append(dict(zip(_POINT.names, (at, *flagged), strict=True)))
        if keep or not flagged:
            memory.append(value)
            if len(memory) > depth:
                del memory[0]
    return found


def _step(row: dict, before: str, memory: list[float], found: list[dict]) -> dict:
    return {**{c: row[c] for c in (*SERIES, "block")}, "before_id": before, "after_id": _name(memory), "after": memory, "points": found}


def _walk(settings: DetectorSettings):
    """One step per block row: from ``before``, or from what its ``tail`` leaves behind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(settings)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                memory = list(row.get("before") or ())
                if row.get("tail"):
                    _advance(scorer, row["metric_name"], row["tail"], memory)
                before = _name(memory)
                found = _advance(scorer, row["metric_name"], row["values"], memory)
                yield pa.RecordBatch.from_pylist([_step(row, before, memory, found)], schema=_STEP)
    return run


def _walk_on(settings: DetectorSettings):
    """Steps of consecutive blocks in order; the memory goes on from block to block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, current, memory = Scorer(settings), None, []
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                key = tuple(row[c] for c in SERIES)
                if key != current:
                    current, memory = key, list(row["before"] or ())
                before = _name(memory)
                found = _advance(scorer, row["metric_name"], row["values"], memory)
                yield pa.RecordBatch.from_pylist([_step(row, before, memory, found)], schema=_STEP)
    return run


def _follow(steps: pd.DataFrame) -> pd.DataFrame:
    """The steps of one series from its beginning, and the block and memory where they end too early."""
    known = {(block, before): after for block, before, after in zip(steps["block"], steps["before_id"], steps["after_id"], strict=True)}
    last, block, memory, way = steps["block"].max(), 0, _EMPTY, []
    while (block, memory) in known:
        way.append((block, memory, False))
        block, memory = block + 1, known[block, memory]
    if block <= last:
        way.append((block, memory, True))
    out = pd.DataFrame(way, columns=["block", "before_id", "open"])
    for at, c in enumerate(SERIES):
        out.insert(at, c, steps[c].iloc[0])
    return out


def series_blocks(series: DataFrame, settings: DetectorSettings, rows_per_block: int) -> DataFrame:
    """One row per block of a series: its times and values in order, and the values right ahead of it."""
    active = series.where(F.col("metric_name").isin(*settings.active_rules)).select(*SERIES, "timestamp", "value")
    numbered = with_row_number(active, SERIES, day_of(F.col("timestamp")), ["timestamp"], "_position")
    block = F.floor((F.col("_position") - 1) / rows_per_block)
    rows = numbered.groupBy(*SERIES, block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("timestamp", "value"))).alias("rows"))
    depth = GUESS_DEPTH * settings.history
    tail = F.slice("values", F.greatest(F.lit(1), F.size("values") - depth + 1), depth)
    return rows.select(*SERIES, "block", F.col("rows.timestamp").alias("times"), F.col("rows.value").alias("values")).withColumn(
        "tail", F.lag(tail).over(Window.partitionBy(*SERIES).orderBy("block")))


def _point(name: str) -> Column:
    return F.col("p")[name]


def walk_blocks(series: DataFrame, settings: DetectorSettings | None = None, rows_per_block: int = ROWS_PER_BLOCK) -> BlockWalk:
    """Anomaly points of the detector with feedback, with the blocks of a series on many tasks."""
    settings = settings or DetectorSettings()
    keys = [*SERIES, "block"]
    blocks = cut_lineage(series_blocks(series, settings, rows_per_block))
    rounds = [cut_lineage(blocks.select(*keys, "values", "tail").mapInArrow(_walk(settings), _STEP_DDL))]
    walked = [rounds[0].count()]
    ways = f"{', '.join(f'{c} string' for c in SERIES)}, block bigint, before_id string, open boolean"
    while True:
        steps = reduce(DataFrame.unionByName, rounds)
        way = cut_lineage(steps.select(*keys, "before_id", "after_id").groupBy(*SERIES).applyInPandas(_follow, ways))
        ends = way.where("open").select(*SERIES, F.col("block").alias("first"), F.col("before_id").alias("first_id"))
        if ends.isEmpty():
            break
        # Memories that arrive at a block of an open series, at or behind the place where its steps end.
        arriving = steps.select(*SERIES, (F.col("block") + 1).alias("block"), F.col("after_id").alias("before_id"), F.col("after").alias("before"))
        arriving = arriving.join(ends, SERIES).where(F.col("block") >= F.col("first"))
        values = blocks.select(*keys, "values")
        if len(rounds) <= MOST_ROUNDS:
            ahead = F.explode(F.sequence(F.col("block"), F.col("block") + (1 << (len(rounds) - 1)) - 1))
            tried = arriving.select(*SERIES, ahead.alias("block"), "before_id", "before").dropDuplicates([*keys, "before_id"])
            tried = tried.join(steps.select(*keys, "before_id"), [*keys, "before_id"], "left_anti")
            rounds.append(cut_lineage(values.join(tried, keys).select(*keys, "values", "before").mapInArrow(_walk(settings), _STEP_DDL)))
        else:
            start = arriving.where((F.col("block") == F.col("first")) & (F.col("before_id") == F.col("first_id")))
            rest = values.join(start.dropDuplicates(SERIES).select(*SERIES, "first", "before"), SERIES).where(F.col("block") >= F.col("first"))
            dealt = rest.select(*keys, "values", "before").repartition(*SERIES).sortWithinPartitions(*keys)
            new = dealt.mapInArrow(_walk_on(settings), _STEP_DDL).join(steps.select(*keys, "before_id"), [*keys, "before_id"], "left_anti")
            rounds.append(cut_lineage(new.select(*rounds[0].columns)))
        walked.append(rounds[-1].count())
    found = steps.where(F.size("points") > 0).join(way, [*keys, "before_id"]).select(*keys, "points")
    found = found.join(blocks.select(*keys, "times", "values"), keys).select(*SERIES, "times", "values", F.explode("points").alias("p"))
    methods = F.array(*map(F.lit, ("rolling_zscore", "drift_zscore", "absolute_threshold")))
    points = found.select(
        *SERIES, F.get("times", _point("at")).alias("timestamp"), F.get("values", _point("at")).alias("value"),
        _point("mean").alias("baseline_mean"), _point("std").alias("baseline_std"), _point("points").alias("baseline_points"),
        _point("z").alias("z_score"), _point("deviation").alias("deviation"),
        F.when(_point("deviation") >= 0, "up").when(_point("deviation") < 0, "down").alias("direction"),
        severity_name(_point("rank")).alias("severity"), F.get(methods, _point("method") - 1).alias("detection_method"),
        _point("above").alias("absolute_threshold_exceeded"))
    return BlockWalk(points.select(*POINT_COLUMNS), walked)


def flag_in_blocks(series: DataFrame, settings: DetectorSettings | None = None, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The points of ``walk_blocks``."""
    return walk_blocks(series, settings, rows_per_block).points
