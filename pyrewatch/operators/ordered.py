"""Ordered scans that never need a whole key in one task.

``lag``, running counts and row numbers are taken inside (keys, bucket) first. ``bucket`` is a coarse step of
the order, such as the day, so one hot key spreads over many tasks. A second pass over the far smaller table
with one row per (keys, bucket) carries the last row, or the total, into the next bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET = "_bucket"


def _local(keys: Sequence[str], order: Sequence[Column]) -> Window:
    return Window.partitionBy(*keys, BUCKET).orderBy(*order)


def with_previous(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str],
                  values: dict[str, str]) -> DataFrame:
    """Add ``values`` (new name -> source column) of the row before, in ``order`` within ``keys``."""
    rows = df.withColumn(BUCKET, bucket).withColumn("_row", F.struct(*[F.col(s).alias(n) for n, s in values.items()]))
    edges = rows.groupBy(*keys, BUCKET).agg(F.max_by("_row", F.struct(*order)).alias("_last"))
    carried = edges.select(
        *keys, BUCKET, F.lag("_last").over(Window.partitionBy(*keys).orderBy(BUCKET)).alias("_carried")
    )
    local = rows.withColumn("_before", F.lag("_row").over(_local(keys, [F.col(c) for c in order])))
    joined = local.join(carried, [*keys, BUCKET])
    before = F.coalesce("_before", "_carried")
    return joined.select(*df.columns, *[before[n].alias(n) for n in values])


def with_running_total(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str],
                       amount: Column, name: str) -> DataFrame:
    """Add the sum of ``amount`` over all rows up to and including this one, in ``order`` within ``keys``."""
    rows = df.withColumn(BUCKET, bucket).withColumn("_amount", amount.cast("long"))
    totals = rows.groupBy(*keys, BUCKET).agg(F.sum("_amount").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, BUCKET, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    frame = _local(keys, [F.col(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_running", F.sum("_amount").over(frame))
    joined = local.join(offsets, [*keys, BUCKET])
    return joined.select(*df.columns, (F.col("_offset") + F.col("_running")).alias(name))


def with_row_number(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str],
                    name: str = "row_number") -> DataFrame:
    """Add 1, 2, 3, ... in ``order`` within ``keys``; ``order`` has to be total."""
    return with_running_total(df, keys, bucket, order, F.lit(1), name)


def with_session_number(df: DataFrame, keys: Sequence[str], bucket: Column, start: str, end: str, gap: Column,
                        name: str) -> DataFrame:
    """Number the gap sessions of each key: a row opens one when ``start`` lies more than ``gap`` after ``end`` of
    the row before. Rows are ordered by ``start`` and must not nest, so ``end`` grows with ``start``.

    Sessions are counted inside a bucket; a bucket's first session is merged with the one still open before it.
    """
    rows = df.withColumn(BUCKET, bucket)
    local = _local(keys, [F.col(start)])
    before = F.lag(end).over(local)
    opens = F.when(F.col(start) <= before + gap, 0).otherwise(1)
    numbered = rows.withColumn("_opens", opens).withColumn(
        "_local", F.sum("_opens").over(local.rowsBetween(Window.unboundedPreceding, 0)))
    edges = numbered.groupBy(*keys, BUCKET).agg(
        F.min(start).alias("_from"), F.max(end).alias("_to"), F.sum("_opens").alias("_sessions"))
    by_key = Window.partitionBy(*keys).orderBy(BUCKET)
    joins = F.when(F.col("_from") <= F.lag("_to").over(by_key) + gap, 1).otherwise(0)
    edges = edges.withColumn("_joins", joins)
    earlier = by_key.rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("_sessions") - F.col("_joins")).over(earlier), F.lit(0)) - F.col("_joins")
    offsets = edges.select(*keys, BUCKET, offset.alias("_offset"))
    return numbered.join(offsets, [*keys, BUCKET]).select(*df.columns, (F.col("_offset") + F.col("_local")).alias(name))


def with_halo(df: DataFrame, keys: Sequence[str], position: str, halo: int, rows_per_block: int = 65_536) -> DataFrame:
    """Cut each key into blocks of consecutive positions, each one led by the ``halo`` rows before it.

    Adds ``_block`` and ``_halo`` (true on the borrowed rows), so a frame of up to ``halo`` preceding rows is
    exact inside (keys, _block).
    """
    if not 0 <= halo < rows_per_block:
        raise ValueError("a block has to be longer than its halo")
    offset = F.col(position) - 1
    block = F.floor(offset / rows_per_block)
    lends = (offset % rows_per_block) >= rows_per_block - halo
    homes = F.when(lends, F.array(block, block + 1)).otherwise(F.array(block))
    spread = df.withColumn("_home", block).withColumn("_block", F.explode(homes))
    return spread.withColumn("_halo", F.col("_block") != F.col("_home")).drop("_home")
