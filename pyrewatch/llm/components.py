"""Connected components of a link table, by alternating large-star and small-star steps over stored stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyrewatch.llm.stages import Stages


def connected(links: DataFrame, stages: Stages) -> DataFrame:
    """``node`` and ``label`` (smallest node of its component) for every node of the long columns ``a`` and ``b``.

    Each round every node points its neighbours at the smallest one known (minimum first, with a partial aggregate, so
    a node with very many neighbours is not gathered anywhere). Rounds end when nothing changes; their number grows
    with the logarithm of the longest chain. Only a count and a sum reach the driver.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stages.keep(edges)
    before = None
    while True:
        large = _star(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), grow=True)
        small = stages.keep(_star(large, grow=False))
        state = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        stages.drop(edges)
        edges = small
        if state == before:
            break
        before = state
    labels = edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return labels.union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _star(edges: DataFrame, grow: bool) -> DataFrame:
    """Point neighbours of each node ``u`` at the smallest node around it; ``grow`` takes the larger neighbours only."""
    around = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = edges.join(around, "u")
    if grow:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(around.filter("u <> m").select("u", F.col("m").alias("v"))).distinct()
