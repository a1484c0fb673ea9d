"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws ``-ln(u) / weight`` from a hash of the row's key
and the child's name, and the smallest draw wins, so a child receives rows in proportion to its weight. A draw depends
on nothing but key, name and weight: changing one weight moves rows only into or out of that subtree, and a shard that
opens a region of its own takes rows only into itself.

Everything is Column expressions; no row leaves the JVM.

Defined results: a null key hashes as a missing value of its own and all such rows share a shard; rows with equal keys
share a shard; an empty table gives no rows; other columns pass through unless their names clash with the ones added,
which then replace them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash cells per shard for numbering. A cell holds 1/4096 of a shard, so no task ever sorts a whole shard.
CELL_DIGITS = 3


@dataclass(frozen=True)
class Leaf:
    """A shard, where it stands, and its share of the rows."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(shards: int, per_rack: int = 2, racks: int = 2) -> list[Leaf]:
    """Equal shards dealt to racks and regions in order; a shard after a full region opens the next region."""
    per_region = per_rack * racks
    return [Leaf(f"region{s // per_region}", f"rack{s % per_region // per_rack}", s) for s in range(shards)]


def _unit(key: Column, name: str) -> Column:
    """A number in (0, 1) from the first 52 bits of a hash of key and name."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{name}|"), key)), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def _winner(key: Column, children: dict[str, float], path: str) -> Column:
    """Name of the child with the smallest draw; ties go to the smaller name."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    draws = [F.struct((-F.ln(_unit(key, f"{path}/{name}")) / F.lit(float(weight))).alias("draw"),
                      F.lit(name).alias("name")) for name, weight in sorted(children.items())]
    return F.array_min(F.array(*draws))["name"]


def _pick(chosen: Column, branches: dict[str, Column]) -> Column:
    out = None
    for name, branch in branches.items():
        out = F.when(chosen == name, branch) if out is None else out.when(chosen == name, branch)
    return out


def place(df: DataFrame, key: Column, leaves: list[Leaf], into: str = "shard") -> DataFrame:
    """Add the shard of every row. Children with no weight receive nothing."""
    leaves = [leaf for leaf in leaves if leaf.weight > 0]
    if not leaves:
        raise ValueError("a tree needs a shard with weight")
    if len({leaf.shard for leaf in leaves}) < len(leaves):
        raise ValueError("a shard stands in two places")
    text = F.coalesce(key.cast("string"), F.lit("null key"))
    regions: dict[str, dict[str, dict[str, float]]] = {}
    for leaf in leaves:
        regions.setdefault(leaf.region, {}).setdefault(leaf.rack, {})[str(leaf.shard)] = leaf.weight
    region, rack = f"__{into}_region", f"__{into}_rack"
    df = df.withColumn(region, _winner(text, {r: sum(sum(s.values()) for s in k.values()) for r, k in regions.items()}, ""))
    df = df.withColumn(rack, _pick(F.col(region), {
        r: _winner(text, {k: sum(s.values()) for k, s in racks.items()}, r) for r, racks in regions.items()}))
    df = df.withColumn(into, _pick(F.concat_ws("/", region, rack), {
        f"{r}/{k}": _winner(text, shards, f"{r}/{k}") for r, racks in regions.items() for k, shards in racks.items()}
    ).cast("int"))
    return df.drop(region, rack)


def number(df: DataFrame, shard: str, key: Column, order: list[Column], into: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without a gap, in order of (hash cell of the key, ``order``).

    Rows are numbered inside cells; one row per cell and shard, a fixed number, is summed up and broadcast. The key
    should tell as many rows apart as it can, so that an id that very many rows share spreads over the cells.
    """
    cell = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null key"))), 1, CELL_DIGITS)
    df = df.withColumn("__cell", cell)
    sizes = df.groupBy(shard, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(shard).alias("__shard"), F.col("__cell").alias("__c"),
                           F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(shard, "__cell").orderBy(*order)) - 1
    return (df.withColumn("__inside", inside)
              .join(F.broadcast(offsets), (F.col(shard) == F.col("__shard")) & (F.col("__cell") == F.col("__c")))
              .withColumn(into, (F.col("__before") + F.col("__inside")).cast("long"))
              .drop("__cell", "__inside", "__shard", "__c", "__before"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Place documents by ``doc_id`` into ``shards`` shards, and say where each would stand with one more.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard. The shard that is added opens a new region while
    the last one is full, as with 8 shards; otherwise rows may also move inside the region that grows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    rows = place(rows, F.col("doc_id"), tree(shards))
    rows = place(rows, F.col("doc_id"), tree(shards + 1), "grown_shard")
    rows = number(rows, "shard", F.concat_ws("|", "doc_id", "size", "text_crc32"), [F.col("doc_id"), F.col("size"), F.col("text_crc32")])
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
