"""Exact cosine search with block bounds: a query visits only the blocks of items that may hold one of its best.

Items with the same leading slots are laid side by side and cut into blocks. A block has, per slot, the largest and the
smallest weight, as the inverted lists of a text index have per block of postings, and a centre with a radius. Either
bounds the score of a query with any item of the block. A query scores its most promising block first; the k-th best
score there is a floor, and blocks whose bound lies below it are never read for that query.

Nothing passes through the driver. Queries travel in chunks to groups of block bounds, and from there, in rows of the
queries that one block has to answer, to that block. A block goes to its task once, ahead of the rows it answers, so what a
Python worker receives grows with the items and the visits, not with their product; and it takes few of these wide rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pyrewatch.session import arrow_rows, cut_lineage

# Scores closer than this are equal, and the smaller id comes first, whatever block a vector was scored in.
SCORE_DIGITS = 9
#: Bounds are compared with this much room for rounding.
ROOM = 1e-8
#: Floor of a query that has no k scores yet; below every score.
NO_FLOOR = -2.0
#: Items of a block, bounds of a group, queries of a chunk.
ITEMS, BOUNDS, QUERIES = 512, 1024, 512
#: Rows of blocks, bounds or chunks that a Python worker takes at a time; each has up to 1.8 MB.
WIDE_ROWS = 16
#: Bytes that a query of a chunk is taken for.
QUERY_BYTES = 512
#: Slots that name the neighbourhood of an item.
LEADING = 3


@dataclass
class Search:
    """(query_id, id, score, rank), and per row of work how many queries met how many items."""

    hits: DataFrame
    work: DataFrame

    def scored(self) -> int:
        """Pairs of query and item that were scored."""
        return self.work.agg(F.sum(F.col("queries") * F.col("items"))).first()[0] or 0


def _unit(vectors: pa.Array) -> np.ndarray:
    flat = np.asarray(vectors.flatten(), dtype=float)
    matrix = flat.reshape(len(vectors), -1)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _matrix(data, rows: int) -> np.ndarray:
    return np.frombuffer(data, float).reshape(rows, -1)


def _cut(rows: int, make):
    """Consecutive rows of (id, vector, ...) in groups of ``rows``, each one made into a record by ``make``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows - size)
                held.append(part)
                size, at = size + part.num_rows, at + part.num_rows
                if size == rows:
                    yield make(number, pa.Table.from_batches(held).combine_chunks())
                    number, held, size = number + 1, [], 0
        if held:
            yield make(number, pa.Table.from_batches(held).combine_chunks())
    return run


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _block(number: int, table: pa.Table) -> pa.RecordBatch:
    """Items in order of id, and what bounds their scores: extremes per slot, centre and radius."""
    table = table.sort_by("id")
    items = _unit(_column(table, "vector"))
    centre = items.mean(axis=0)
    radius = float(np.linalg.norm(items - centre, axis=1).max())
    bounds = np.concatenate([items.max(axis=0), items.min(axis=0), centre, [radius]])
    names = pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), _column(table, "id"))
    return pa.record_batch([pa.array([number]), names, pa.array([items.tobytes()]), pa.array([bounds.tobytes()])],
                           names=["block", "ids", "items", "bounds"])


def _chunk(number: int, table: pa.Table) -> pa.RecordBatch:
    names = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), _column(table, "query_id"))
    vectors = _unit(_column(table, "vector")).tobytes()
    floors = np.asarray(_column(table, "floor"), dtype=float).tobytes()
    done = np.asarray(_column(table, "done"), dtype=np.int64).tobytes()
    return pa.record_batch([pa.array([number]), names, pa.array([vectors]), pa.array([floors]), pa.array([done])],
                           names=["chunk", "query_ids", "vectors", "floors", "done"])


def _group(number: int, table: pa.Table) -> pa.RecordBatch:
    bounds = b"".join(_column(table, "bounds").to_pylist())
    blocks = np.asarray(_column(table, "block"), dtype=np.int64).tobytes()
    return pa.record_batch([pa.array([number]), pa.array([blocks]), pa.array([bounds])], names=["number", "blocks", "bounds"])


def _bounds(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of every query with the items of every block."""
    width = queries.shape[1]
    most, least, centre, radius = rows[:, :width], rows[:, width:2 * width], rows[:, 2 * width:3 * width], rows[:, -1]
    by_slot = np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T
    return np.minimum(by_slot, queries @ centre.T + radius)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Queries against bounds: (query ids, vectors, floors, block done, blocks, bounds of query and block)."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = {name: batch.column(name)[at] for name in batch.schema.names}
            ids, blocks = row["query_ids"].values, np.frombuffer(row["blocks"].as_buffer(), np.int64)
            queries = _matrix(row["vectors"].as_buffer(), len(ids))
            limit = _bounds(queries, _matrix(row["bounds"].as_buffer(), len(blocks)))
            yield (ids, queries, np.frombuffer(row["floors"].as_buffer(), float), np.frombuffer(row["done"].as_buffer(), np.int64),
                   blocks, limit)


def _most_promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, _, _, _, blocks, limit in _parts(batches):
        best = limit.argmax(axis=1)
        yield pa.record_batch([ids, pa.array(blocks[best]), pa.array(limit[np.arange(len(ids)), best])], names=["query_id", "block", "bound"])


def _visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block the queries of a chunk whose floor its bound reaches."""
    for ids, queries, floors, done, blocks, limit in _parts(batches):
        needed = (limit >= floors[:, None] - ROOM) & (blocks[None, :] != done[:, None])
        for at in np.flatnonzero(needed.any(axis=0)).tolist():
            rows = np.flatnonzero(needed[:, at])
            names = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), ids.take(pa.array(rows)))
            yield pa.record_batch([pa.array([int(blocks[at])]), names, pa.array([queries[rows].tobytes()]), pa.array([floors[rows].tobytes()])],
                                  names=["block", "query_ids", "vectors", "floors"])


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` best columns of each row; equal scores go to the smaller column."""
    least = min(k, scores.shape[1])
    limit = -np.partition(-scores, least - 1, axis=1)[:, least - 1]
    row, column = np.nonzero(scores >= limit[:, None])
    best = np.lexsort((column, -scores[row, column], row))
    row, column = row[best], column[best]
    kept = np.arange(len(row)) - np.searchsorted(row, row, side="left") < least
    return row[kept], column[kept]


def _scores(k: int):
    """Best items per query; each block comes ahead of the rows of its queries. Scores below a query's floor are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at] for name in batch.schema.names}
                if row["ids"].is_valid:
                    ids = row["ids"].values
                    items = _matrix(row["data"].as_buffer(), len(ids))
                    continue
                asked, floors = row["query_ids"].values, np.frombuffer(row["floors"].as_buffer(), float)
                score = np.round(_matrix(row["data"].as_buffer(), len(asked)) @ items.T, SCORE_DIGITS)
                r, c = _best(score, k)
                kept = score[r, c] >= floors[r] - ROOM
                r, c = r[kept], c[kept]
                yield pa.record_batch([asked.take(pa.array(r)), ids.take(pa.array(c)), pa.array(score[r, c])], names=["query_id", "id", "score"])
    return run


def _starts(rows: int):
    """Rows of at most ``rows`` queries that start in the same block; the queries come sorted by block."""
    def emit(table: pa.Table, block: int) -> pa.RecordBatch:
        names = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), _column(table, "query_id"))
        return pa.record_batch([pa.array([block]), names, pa.array([_unit(_column(table, "vector")).tobytes()]),
                                pa.array([np.full(table.num_rows, NO_FLOOR).tobytes()])],
                               names=["block", "query_ids", "vectors", "floors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = np.asarray(batch.column("done"))
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                for at in range(a, b, rows):
                    yield emit(pa.Table.from_batches([batch.slice(at, min(rows, b - at))]), int(blocks[a]))
    return run


def search(queries: DataFrame, collection: DataFrame, k: int = 3, items: int = ITEMS, chunk: int = QUERIES) -> Search:
    """The ``k`` most similar items of (id, vector) for each (query_id, vector), exactly."""
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be an integer from 1 up")
    ids, asked = collection.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    weights = F.transform("vector", lambda x, i: F.struct((-F.abs(x)).alias("w"), i.alias("i"), (x > 0).alias("up")))
    leading = F.transform(F.slice(F.array_sort(weights), 1, LEADING), lambda x: F.struct(x["i"], x["up"]))
    # Ranges are drawn from a first pass over the rows, so they are stored and not made twice.
    near = cut_lineage(collection.select("id", "vector", leading.alias("_lead"))).repartitionByRange("_lead", "id").sortWithinPartitions("_lead", "id")
    blocks = cut_lineage(near.select("id", "vector").mapInArrow(
        _cut(items, _block), f"block bigint, ids array<{ids}>, items binary, bounds binary"))
    groups = blocks.select("block", "bounds").mapInArrow(_cut(BOUNDS, _group), "number bigint, blocks binary, bounds binary")
    # One row per group of bounds; they are numbered so that every chunk can be told to meet every group.
    groups = cut_lineage(groups.withColumn("grp", F.row_number().over(Window.orderBy("number")) - 1))
    count, spark = groups.count(), queries.sparkSession
    left = cut_lineage(queries.select("query_id", "vector"))

    def meeting(rows: DataFrame) -> DataFrame:
        chunks = rows.select("query_id", "vector", "floor", "done").mapInArrow(
            _cut(chunk, _chunk), f"chunk bigint, query_ids array<{asked}>, vectors binary, floors binary, done binary")
        told = cut_lineage(chunks).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(max(0, count - 1)))))
        return told.join(groups.select("grp", "blocks", "bounds"), "grp").drop("grp", "chunk")

    visit = f"block bigint, query_ids array<{asked}>, vectors binary, floors binary"

    def met(visits: DataFrame) -> DataFrame:
        """Best items of the visited blocks; visits are dealt by block and follow it."""
        needed = blocks.join(visits.select("block").distinct(), "block", "left_semi").select(
            "block", F.lit(0).alias("side"), "ids", F.lit(None).cast(f"array<{asked}>").alias("query_ids"),
            F.lit(None).cast("binary").alias("floors"), F.col("items").alias("data"))
        rows = visits.select("block", F.lit(1).alias("side"), F.lit(None).cast(f"array<{ids}>").alias("ids"), "query_ids", "floors",
                             F.col("vectors").alias("data"))
        dealt = needed.unionByName(rows).repartition("block").sortWithinPartitions("block", "side").drop("block", "side")
        return dealt.mapInArrow(_scores(k), f"query_id {asked}, id {ids}, score double")

    told = meeting(left.withColumns({"floor": F.lit(NO_FLOOR), "done": F.lit(-1).cast("long")}))
    first = told.mapInArrow(_most_promising, f"query_id {asked}, block bigint, bound double")
    first = first.groupBy("query_id").agg(F.max_by("block", F.struct("bound", "block")).alias("done"))
    with arrow_rows(spark, WIDE_ROWS):
        first = cut_lineage(left.join(first, "query_id"))
    # The queries that start in a block, in rows of bounded size.
    dealt = first.withColumn("floor", F.lit(0.0)).repartition("done").sortWithinPartitions("done")
    starts = cut_lineage(dealt.select("query_id", "vector", "done").mapInArrow(_starts(chunk), visit))
    with arrow_rows(spark, WIDE_ROWS):
        lead = cut_lineage(met(starts))
    # The k-th best score of a query's first block; a block of fewer items gives no floor.
    floors = lead.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).select(
        "query_id", F.when(F.col("n") >= k, F.col("least")).otherwise(NO_FLOOR).alias("floor"))
    told = meeting(first.join(floors, "query_id"))
    with arrow_rows(spark, WIDE_ROWS):
        visits = cut_lineage(told.mapInArrow(_visits, visit))
        rest = cut_lineage(met(visits))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    hits = lead.unionByName(rest).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    sizes = blocks.select("block", F.size("ids").alias("items"))
    asked_of = first.groupBy(F.col("done").alias("block")).agg(F.count("*").alias("queries")).unionByName(
        visits.select("block", F.size("query_ids").cast("long").alias("queries")))
    return Search(hits, asked_of.join(sizes, "block").select("block", "queries", "items"))


def top_k(queries: DataFrame, collection: DataFrame, k: int = 3, block_bytes: int = 32 << 20) -> DataFrame:
    """The ``k`` most similar items per query, exactly, as (query_id, id, score, rank); a chunk of queries has some ``block_bytes``."""
    return search(queries, collection, k, chunk=max(1, min(QUERIES, block_bytes // QUERY_BYTES))).hits
