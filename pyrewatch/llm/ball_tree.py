"""Exact largest inner products by ball trees and branch and bound.

Each shard of vectors holds a ball tree: every node knows the centre and radius of its points, and no point of a ball
has a larger inner product with a query than ``q.centre + |q| * radius``. Nodes are taken in order of that bound. A
query leaves a node out when the bound is below its current k-th score, and the search ends when all do.

Shards share the k-th score: a query first searches the shard of the largest bound, and takes the score found there to
all other shards whose ball can still hold a better vector.

Vectors are dealt to shards by the nearest of some centres, fitted on a bounded sample (``SAMPLE`` rows by hash of the
id); every vector is indexed. Equal vectors are merged to the few smallest ids that a result can show. Queries are
taken in blocks of ``QUERY_BLOCK``.

Defined results: rows without an id or with a null, empty or non-finite vector take no part; vectors of another length
than a query's are no candidates; repeated rows count once; ties go to the smaller id; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyrewatch.llm.stages import Stages

SAMPLE = 20_000
SHARD_ROWS = 4096
MAX_SHARDS = 1 << 15
MAX_CENTRES = 512
LEAF_ROWS = 128
QUERY_BLOCK = 20_000
SCALE = 256.0
#: Bounds of queries and balls held at once, and visits of a batch.
BOUND_CELLS, VISIT_ROWS = 1 << 22, 1 << 14
#: Bounds are raised by this share, so that rounding never hides a point.
SLACK = 1e-9
#: Below every score, and safe to negate.
NO_SCORE = -(1 << 62)


def integers(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of floor(256 * x) for vectors of one length."""
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values * SCALE).reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows as 64-bit integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 1 << 53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class BallTree:
    """Nodes of a tree over rows, split at the median of the widest coordinate."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS):
        self.rows, self.ids = rows, ids
        self.centres, self.radii, self.children, self.members = [], [], [], []
        self.root = self._grow(np.arange(len(rows)), leaf)

    def _grow(self, members: np.ndarray, leaf: int) -> int:
        node = len(self.centres)
        points = self.rows[members]
        centre = points.mean(axis=0)
        self.centres.append(centre)
        self.radii.append(float(np.sqrt(((points - centre) ** 2).sum(axis=1).max())))
        self.children.append(())
        self.members.append(members)
        if len(members) > leaf and self.radii[node] > 0:
            spread = points.max(axis=0) - points.min(axis=0)
            order = points[:, int(spread.argmax())].argsort(kind="stable")
            half = len(members) // 2
            self.children[node] = (self._grow(members[order[:half]], leaf), self._grow(members[order[half:]], leaf))
        return node

    def search(self, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best (score, id) of each query, ties to the smaller id; id -1 fills up.

        ``floor`` holds a score per query below which nothing is wanted.
        """
        n = len(queries)
        scores, ids = np.full((n, k), NO_SCORE, np.int64), np.full((n, k), -1, np.int64)
        lengths = np.sqrt((queries ** 2).sum(axis=1))
        every = np.arange(n)
        heap = [(0.0, self.root, every, self._bound(self.root, queries, lengths))]
        while heap:
            _, node, active, bounds = heapq.heappop(heap)
            keep = bounds >= np.maximum(scores[active, -1], floor[active])
            active, bounds = active[keep], bounds[keep]
            if not len(active):
                continue
            if self.children[node]:
                for child in self.children[node]:
                    below = self._bound(child, queries[active], lengths[active])
                    heapq.heappush(heap, (-float(below.max()), child, active, below))
                continue
            members = self.members[node]
            found = products(queries[active], self.rows[members])
            all_scores = np.concatenate((scores[active], found), axis=1)
            all_ids = np.concatenate((ids[active], np.broadcast_to(self.ids[members], found.shape)), axis=1)
            order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            scores[active] = np.take_along_axis(all_scores, order, 1)
            ids[active] = np.take_along_axis(all_ids, order, 1)
        return scores, ids

    def _bound(self, node: int, queries: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return _bounds(queries, lengths, self.centres[node][None, :], np.array([self.radii[node]]))[:, 0]


def _bounds(queries: np.ndarray, lengths: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Largest inner product of each query with any point of each ball."""
    middle, reach = queries @ centres.T, lengths[:, None] * radii[None, :]
    size = lengths[:, None] * (np.sqrt((centres ** 2).sum(axis=1)) + radii)[None, :]
    return middle + reach + SLACK * size + SLACK


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
                   .filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite))


def _centres(sample: np.ndarray, count: int, rounds: int = 4) -> np.ndarray:
    """Some rounds of k-means from evenly spaced rows of the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, count).astype(np.int64)]
    for _ in range(rounds):
        nearest = _nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        counts = np.bincount(nearest, minlength=count)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(axis=1)[None, :] - 2 * rows @ centres.T).argmin(axis=1)


def _deal(centres: np.ndarray, width: int):
    """Number of the nearest centre; vectors of another length get numbers of their own behind them."""
    def run(batches):
        for batch in batches:
            column = batch.column(1)
            lengths = np.diff(column.offsets.to_numpy())
            near = len(centres) + lengths.astype(np.int64)
            same = np.flatnonzero(lengths == width)
            if len(same):
                near[same] = _nearest(integers(pa.chunked_array([column.take(pa.array(same))])), centres)
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(near)], ["vec_id", "embedding", "near"])
    return run


_BALL = "shard long, width int, centre array<double>, radius double, n long"


def _ball_rows(table: pa.Table) -> pa.Table:
    rows = integers(table.column("embedding"))
    centre = rows.mean(axis=0)
    radius = float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max()))
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()),
                     "width": pa.array([rows.shape[1]], pa.int32()),
                     "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": pa.array([radius]),
                     "n": pa.array([len(rows)], pa.int64())})


def _ball_arrays(balls: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Shards, centres and radii of the balls of each width."""
    widths = balls.column("width").to_numpy()
    out = {}
    for width in np.unique(widths).tolist():
        own = balls.filter(pa.array(widths == width))
        centres = np.asarray(own.column("centre").combine_chunks().flatten(), dtype=float).reshape(-1, width)
        out[width] = own.column("shard").to_numpy(), centres, own.column("radius").to_numpy()
    return out


def _visits(by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], first: bool):
    """Shards that each query visits: the one of largest bound, or all others that can reach its k-th score.

    Bounds are taken for some queries at a time, ``BOUND_CELLS`` numbers at most.
    """
    def reached(batch: pa.RecordBatch, column: pa.Array, at: np.ndarray, width: int) -> pa.RecordBatch:
        shards, centres, radii = by_width[width]
        queries = integers(pa.chunked_array([column.take(pa.array(at))]))
        bound = _bounds(queries, np.sqrt((queries ** 2).sum(axis=1)), centres, radii)
        if first:
            which, shard = np.arange(len(at)), bound.argmax(axis=1)
            floor = np.full(len(which), NO_SCORE)
        else:
            floors = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)[at]
            reach = bound >= floors[:, None]
            reach[np.arange(len(at)), bound.argmax(axis=1)] = False
            which, shard = np.nonzero(reach)
            floor = floors[which]
        chosen = pa.array(at[which])
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(chosen), column.take(chosen), pa.array(shards[shard], pa.int64()), pa.array(floor, pa.int64())],
            ["query", "embedding", "shard", "floor"])

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            lengths = np.diff(column.offsets.to_numpy())
            for width in np.unique(lengths).tolist():
                if width not in by_width:
                    continue
                at = np.flatnonzero(lengths == width)
                rows = max(1, BOUND_CELLS // len(by_width[width][0]))
                for start in range(0, len(at), rows):
                    found = reached(batch, column, at[start:start + rows], width)
                    # A query may reach every shard, so what leaves is cut up too.
                    for part in range(0, found.num_rows, VISIT_ROWS):
                        yield found.slice(part, VISIT_ROWS)
    return run


_VISIT = "query long, embedding array<double>, shard long, floor long"
_FOUND = "query long, vec_id long, score long"


def _search_rows(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, vec_ids, scores = [], [], []
        if len(left) and len(right):
            tree = BallTree(integers(left.column("embedding")), left.column("vec_id").to_numpy())
            rows, floor = integers(right.column("embedding")), right.column("floor").to_numpy()
            names = right.column("query").to_numpy()
            for at in range(0, len(rows), 1024):
                part = slice(at, at + 1024)
                found, ids = tree.search(rows[part], k, floor[part])
                some = ids >= 0
                some &= found >= floor[part][:, None]
                queries.append(np.repeat(names[part], some.sum(axis=1)))
                vec_ids.append(ids[some])
                scores.append(found[some])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.table({"query": pa.array(join(queries), pa.int64()), "vec_id": pa.array(join(vec_ids), pa.int64()),
                         "score": pa.array(join(scores), pa.int64())})
    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_products(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` other vectors of largest inner product with each query."""
    stages = Stages(vectors.sparkSession)
    rows = usable(vectors)
    asked = stages.keep(rows.filter(is_query).distinct().withColumn("query", F.xxhash64("embedding")))
    # A result shows at most k ids of equal vectors beside the query's own.
    order = Window.partitionBy("embedding").orderBy("vec_id")
    few = stages.keep(rows.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k + 1).drop("rank").distinct())
    total = few.count()
    if not total:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = few.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().column("embedding")
    lengths = np.diff(sample.combine_chunks().offsets.to_numpy())
    width = int(np.bincount(lengths).argmax())
    sample = integers(pa.chunked_array([sample.combine_chunks().take(pa.array(np.flatnonzero(lengths == width)))]))
    centres = _centres(sample, min(len(sample), max(1, min(MAX_CENTRES, total // SHARD_ROWS * 2))))
    dealt = stages.keep(few.mapInArrow(_deal(centres, width), "vec_id long, embedding array<double>, near long"))
    size = max(SHARD_ROWS, -(-2 * total // MAX_SHARDS))
    crowds = dealt.groupBy("near").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("parts"))
    shards = dealt.join(F.broadcast(crowds), "near").select(
        "vec_id", "embedding", F.xxhash64("near", F.pmod(F.xxhash64("vec_id"), "parts")).alias("shard"))
    # At most a few times MAX_SHARDS rows, whatever the table's size.
    balls = _ball_arrays(shards.groupBy("shard").applyInArrow(_ball_rows, _BALL).toArrow())
    blocks = -(-asked.count() // QUERY_BLOCK)
    out = None
    for block in range(blocks):
        mine = asked.filter(F.pmod("query", F.lit(blocks)) == block)
        part = _search_block(mine, shards, balls, k, stages)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _search_block(asked: DataFrame, shards: DataFrame, balls: dict, k: int, stages: Stages) -> DataFrame:
    distinct = asked.select("query", "embedding").dropDuplicates(["query", "embedding"])
    groups = shards.groupBy("shard")
    first = distinct.mapInArrow(_visits(balls, True), _VISIT)
    near = stages.keep(_best(groups.cogroup(first.groupBy("shard")).applyInArrow(_search_rows(k + 1), _FOUND), k + 1))
    # The k-th score so far; a query whose first shard holds fewer vectors has none yet.
    reached = near.groupBy("query").agg(
        F.when(F.count(F.lit(1)) > k, F.min("score")).otherwise(F.lit(NO_SCORE)).alias("floor"))
    on = distinct.join(reached, "query", "left").select(
        "query", "embedding", F.coalesce("floor", F.lit(NO_SCORE)).alias("floor"))
    rest = on.mapInArrow(_visits(balls, False), _VISIT)
    far = groups.cogroup(rest.groupBy("shard")).applyInArrow(_search_rows(k + 1), _FOUND)
    best = _best(near.drop("rank").unionByName(far), k + 1).select("query", "vec_id", "score")
    named = asked.select("query", F.col("vec_id").alias("query_id")).join(best, "query").filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
                 .select("query_id", "rank", "vec_id", "score"))
