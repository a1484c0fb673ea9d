"""Centroid clustering by Lloyd's rounds over vectors sharded by dimension.

Vectors are dealt to chunks, and a chunk to one row per block of columns. A column-block task knows its slice of the
centroids alone and computes exact partial squared distances; partial distances of a chunk are added up by key, the
smallest wins, and only the winners' numbers travel back: the blocks lie in buckets of (chunk, block), so they never
move again. Each block then sums its own columns per cluster and updates its own slice. The slices of a round are one
tiny table, of centroids x dimensions numbers whatever the size of the corpus, and reach the blocks by a join.

All arithmetic is in whole numbers, so a result does not depend on the order of additions.

Defined results: a vector that is null, of another length, or holds a null or non-finite component takes no part. Rows
are clustered one by one, repeated ids and null ids included; a null id comes after all others when the first centroids
are chosen, and equal hashes are ordered by their components. With fewer vectors than centroids each vector starts one.
A component outside +-2**27 after scaling counts as that bound, as squared distances would leave the range of a long; an
inertia that leaves it is null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyrewatch.llm.stages import Stages

LARGEST = 1 << 27
#: Vectors of a chunk, and bytes of vectors in a bucket.
CHUNK_ROWS = 1024
BUCKET_BYTES = 64 << 20
MOST_BUCKETS = 20_000
#: Numbers in all centroids together: the slices are joined by broadcast.
MOST_CELLS = 1 << 20
#: Numbers of a centroid slice, and of a chunk's partial distances, that one row may hold.
SLICE_CELLS, PARTIAL_CELLS = 1 << 14, 1 << 17


def kept_vectors(vectors: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, q): the vectors that take part, as whole numbers."""
    def whole(x: Column) -> Column:
        return F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int")

    e = F.col("embedding")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    kept = vectors.where((F.size(e) == dimensions) & sound)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, whole).alias("q"))


def _chunks(rows: int, width: int, blocks: int):
    """A row per column block of every ``rows`` vectors; the first block carries their ids and which are known."""
    schema = pa.schema([("chunk", pa.int64()), ("block", pa.int32()), ("data", pa.binary()), ("ids", pa.binary())])

    def emit(chunk: int, ids: list[pa.Array], parts: list[np.ndarray]) -> pa.RecordBatch:
        matrix, names = np.concatenate(parts), pa.concat_arrays(ids)
        named = np.asarray(names.fill_null(0), dtype="<i8").tobytes()
        known = np.packbits(np.asarray(names.is_valid())).tobytes()
        data = [np.ascontiguousarray(matrix[:, b * width:(b + 1) * width]).tobytes() for b in range(blocks)]
        return pa.record_batch([[chunk] * blocks, list(range(blocks)), data, [named + known] + [None] * (blocks - 1)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids, parts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            flat = np.asarray(batch.column(1).flatten(), dtype="<i4").reshape(batch.num_rows, -1)
            at = 0
            while at < batch.num_rows:
                take = min(rows - held, batch.num_rows - at)
                ids.append(batch.column(0).slice(at, take))
                parts.append(flat[at:at + take])
                held, at = held + take, at + take
                if held == rows:
                    yield emit(chunk, ids, parts)
                    chunk, ids, parts, held = chunk + 1, [], [], 0
        if held:
            yield emit(chunk, ids, parts)
    return run


def _partial_distances(centroids: int):
    """Exact squared distances of a chunk's vectors to all centroids, over the columns of one block."""
    schema = pa.schema([("chunk", pa.int64()), ("partial", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data, centres in zip(*(batch.column(c) for c in ("chunk", "data", "centres")), strict=True):
                c = np.asarray(centres.values, dtype=np.int64).reshape(centroids, -1)
                x = np.frombuffer(data.as_buffer(), "<i4").reshape(-1, c.shape[1]).astype(np.int64)
                out = np.empty((len(x), len(c)), np.int64)
                for k in range(len(c)):
                    apart = x - c[k]
                    out[:, k] = np.einsum("ij,ij->i", apart, apart)
                yield pa.record_batch([[chunk.as_py()], [out.tobytes()]], schema=schema)
    return run


def _nearest(centroids: int):
    """Adds the partial distances of a chunk by blocks; the nearest centroid of each vector, ties to the smaller number."""
    schema = pa.schema([("chunk", pa.int64()), ("labels", pa.binary()), ("distances", pa.binary())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        total = None
        for partial in table.column("partial"):
            partial = np.frombuffer(partial.as_buffer(), np.int64)
            total = partial.copy() if total is None else total + partial
        total = total.reshape(-1, centroids)
        labels = total.argmin(axis=1)
        near = total[np.arange(len(total)), labels]
        return pa.table([[key[0].as_py()], [labels.astype("<i4").tobytes()], [near.tobytes()]], schema=schema)
    return run


def _sums():
    """Per task and block: number of a cluster's vectors and sums of their columns."""
    schema = pa.schema([("block", pa.int32()), ("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], int] = {}
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, data, labels in zip(*(batch.column(c) for c in ("block", "data", "labels")), strict=True):
                label = np.frombuffer(labels.as_buffer(), "<i4")
                x = np.frombuffer(data.as_buffer(), "<i4").reshape(len(label), -1)
                for k in np.unique(label).tolist():
                    key, own = (block.as_py(), k), x[label == k]
                    counts[key] = counts.get(key, 0) + len(own)
                    sums[key] = sums.get(key, 0) + own.sum(axis=0, dtype=np.int64)
        if counts:
            yield pa.record_batch([[k[0] for k in counts], [k[1] for k in counts], list(counts.values()),
                                   [sums[k].tolist() for k in counts]], schema=schema)
    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per vector from a chunk's ids, clusters and distances."""
    for batch in batches:
        for data, labels, near in zip(*(batch.column(c) for c in ("ids", "labels", "distances")), strict=True):
            label, raw = np.frombuffer(labels.as_buffer(), "<i4"), data.as_buffer()
            known = np.unpackbits(np.frombuffer(raw, np.uint8, offset=8 * len(label)), count=len(label)).astype(bool)
            ids = pa.array(np.frombuffer(raw, "<i8", count=len(label)), mask=~known)
            yield pa.record_batch([ids, pa.array(label), pa.array(np.frombuffer(near.as_buffer(), np.int64))],
                                  names=["vec_id", "cluster", "distance"])


class Lloyd:
    """The blocks of one run in their buckets, and a round over them."""

    def __init__(self, stages: Stages, dimensions: int, centroids: int, width: int):
        if centroids * dimensions > MOST_CELLS:
            raise ValueError(f"at most {MOST_CELLS} numbers in all centroids")
        self.stages, self.spark, self.dimensions, self.centroids = stages, stages.spark, dimensions, centroids
        self.width = max(1, min(width, dimensions, SLICE_CELLS // centroids))
        self.blocks = -(-dimensions // self.width)
        self.table = f"blocks_{uuid4().hex}"

    def first_slices(self, rows: DataFrame, seed: int) -> DataFrame:
        """(block, centres): per block its columns of the first centroids, one centroid after another."""
        key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
        order = [F.asc_nulls_last("key"), F.asc("q")]
        chosen = rows.select(key.alias("key"), "q").orderBy(*order).limit(self.centroids)
        # No more rows than centroids.
        numbered = chosen.withColumn("cluster", F.row_number().over(Window.orderBy(*order)) - 1)
        parts = F.array(*[F.slice("q", b * self.width + 1, self.width) for b in range(self.blocks)])
        return self._whole(numbered.select("cluster", F.posexplode(parts.cast("array<array<long>>")).alias("block", "part")))

    def _whole(self, parts: DataFrame) -> DataFrame:
        slices = F.array_sort(F.collect_list(F.struct("cluster", "part")))
        return parts.groupBy("block").agg(F.flatten(F.transform(slices, lambda x: x["part"])).alias("centres"))

    def store(self, rows: DataFrame, count: int) -> None:
        """Write the blocks once, in buckets of (chunk, block); ``count`` vectors are expected."""
        least = min(count * self.blocks // CHUNK_ROWS, self.spark.sparkContext.defaultParallelism)
        buckets = max(1, least, min(MOST_BUCKETS, count * self.dimensions * 4 // BUCKET_BYTES))
        size = max(16, min(CHUNK_ROWS, PARTIAL_CELLS // self.centroids))
        chunks = rows.mapInArrow(_chunks(size, self.width, self.blocks), "chunk long, block int, data binary, ids binary")
        (chunks.repartition(buckets, "chunk", "block").write.format("parquet").bucketBy(buckets, "chunk", "block")
         .option("path", f"{self.stages.folder}/{self.table}").saveAsTable(self.table))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def labels(self, slices: DataFrame, centroids: int) -> DataFrame:
        """(chunk, labels, distances) under the centroids of ``slices``."""
        blocks = self.spark.table(self.table).select("chunk", "block", "data")
        rows = blocks.join(F.broadcast(slices), "block").select("chunk", "data", "centres")
        partial = rows.mapInArrow(_partial_distances(centroids), "chunk long, partial binary")
        return partial.groupBy("chunk").applyInArrow(_nearest(centroids), "chunk long, labels binary, distances binary")

    def updated(self, labels: DataFrame, slices: DataFrame) -> DataFrame:
        """The slices after the vectors moved. Every block sums its own columns; a centroid without vectors stays."""
        told = labels.select("chunk", "labels", F.explode(F.array(*map(F.lit, range(self.blocks)))).alias("block"))
        blocks = self.spark.table(self.table).select("chunk", "block", "data")
        sums = blocks.join(told, ["chunk", "block"]).select("block", "data", "labels").mapInArrow(
            _sums(), "block int, cluster int, n long, sums array<long>")
        n = F.sum("n")
        totals = F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(self.width)])
        added = sums.groupBy("block", "cluster").agg(n.alias("n"), F.array_compact(totals).alias("totals"))
        moved = added.select("block", "cluster", F.expr("transform(totals, t -> (t - pmod(t, n)) div n)").alias("moved"))
        return self._whole(self._rows(slices).join(moved, ["block", "cluster"], "left").select(
            "block", "cluster", F.coalesce("moved", "part").alias("part")))

    def _rows(self, slices: DataFrame) -> DataFrame:
        """(block, cluster, part) of the slices."""
        width = F.least(F.lit(self.width), F.lit(self.dimensions) - F.col("block") * self.width)
        starts = F.sequence(F.lit(1), F.size("centres"), width)
        parts = F.transform(starts, lambda at: F.slice("centres", at, width))
        return slices.select("block", F.posexplode(parts).alias("cluster", "part"))

    def vectors(self, labels: DataFrame) -> DataFrame:
        """(vec_id, cluster, distance) of every vector."""
        ids = self.spark.table(self.table).where("block = 0").select("chunk", "ids")
        return labels.join(ids, "chunk").select("ids", "labels", "distances").mapInArrow(
            _named, "vec_id long, cluster int, distance long")

    def centroid_hashes(self, slices: DataFrame) -> DataFrame:
        """(cluster, centroid_sha256) of the whole centroids."""
        parts = F.array_sort(F.collect_list(F.struct("block", "part")))
        text = F.array_join(F.flatten(F.transform(parts, lambda x: x["part"])).cast("array<string>"), ",")
        return self._rows(slices).groupBy("cluster").agg(F.sha2(text, 256).alias("centroid_sha256"))


def cluster(vectors: DataFrame, centroids: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024,
            seed: int = 3, width: int = 16) -> DataFrame:
    """Lloyd's rounds from hashed first centroids, with blocks of ``width`` columns.

    Returns vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part.
    """
    stages = Stages(vectors.sparkSession)
    rows = kept_vectors(vectors, dimensions, scale)
    run = Lloyd(stages, dimensions, centroids, width)
    slices = stages.keep(run.first_slices(rows, seed))
    count = rows.count()
    run.store(rows, count)
    try:
        known = min(count, centroids)
        for _ in range(rounds):
            before, slices = slices, stages.keep(run.updated(run.labels(slices, known), slices))
            stages.drop(before)
        found = stages.keep(run.vectors(stages.keep(run.labels(slices, known))))
    finally:
        run.drop()
    # One row per centroid.
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = found.groupBy("cluster").agg(total.alias("own"))
    whole = Window.partitionBy(F.lit(1))
    sums = sums.withColumn("all", F.sum("own").over(whole)).select(
        "cluster", F.col("own").try_cast("long").alias("cluster_inertia"), F.col("all").try_cast("long").alias("inertia"))
    told = sums.join(run.centroid_hashes(slices), "cluster")
    return found.join(F.broadcast(told), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
