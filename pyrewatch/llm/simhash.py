"""Near-duplicate documents by SimHash fingerprints and pivot distance tables.

1. Each text becomes a 64-bit fingerprint: words (lower-cased A-Z), shingles of three words, XXH64 of each shingle, and
   per bit the majority over all shingles.
2. Only distinct fingerprints are compared. Fingerprints at 3 or fewer differing bits agree on two of five bit blocks,
   so each is dealt to ten cells by block pairs: every link has a cell that holds both ends, whatever the data.
3. Inside a cell a table holds each fingerprint's Hamming distances to many reference fingerprints. By the triangle
   inequality a pair whose distances to any reference differ by more than 3 is no link, so pairs are discarded by
   the largest coordinate difference and only the survivors are compared bit by bit. A cell yields the links of a
   spanning forest, never all its pairs. Rows of a large cell are ordered by one pivot's distance and compared only
   within 3 of it; a very large cell is first cut into overlapping strips along a pivot, each a group of its own.
4. Links are joined to components by repeated minimum-label steps over stored stages.

Defined results: null text is empty and has fingerprint zero, which links like any other; rows with equal ids take one
group's smallest id; an empty table gives no rows; extra columns are ignored. A null id never names a group of others
and takes part with its fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyrewatch.llm.components import connected
from pyrewatch.llm.stages import Stages

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Five blocks of bits; a pair of them makes a cell key.
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
N_PIVOTS = 24
#: Rows compared at once in a cell, and rows of a cell from which it is cut into strips.
TILE = 1024
STRIP_ROWS = 20_000
STRIP_WIDTH = 4

_digest = xxhash.xxh64_intdigest


def _pivots() -> np.ndarray:
    from pyrewatch.llm.arrays import mix

    return mix(np.arange(1, N_PIVOTS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def fingerprint(text: bytes | None) -> int:
    """Fingerprint of one text, unsigned."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        hashes = [_digest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        hashes = [_digest(joined[a:b], SEED)
                  for a, b in zip(starts[: 1 - SHINGLE].tolist(), (ends[SHINGLE - 1:] - 1).tolist(), strict=True)]
    return _majority(np.array(hashes, np.uint64))


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at: at + (1 << 14)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = ones * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        prints = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(batch)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints)], ["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text and fingerprint (as a signed long) of every row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_key")
                       ).mapInArrow(_print_batches, "doc_id long, text_key long, fp long")


def cell_keys() -> list:
    """The ten cell keys of a fingerprint column ``fp``: a tag and the bits of two blocks."""
    out = []
    for i in range(len(BLOCKS)):
        for j in range(i + 1, len(BLOCKS)):
            mask = sum(((1 << (hi - lo)) - 1) << lo for lo, hi in (BLOCKS[i], BLOCKS[j]))
            signed = mask - (1 << 64) if mask >> 63 else mask
            out.append(F.xxhash64(F.lit(i * 8 + j), F.col("fp").bitwiseAND(F.lit(signed))))
    return out


class _Forest:
    """Union by smaller index."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def cell_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all fingerprints of one cell which are connected by links inside it, at most one per row."""
    pivots = _pivots()
    table = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)
    widest = int(np.argmax(table.var(axis=0)))
    order = np.argsort(table[:, widest], kind="stable")
    fps, table = fps[order], table[order]
    reach = np.searchsorted(table[:, widest], table[:, widest] + MAX_BITS, "right")
    forest, links = _Forest(len(fps)), []
    for a in range(0, len(fps), TILE):
        rows = slice(a, min(a + TILE, len(fps)))
        for b in range(a, int(reach[rows.stop - 1]), TILE):
            cols = slice(b, min(b + TILE, len(fps)))
            near = np.ones((rows.stop - a, cols.stop - b), bool)
            for p in range(0, N_PIVOTS, 4):
                near &= np.abs(table[rows, None, p] - table[None, cols, p]) <= MAX_BITS
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            keep = i < j
            i, j = i[keep], j[keep]
            keep = np.abs(table[i] - table[j]).max(axis=1, initial=0) <= MAX_BITS
            i, j = i[keep], j[keep]
            keep = np.bitwise_count(fps[i] ^ fps[j]) <= MAX_BITS
            for x, y in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
                if forest.join(x, y):
                    links.append((int(order[x]), int(order[y])))
    return links


def _pairs_of_small(keys: np.ndarray, fps: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of many small cells at once: rows at distance 1, 2, ... inside the same cell."""
    pivots = _pivots()
    left, right = [], []
    for step in range(1, int(sizes.max(initial=1))):
        same = np.flatnonzero(keys[:-step] == keys[step:])
        if not len(same):
            break
        a, b = fps[same], fps[same + step]
        for p in pivots[:4]:
            keep = np.abs(np.bitwise_count(a ^ p).astype(np.int8) - np.bitwise_count(b ^ p).astype(np.int8)) <= MAX_BITS
            a, b = a[keep], b[keep]
        keep = np.bitwise_count(a ^ b) <= MAX_BITS
        left.append(a[keep])
        right.append(b[keep])
    empty = np.zeros(0, np.uint64)
    return np.concatenate(left or [empty]), np.concatenate(right or [empty])


SMALL = 16


def links_of_cells(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole cells, given in key order."""
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[heads, len(keys)])
    small = np.repeat(sizes <= SMALL, sizes)
    left, right = _pairs_of_small(keys[small], fps[small], sizes[sizes <= SMALL])
    left, right = [left], [right]
    for head, size in zip(heads[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        cell = fps[head: head + size]
        pairs = np.array(cell_links(cell), np.int64).reshape(-1, 2)
        left.append(cell[pairs[:, 0]])
        right.append(cell[pairs[:, 1]])
    return np.concatenate(left), np.concatenate(right)


def _cell_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell; a cell may run over several batches."""
    def out(keys, fps):
        a, b = links_of_cells(keys, fps)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    held_keys, held_fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        keys = np.concatenate((held_keys, batch.column(0).to_numpy(zero_copy_only=False)))
        fps = np.concatenate((held_fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield out(keys[:cut], fps[:cut])
        held_keys, held_fps = keys[cut:], fps[cut:]
    if len(held_keys):
        yield out(held_keys, held_fps)


def links(distinct: DataFrame, strip_rows: int = STRIP_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect whatever 3 or fewer bits connect."""
    cells = distinct.select("fp", F.explode(F.array(*cell_keys())).alias("cell"))
    crowded = (cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
                    .select("cell", (F.col("n") > strip_rows).alias("cut")))
    # A large cell is cut along its distance to one pivot. A row stands in its own strip and, if a row within 3 of it
    # can lie in the next strip, there too: every link lies inside one strip.
    pivot = int(_pivots().view(np.int64)[0])
    far = F.bit_count(F.col("fp").bitwiseXOR(F.lit(pivot)))
    home = F.floor(far / F.lit(STRIP_WIDTH))
    strips = F.when(F.col("cut"), F.array_distinct(F.array(home, F.floor((far + F.lit(MAX_BITS)) / F.lit(STRIP_WIDTH)))))
    dealt = cells.join(crowded, "cell").select(
        F.explode(F.coalesce(strips, F.array(F.lit(-1).cast("long")))).alias("strip"), "cell", "fp")
    dealt = dealt.select(F.xxhash64("cell", "strip").alias("cell"), "fp")
    return (dealt.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(_cell_batches, "a long, b long"))


def near_duplicates(docs: DataFrame, stages: Stages) -> DataFrame:
    """doc_id, text_key (hash of the text), fp, label (of the group) and component_id (smallest id in it) of every row."""
    rows = stages.keep(fingerprints(docs))
    distinct = stages.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    groups = connected(links(distinct.select("fp")), stages)
    named = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "doc_id", F.coalesce("label", "fp").alias("label"))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return rows.join(named.join(smallest, "label").select("fp", "label", "component_id"), "fp")


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, fingerprint as 16 hex digits, component_id."""
    out = near_duplicates(docs, Stages(docs.sparkSession))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Keep one row of each group of near copies, with all its columns: the smallest id, then the smallest text hash.

    Null ids come last; of rows alike in id and text one is kept, that with the smallest hash of all columns.
    """
    columns = docs.columns
    groups = near_duplicates(docs, Stages(docs.sparkSession))
    kept = (groups.groupBy("label")
                  .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("kept"))
                  .select(F.col("kept.doc_id").alias("__id"), F.col("kept.text_key").alias("__text")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.xxhash64("text").alias("__key"), F.col("doc_id").alias("__doc"))
    found = rows.join(kept, (F.col("__text") == F.col("__key")) & F.col("__id").eqNullSafe(F.col("__doc")), "left_semi")
    return (found.groupBy("__key", "__doc").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
                 .select(*[F.col(f"row.`{c}`").alias(c) for c in columns]))
