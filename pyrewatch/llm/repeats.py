"""Finding text repeated across documents: routing candidate windows to shards, and putting the verdicts back.

A window is ``size`` consecutive symbols (words or bytes) of one document. The task is to find, for every window, the
smallest document id it occurs in. Comparing each shard of the corpus with all documents would be quadratic, so windows
are routed first, without losing any:

1. Equal texts are grouped; each distinct text stands for its smallest id. Distinct texts are dealt to groups and
   written once as a bucketed table, so later passes read it without moving text again.
2. Every window has an anchor: the smallest hash among its runs of ``gram`` symbols. Equal windows have equal anchors,
   and consecutive windows mostly share one. Each group sends its distinct anchors (a few bytes each) to the anchor's
   bucket; an anchor that only one text holds can not lie in a repeated window.
3. Windows of shared anchors are routed by the anchor's owner, the text of smallest label that holds it, so a copied
   document travels as a few long segments. Anchors of very many texts are routed by themselves and then dealt
   further by a second, finer anchor: equal windows still meet, and texts that share little more than it part.
4. Equal segments are merged, in each group and again in a shard; a shard holds whole routes and answers, by an index of
   its own, which windows of a segment also stand in a smaller document. How it does so is the caller's method (``shard``).
5. A passage that very many texts hold stays one route under any anchor, with a segment for each text around it. A
   route over the bytes of a shard is therefore no shard: its segments are dealt to chunks, each chunk sends a row per
   distinct window (128 bits of its content, smallest and largest id), rows of equal windows are aggregated, and the
   smallest ids return to the chunks that need them. No task holds what shares a window.
6. Verdicts return to the groups and are applied to the texts.

Ids: null counts as larger than any id, so a text without id is removed against all others and never removes from one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyrewatch.llm.arrays import BYTE_CODES, U64, RollingHash, Texts, mix, sliding_min, text_slices, words_of
from pyrewatch.llm.stages import Stages
from pyrewatch.session import shuffles_end_with_jobs

NO_ID = (1 << 63) - 1
#: Text of a group, and anchor bytes of a bucket, as bytes of the corpus.
GROUP_BYTES = 6 << 20
BUCKET_BYTES = 12 << 20
#: Texts that hold an anchor before it is routed by itself, and the share of one finer route.
HOT_TEXTS = 512


@dataclass(frozen=True)
class Windows:
    """What a window is. ``cut`` bounds the windows of a segment."""

    words: bool
    size: int = 50
    gram: int = 20
    cut: int = 1024

    @property
    def fine(self) -> int:
        return max(self.gram, self.size * 4 // 5)


@dataclass(frozen=True)
class Segment:
    """A distinct run of windows in a shard: its bytes and the smallest id it stands in."""

    content: bytes
    smallest: int


#: Gets the segments of a shard; gives per segment an array with, for each window, the smallest id it stands in.
Shard = Callable[[list[Segment], Windows], list[np.ndarray]]


class _View:
    """Windows of a slice of texts: which starts are valid and their anchors."""

    def __init__(self, texts: Texts, kind: Windows):
        self.texts, self.kind = texts, kind
        if kind.words:
            self.words = words_of(texts)
            codes, self.bounds = self.words.hashes, self.words.bounds
        else:
            codes, self.bounds = BYTE_CODES[texts.data], texts.bounds
        self.hash = RollingHash(codes)
        self.anchors = sliding_min(self.hash.grams(kind.gram), kind.size - kind.gram + 1)
        n = len(self.anchors)
        lengths = np.diff(self.bounds)
        self.document = np.repeat(np.arange(len(lengths)), lengths)[:n]
        self.valid = np.arange(n) + kind.size <= self.bounds[1:][self.document]

    def runs(self, value: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of runs of equal ``value`` inside one document, where ``use`` holds."""
        if not use.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        same = np.zeros(len(use), bool)
        same[1:] = use[1:] & use[:-1] & (value[1:] == value[:-1]) & (self.document[1:] == self.document[:-1])
        starts = np.flatnonzero(use & ~same)
        last = np.ones(len(use), bool)
        last[:-1] = ~same[1:]
        return starts, np.flatnonzero(use & last) + 1

    def content(self, start: int, windows: int) -> bytes:
        end = start + windows + self.kind.size - 1
        if not self.kind.words:
            return self.texts.data[start:end].tobytes()
        raw = self.texts.data[self.words.starts[start]:self.words.ends[end - 1]].tobytes()
        return b" ".join(raw.split())

    def routes(self, keys: np.ndarray, owners: np.ndarray, parts: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """Route of every window and whether it has one. ``keys`` (sorted) are the shared anchors."""
        starts, ends = self.runs(self.anchors, self.valid)
        if not len(starts) or not len(keys):
            return np.zeros(len(self.valid), np.int64), np.zeros(len(self.valid), bool)
        found = np.minimum(np.searchsorted(keys, self.anchors[starts] >> U64(shift)), len(keys) - 1)
        shared = keys[found] == self.anchors[starts] >> U64(shift)
        route = np.zeros(len(self.valid), np.int64)
        use = np.zeros(len(self.valid), bool)
        span = np.zeros(len(self.valid) + 1, np.int64)
        np.add.at(span, starts[shared], 1)
        np.add.at(span, ends[shared], -1)
        use = np.cumsum(span[:-1]) > 0
        lengths = (ends - starts)[shared]
        route[use] = np.repeat(owners[found[shared]], lengths)
        part = np.ones(len(route), np.int64)
        part[use] = np.repeat(parts[found[shared]], lengths)
        hot = np.flatnonzero(use & (part > 1))
        if len(hot):
            fine = sliding_min(self.hash.grams(self.kind.fine), self.kind.size - self.kind.fine + 1)
            salt = mix(fine[hot]) % part[hot].astype(U64)
            route[hot] = (mix(route[hot].astype(U64) * U64(0x9E3779B97F4A7C15) + salt + U64(1)) >> U64(33)).astype(np.int64)
        return route, use


def _labels(table: pa.Table) -> np.ndarray:
    """A 32-bit label per text, from its key."""
    keys = table.column("key").to_numpy().astype(np.int64).view(np.uint64)
    return (mix(keys + U64(1)) >> U64(32)).astype(np.uint32)


def _runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return starts, np.append(starts[1:], len(values))


def _anchor_rows(kind: Windows, shift: int) -> Callable[[pa.Table], pa.Table]:
    """Per group: its distinct anchors by bucket, each with the smallest label and the number of texts."""
    def run(table: pa.Table) -> pa.Table:
        labels, hashes, owners = _labels(table), [], []
        for texts in text_slices(table.column("text")):
            view = _View(texts, kind)
            starts, _ = view.runs(view.anchors, view.valid)
            hashes.append(view.anchors[starts] >> U64(shift))
            owners.append(labels[texts.first + view.document[starts]])
        hashes, owners = _joined(hashes, U64), _joined(owners, np.uint32)
        order = np.lexsort((owners, hashes))
        hashes, owners = hashes[order], owners[order]
        once = np.ones(len(hashes), bool)
        once[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
        hashes, owners = hashes[once], owners[once]
        head, end = _runs_of(hashes)
        texts_with = np.minimum(end - head, 65535).astype(np.uint16)
        hashes, owners = hashes[head], owners[head]
        bucket = (hashes >> U64(32)).astype(np.int64)
        cut, ends = _runs_of(bucket)
        group = int(table.column("grp")[0].as_py()) if len(table) else 0
        low = hashes.astype(np.uint32)
        blobs = [low[a:b].tobytes() + owners[a:b].tobytes() + texts_with[a:b].tobytes() for a, b in zip(cut, ends, strict=True)]
        return pa.table({"bucket": pa.array(bucket[cut], pa.int64()), "grp": pa.array([group] * len(cut), pa.int32()),
                         "blob": pa.array(blobs, pa.binary())})
    return run


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _shared_rows(table: pa.Table) -> pa.Table:
    """Per bucket: the anchors that more than one text holds, sent back to each group that has them."""
    lows, owners, counts, groups = [], [], [], []
    for blob, group in zip(table.column("blob").to_pylist(), table.column("grp").to_pylist(), strict=True):
        n = len(blob) // 10
        lows.append(np.frombuffer(blob, np.uint32, n))
        owners.append(np.frombuffer(blob, np.uint32, n, 4 * n))
        counts.append(np.frombuffer(blob, np.uint16, n, 8 * n))
        groups.append(np.full(n, group, np.int32))
    low, owner, count, group = np.concatenate(lows), np.concatenate(owners), np.concatenate(counts), np.concatenate(groups)
    order = low.argsort()
    low, owner, count, group = low[order], owner[order], count[order], group[order]
    head, end = _runs_of(low)
    number = end - head
    texts = np.add.reduceat(count.astype(np.int64), head)
    first = np.minimum.reduceat(owner, head).astype(np.int64)
    bucket = table.column("bucket")[0].as_py()
    parts = np.minimum(-(-texts // HOT_TEXTS), 65535)
    alone = (mix(low[head].astype(U64) + (U64(bucket) << U64(32)) + U64(1)) >> U64(33)).astype(np.int64)
    first = np.where(parts > 1, alone, first)
    keep = np.repeat(texts > 1, number)
    low, group = low[keep], group[keep]
    first, parts = np.repeat(first, number)[keep].astype(np.uint32), np.repeat(parts, number)[keep].astype(np.uint16)
    order = np.lexsort((low, group))
    low, group, first, parts = low[order], group[order], first[order], parts[order]
    cut, ends = _runs_of(group)
    blobs = [low[a:b].tobytes() + first[a:b].tobytes() + parts[a:b].tobytes() for a, b in zip(cut, ends, strict=True)]
    return pa.table({"grp": pa.array(group[cut], pa.int32()), "bucket": pa.array([bucket] * len(cut), pa.int64()),
                     "blob": pa.array(blobs, pa.binary())})


_SEGMENT = "route long, sid binary, content binary, least long, grp int, key long, smallest long, at int, windows int"


def _segment_rows(kind: Windows, shift: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Per group: the segments of its texts that hold shared anchors. Equal content is sent once, with its smallest id."""
    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        out = {name: [] for name in ("route", "sid", "content", "least", "grp", "key", "smallest", "at", "windows")}
        keys, owners, parts = _lookup(back)
        sent: dict[bytes, int] = {}
        if len(table) and len(keys):
            ids, names = table.column("smallest").to_pylist(), table.column("key").to_pylist()
            group = table.column("grp")[0].as_py()
            for texts in text_slices(table.column("text")):
                view = _View(texts, kind)
                route, use = view.routes(keys, owners, parts, shift)
                starts, ends = view.runs(route, use)
                for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
                    row = int(view.document[start])
                    for at in range(start, end, kind.cut):
                        windows = min(kind.cut, end - at)
                        content = view.content(at, windows)
                        where = int(route[at])
                        sid = xxhash.xxh3_128_digest(content, where)
                        mine, this = ids[texts.first + row], len(out["sid"])
                        first = sent.setdefault(sid, this)
                        out["content"].append(content if first == this else None)
                        out["least"].append(mine if first == this else None)
                        out["least"][first] = min(out["least"][first], mine)
                        out["route"].append(where)
                        out["sid"].append(sid)
                        out["grp"].append(group)
                        out["key"].append(names[texts.first + row])
                        out["smallest"].append(mine)
                        out["at"].append(at - int(view.bounds[row]))
                        out["windows"].append(windows)
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.table({name: pa.array(column, t) for (name, column), t in zip(out.items(), kinds, strict=True)})
    return run


def _lookup(back: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, owners, parts = [], [], []
    for bucket, blob in zip(back.column("bucket").to_pylist(), back.column("blob").to_pylist(), strict=True):
        n = len(blob) // 10
        keys.append(np.frombuffer(blob, np.uint32, n).astype(U64) + (U64(bucket) << U64(32)))
        owners.append(np.frombuffer(blob, np.uint32, n, 4 * n).astype(np.int64))
        parts.append(np.frombuffer(blob, np.uint16, n, 8 * n).astype(np.int64))
    keys, owners, parts = _joined(keys, U64), _joined(owners, np.int64), _joined(parts, np.int64)
    order = keys.argsort()
    return keys[order], owners[order], parts[order]


def _edges(less: np.ndarray) -> bytes:
    """Starts and ends of the runs of windows to remove."""
    less = np.concatenate(([False], less, [False]))
    return np.flatnonzero(less[1:] != less[:-1]).astype(np.int32).tobytes()


_ANSWER = "sid binary, first_id long, edges binary"


def _shard_batches(kind: Windows, shard: Shard, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by route and segment. Whole routes are gathered to shards of about ``limit`` bytes."""
    def answer(rows: list[tuple[bytes, Segment]]) -> pa.RecordBatch:
        found = shard([segment for _, segment in rows], kind)
        blobs = []
        for (_, segment), smallest in zip(rows, found, strict=True):
            blobs.append(_edges(smallest < segment.smallest))
        return pa.RecordBatch.from_arrays(
            [pa.array([sid for sid, _ in rows], pa.binary()), pa.array([s.smallest for _, s in rows], pa.int64()),
             pa.array(blobs, pa.binary())], ["sid", "first_id", "edges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, Segment]] = []
        size, last = 0, None
        for batch in batches:
            for route, sid, content, smallest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if route != last:
                    if size >= limit:
                        yield answer(held)
                        held, size = [], 0
                    last = route
                if held and held[-1][0] == sid:  # sent by another group too
                    held[-1] = (sid, Segment(content, min(smallest, held[-1][1].smallest)))
                    continue
                held.append((sid, Segment(content, smallest)))
                size += len(content)
        if held:
            yield answer(held)
    return run


def _window_keys(contents: list[bytes], kind: Windows) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the content of every window of the segments, one row each, and the number of windows per segment."""
    digests, counts = [], []
    for content in contents:
        if kind.words:
            spaces = np.flatnonzero(np.frombuffer(content, np.uint8) == 32)
            starts, ends = np.append(0, spaces + 1), np.append(spaces, len(content))
        else:
            starts = np.arange(len(content))
            ends = starts + 1
        windows = len(starts) - kind.size + 1
        digests.append(b"".join([xxhash.xxh3_128_digest(content[a:b]) for a, b in
                                 zip(starts[:windows].tolist(), ends[kind.size - 1:].tolist(), strict=True)]))
        counts.append(windows)
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2), np.array(counts, np.int64)


def _window_rows(kind: Windows) -> Callable[[pa.Table], pa.Table]:
    """Per chunk of segments: its distinct windows, with the smallest and the largest id they stand in."""
    def run(table: pa.Table) -> pa.Table:
        keys, counts = _window_keys(table.column("content").to_pylist(), kind)
        ids = np.repeat(table.column("smallest").to_numpy(), counts)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        keys, ids = keys[order], ids[order]
        head = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
        return pa.table({"one": keys[head, 0], "two": keys[head, 1],
                         "chunk": pa.array([table.column("chunk")[0].as_py()] * len(head), pa.int64()),
                         "low": np.minimum.reduceat(ids, head), "high": np.maximum.reduceat(ids, head)})
    return run


def _window_answers(kind: Windows) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Per chunk of segments: its answers, from the smallest ids of those windows that a smaller document holds too."""
    def run(table: pa.Table, met: pa.Table) -> pa.Table:
        keys, counts = _window_keys(table.column("content").to_pylist(), kind)
        own = table.column("smallest").to_numpy()
        least = np.repeat(own, counts)
        order = np.argsort(met.column("one").to_numpy(), kind="stable")
        one, two, first = (met.column(c).to_numpy()[order] for c in ("one", "two", "first_id"))
        at, open_ = np.searchsorted(one, keys[:, 0]), np.arange(len(keys))
        # Windows alike in the first half of the key stand side by side; nearly always there is one.
        while len(open_ := open_[at[open_] < len(one)]) and len(open_ := open_[one[at[open_]] == keys[open_, 0]]):
            same = open_[two[at[open_]] == keys[open_, 1]]
            least[same] = np.minimum(least[same], first[at[same]])
            at[open_] += 1
        cuts = np.cumsum(counts)[:-1]
        blobs = [_edges(part) for part in np.split(least < np.repeat(own, counts), cuts)] if len(own) else []
        return pa.table({"sid": table.column("sid").cast(pa.binary()), "first_id": pa.array(own, pa.int64()),
                         "edges": pa.array(blobs, pa.binary())})
    return run


@dataclass
class _Plan:
    groups: int
    buckets: int

    @property
    def shift(self) -> int:
        return 32 - (self.buckets.bit_length() - 1)

    @classmethod
    def of(cls, docs: DataFrame) -> _Plan:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = docs.sparkSession._jsparkSession.sessionState().conf().numShufflePartitions()
        return cls(_aligned(max(4, -(-total // GROUP_BYTES)), partitions), 1 << max(2, (total // BUCKET_BYTES).bit_length()))


def _aligned(groups: int, partitions: int) -> int:
    """At least ``groups``, and a multiple or a divisor of the shuffle partitions unless that is far more."""
    if groups > partitions:
        return partitions * -(-groups // partitions)
    divisor = next(n for n in range(groups, partitions + 1) if partitions % n == 0)
    return divisor if divisor <= 8 * groups else groups


#: Two hashes name a text; one of 64 bits could be shared by chance among billions.
def text_keys(prefix: str = "") -> list:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias(f"{prefix}key"), F.xxhash64(F.lit(7), text).alias(f"{prefix}check")]


def distinct_texts(docs: DataFrame, stages: Stages, plan: _Plan) -> DataFrame:
    """Each distinct text once with its smallest id, written to buckets of groups.

    Groups are dealt by the hash that deals texts to shuffle partitions, so a partition holds whole groups, or a group whole
    partitions. Dealt by another hash, every task would write a file of every group, tiny ones in a large corpus.
    """
    spark = docs.sparkSession
    texts = (docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("id"))
                 .groupBy("text").agg(F.min(F.coalesce("id", F.lit(NO_ID))).alias("smallest")))
    key, check = text_keys()
    texts = texts.select("text", "smallest", key, check, F.pmod(F.hash("text"), F.lit(plan.groups)).cast("int").alias("grp"))
    name = f"texts_{uuid4().hex}"
    (texts.write.bucketBy(plan.groups, "grp").option("compression", "zstd")
          .option("path", f"{stages.folder}/texts").saveAsTable(name))
    return spark.table(name)


def _crowded(distinct: DataFrame, stages: Stages, kind: Windows, limit: int) -> DataFrame:
    """Answers for segments of routes that are too large for a shard, window by window.

    A chunk is of one route, so the windows that its segments share are one row of the chunk.
    """
    part = F.pmod(F.xxhash64("sid"), F.ceil(F.col("n") / F.lit(limit)))
    dealt = stages.keep(distinct.select(F.xxhash64("route", part).alias("chunk"), "sid", "content", "smallest"))
    windows = stages.keep(dealt.groupBy("chunk").applyInArrow(
        _window_rows(kind), "one long, two long, chunk long, low long, high long"))
    met = (windows.groupBy("one", "two").agg(F.min("low").alias("first_id"), F.max("high").alias("last_id"))
                  .filter(F.col("first_id") < F.col("last_id")).drop("last_id"))
    back = windows.join(met, ["one", "two"]).filter(F.col("first_id") < F.col("high")).select("chunk", "one", "two", "first_id")
    answers = stages.keep(dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_window_answers(kind), _ANSWER))
    stages.drop(dealt, windows)
    return answers


def verdicts(table: DataFrame, stages: Stages, plan: _Plan, kind: Windows, shard: Shard, limit: int) -> DataFrame:
    """(grp, key, edges): for texts with repeated windows, blobs of (from, to) window positions to remove."""
    anchors = table.select("grp", "key", "text").groupBy("grp").applyInArrow(
        _anchor_rows(kind, plan.shift), "bucket long, grp int, blob binary")
    shared = anchors.groupBy("bucket").applyInArrow(_shared_rows, "grp int, bucket long, blob binary")
    segments = stages.keep(table.select("grp", "key", "smallest", "text").groupBy("grp").cogroup(shared.groupBy("grp"))
                                .applyInArrow(_segment_rows(kind, plan.shift), _SEGMENT))
    sent = segments.filter(F.col("content").isNotNull()).select("route", "sid", "content", F.col("least").alias("smallest"))
    size = F.octet_length("content")
    sizes = sent.groupBy("sid").agg(F.min("route").alias("route"), F.max(size).alias("n"), F.sum(size).alias("sent"))
    heavy = stages.keep(sizes.groupBy("route").agg(F.sum("n").alias("n"), F.sum("sent").alias("sent"))
                             .filter(F.col("sent") > limit).select("route", "n"))

    def distinct(routes: DataFrame) -> DataFrame:
        return (sent.join(F.broadcast(routes), "route", "left_semi")
                    .groupBy("sid").agg(F.min("route").alias("route"), F.max("content").alias("content"),
                                        F.min("smallest").alias("smallest"))
                    .select("route", "sid", "content", "smallest"))

    large = heavy.filter(F.col("n") > limit)
    crowded = _crowded(distinct(large).join(F.broadcast(large), "route"), stages, kind, limit)
    # Groups merge what they send; only what many of them send again and again is merged before it goes to its shard.
    light = sent.join(F.broadcast(heavy), "route", "left_anti").unionByName(distinct(heavy.filter(F.col("n") <= limit)))
    answers = stages.keep(light.repartition("route").sortWithinPartitions("route", "sid")
                               .mapInArrow(_shard_batches(kind, shard, limit), _ANSWER))
    found = segments.select("sid", "grp", "key", "smallest", "at", "windows").join(answers.unionByName(crowded), "sid")
    found = stages.keep(found.filter((F.col("smallest") > F.col("first_id")) | (F.octet_length("edges") > 0))
                             .select("grp", "key", "at", "windows", (F.col("smallest") > F.col("first_id")).alias("whole"), "edges"))
    stages.drop(segments, answers, crowded)
    return found


def _removed(n: int, size: int, rows: list[tuple[int, int, bool, bytes]]) -> np.ndarray:
    """Which of ``n`` symbols are covered by the windows that rows remove."""
    change = np.zeros(n + 1, np.int64)
    for at, windows, whole, edges in rows:
        spans = [(0, windows)] if whole else np.frombuffer(edges, np.int32).reshape(-1, 2).tolist()
        for start, end in spans:
            change[at + start] += 1
            change[at + end + size - 1] -= 1
    return np.cumsum(change[:-1]) > 0


def _result_rows(kind: Windows, with_text: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        by_key: dict[int, list] = {}
        for key, *rest in zip(*(found.column(c).to_pylist() for c in ("key", "at", "windows", "whole", "edges")), strict=True):
            by_key.setdefault(key, []).append(rest)
        out = {name: [] for name in ("n", "n_removed", "n_spans", "kept_sha256", "kept")}
        use = []
        texts = table.column("text").cast(pa.large_binary()) if len(table) else []
        for index, (key, text) in enumerate(zip(table.column("key").to_pylist(), texts, strict=True)):
            rows = by_key.get(key)
            if with_text and not rows:
                continue
            raw = text.as_py()
            symbols = raw.split() if kind.words else np.frombuffer(raw, np.uint8)
            gone = _removed(len(symbols), kind.size, rows or [])
            removed = int(gone.sum())
            if kind.words:
                kept = b" ".join([w for w, g in zip(symbols, gone.tolist(), strict=True) if not g] if removed else symbols)
            else:
                kept = symbols[~gone].tobytes() if removed else raw
            use.append(index)
            out["n"].append(len(symbols))
            out["n_removed"].append(removed)
            out["n_spans"].append(int(np.count_nonzero(gone & ~np.concatenate(([False], gone[:-1])))) if removed else 0)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept if with_text else None)
        base = table.select(["key", "check", "smallest"]).take(pa.array(use, pa.int64()))
        kinds = {"n": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}
        for name, column in out.items():
            base = base.append_column(name, pa.array(column, kinds[name]))
        return base
    return run


_RESULT = "key long, check long, smallest long, n long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def repeats(docs: DataFrame, kind: Windows, shard: Shard, limit: int, with_text: bool = False) -> DataFrame:
    """Per distinct text: its symbols, what is removed, and a digest (or the bytes) of what is kept.

    ``with_text`` returns the changed texts only, with their bytes.
    """
    stages, plan = Stages(docs.sparkSession), _Plan.of(docs)
    with shuffles_end_with_jobs(docs.sparkSession):
        table = distinct_texts(docs, stages, plan)
        found = verdicts(table, stages, plan, kind, shard, limit)
    return (table.select("grp", "key", "check", "smallest", "text").groupBy("grp").cogroup(found.groupBy("grp"))
                 .applyInArrow(_result_rows(kind, with_text), _RESULT))


_NOTHING = hashlib.sha256(b"").hexdigest()


def digests(docs: DataFrame, kind: Windows, shard: Shard, limit: int) -> DataFrame:
    """doc_id, n, n_removed, n_spans, kept_sha256 of every row.

    A copy of a text with a smaller id goes whole if it has a window; one that is shorter stays.
    """
    done = repeats(docs, kind, shard, limit).drop("kept")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys())
    copy = (F.coalesce("doc_id", F.lit(NO_ID)) > F.col("smallest")) & (F.col("n") >= kind.size)
    return rows.join(done, ["key", "check"]).select(
        "doc_id", "n", F.when(copy, F.col("n")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.lit(_NOTHING)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))
