"""Packing token sequences by Karmarkar-Karp multiway differencing.

1. One pass over the texts tokenizes them and cuts each document into full windows and a rest in pieces of at most
   ``PIECE`` ids. A row per piece leaves that pass; ids never travel.
2. Pieces are dealt by hash to groups of about ``GROUP_WINDOWS`` windows. Equal pieces are counted first and their
   copies dealt in turn to the groups from there on, so that repeated rows spread.
3. A group is partitioned into windows by differencing: each piece starts as a partition of its own with one loaded
   window; the two partitions of largest imbalance are merged, the heaviest windows of one with the lightest of the
   other, until one is left with nearly equal windows. If a window exceeds the capacity, the count of windows rises by
   one and the group is partitioned anew. Full windows stand alone.

Defined results: null or empty text is the end id alone; rows with equal ids are packed each for itself; a null id is
kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
PIECE = 1024
END = 2
#: Pieces of a group: each is an item of differencing, however short it is.
GROUP_PIECES = 1 << 14
GROUP_WINDOWS = 128
TOKENIZER = "word_bpe_49k.json"

#: Entries of the word and chunk caches of a worker. A full cache is emptied.
CACHED_WORDS = 1_000_000
CACHED_CHUNKS = 400_000

_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: Python counts these controls as white space, the tokenizer's pattern does not; and markers of special tokens.
_WHOLE = re.compile("[\x1c-\x1f]|<\\|")
#: Letters below this point lower-case alike everywhere and never combine.
_PLAIN = "İ"


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next free code point."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(free)
            free += 1
    return [out[b] for b in range(256)]


class WordTokenizer:
    """Ids of texts as little-endian 32-bit bytes, from caches of words and of chunks between white space.

    A token never spans white space, so a text's ids are those of its chunks in a row. Chunks of plain letters are
    lower-cased and split as the tokenizer does; others go through the tokenizer itself.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._letters = _byte_letters()
        self._pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self._words: dict[str, bytes] = {}
        self._chunks = _Chunks(self)

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        found = self._words.get(word)
        if found is None:
            if len(self._words) >= CACHED_WORDS:
                self._words.clear()
            spelled = word if word.isascii() else "".join([self._letters[b] for b in word.encode()])
            tokens = self._model.tokenize(spelled)
            found = self._words[word] = _pack(len(tokens))(*[t.id for t in tokens])
        return found

    def chunk(self, chunk: str) -> bytes:
        if max(chunk) < _PLAIN:
            if chunk.isalpha():
                return self._word(chunk.lower())
            if chunk[-1] in ".,!" and chunk[:-1].isalpha():
                return self._word(chunk[:-1].lower()) + self._word(chunk[-1])
        if chunk.isascii():
            if not chunk.isprintable():
                return self._whole(chunk)
            words = _ASCII_WORDS.findall(chunk.lower())
        elif max(chunk) < _PLAIN:
            words = self._pattern.findall(chunk.lower())
        else:
            return self._whole(chunk)
        return b"".join([self._word(w) for w in words])

    def ids(self, text: str) -> bytes:
        if _WHOLE.search(text):
            return self._whole(text)
        return b"".join(map(self._chunks.__getitem__, text.split()))


@lru_cache(maxsize=None)
def _pack(n: int):
    return struct.Struct(f"<{n}I").pack


class _Chunks(dict):
    def __init__(self, owner: WordTokenizer):
        super().__init__()
        self._owner = owner

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHED_CHUNKS:
            self.clear()
        found = self[chunk] = self._owner.chunk(chunk)
        return found


@lru_cache(maxsize=1)
def word_tokenizer(name: str) -> WordTokenizer:
    """``name`` is a path, or the name of a public tokenizer's file."""
    if not os.path.isabs(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    return WordTokenizer(str(name))


def cuts(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: full windows, then pieces of at most ``piece``."""
    full = n // capacity * capacity
    return ([(at, capacity) for at in range(0, full, capacity)]
            + [(at, min(piece, n - at)) for at in range(full, n, piece)])


_END_BYTES = np.array([END], "<u4").tobytes()


def _piece_batches(name: str, capacity: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(name)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokenizer.ids(text.as_py() or "") + _END_BYTES
                total = len(ids) // 4
                for start, length in cuts(total, capacity, piece):
                    row = (doc_id, start, length, zlib.crc32(ids[4 * start: 4 * (start + length)]), total)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return run


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, piece: int = PIECE) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _piece_batches(tokenizer, capacity, piece), _PIECE)


def difference(sizes: list[int], windows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Partition items into ``windows`` by differencing.

    Returns the sums in falling order, the first item of each window (-1: none), and each item's successor in its window.
    """
    n = len(sizes)
    after = np.full(n, -1, np.int64)
    heap = []
    for item, size in enumerate(sizes):
        sums, first = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], first[0] = size, item
        heap.append((-size if windows > 1 else 0, item, sums, first, first))
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        _, _, sums, first, last = heapq.heappop(heap)
        _, _, other, other_first, other_last = heapq.heappop(heap)
        # Heaviest with lightest: the other partition is turned around.
        other_first, other_last = other_first[::-1], other_last[::-1]
        joined = (first >= 0) & (other_first >= 0)
        after[last[joined]] = other_first[joined]
        sums = sums + other[::-1]
        first, last = np.where(first >= 0, first, other_first), np.where(other_first >= 0, other_last, last)
        order = (-sums).argsort(kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), made, sums, first[order], last[order]))
        made += 1
    _, _, sums, first, _ = heap[0]
    return sums, first, after


def fill_windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Items of each window, no window over ``capacity``, with as few windows as differencing finds from the least."""
    if not sizes:
        return []
    if max(sizes) > capacity:
        raise ValueError("an item exceeds the capacity")
    windows = -(-sum(sizes) // capacity)
    while True:
        sums, first, after = difference(sizes, windows)
        if sums[0] <= capacity:
            break
        windows += 1
    out = []
    for item in first.tolist():
        window = []
        while item >= 0:
            window.append(item)
            item = int(after[item])
        if window:
            out.append(window)
    return out


def _window_rows(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.repeat(np.arange(len(table)), table.column("copies").to_numpy())))
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_pylist()
        group = table.column("grp")[0].as_py() if len(table) else 0
        full = sum(1 for n in lengths if n == capacity)
        windows = [[i] for i in range(full)] + [[full + i for i in w] for w in fill_windows(lengths[full:], capacity)]
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for number, window in enumerate(windows):
            at = 0
            for item in window:
                sequence[item], offset[item] = (group << 32) + number, at
                at += lengths[item]
        table = table.drop_columns(["grp", "copies"])
        return table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
    return run


def pack(docs: DataFrame, stages, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, piece: int = PIECE,
         group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """The contract's rows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = stages.keep(pieces(docs, tokenizer, capacity, piece))
    total, count = rows.filter(F.col("length") < capacity).agg(F.sum("length"), F.count(F.lit(1))).first()
    groups = max(1, round((total or 0) / (group_windows * capacity)), -(-count // GROUP_PIECES))
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    turn = F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", F.lit(groups)) - 1)).alias("turn")
    home = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(groups))
    dealt = counted.select("*", turn).select(
        *rows.columns, F.pmod(home + F.col("turn"), F.lit(groups)).alias("grp"),
        (F.floor((F.col("n") - 1 - F.col("turn")) / F.lit(groups)) + 1).alias("copies"))
    return dealt.groupBy("grp").applyInArrow(_window_rows(capacity), _PIECE + ", sequence_id long, offset long")
