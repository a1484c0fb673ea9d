"""Flat numpy views of text columns: bytes, words and rolling hashes of many documents at once.

Everything here is vectorised over a slice of documents of bounded size, so the memory of a task does not depend on
how many rows an Arrow batch holds. A document is never cut: a slice holds one document at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 21

#: White space of the contracts: space and the controls 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix finalizer)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        table = np.full(n, base, U64)
        table[0] = 1
        out.append(np.cumprod(table, dtype=U64))
    return out[0], out[1]


class RollingHash:
    """Hashes of any substring of a sequence of 64-bit codes in constant time (polynomial modulo 2**64, scrambled)."""

    def __init__(self, codes: np.ndarray):
        size = 1 << max(22, int(len(codes)).bit_length())
        power, self._inverse = _powers(size)
        self._prefix = np.zeros(len(codes) + 1, U64)
        np.cumsum(codes * power[: len(codes)], out=self._prefix[1:])

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._prefix[ends] - self._prefix[starts]) * self._inverse[starts] + (ends - starts).astype(U64))

    def grams(self, size: int) -> np.ndarray:
        """Hash of every run of ``size`` codes, by its first position."""
        n = len(self._prefix) - size
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self._prefix[size:] - self._prefix[:n]) * self._inverse[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by its first position."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = np.minimum(out[: len(out) - rest], out[rest:])
    return out


@dataclass
class Texts:
    """Some documents laid end to end. ``bounds[i]:bounds[i + 1]`` are the bytes of document ``i``."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.bounds[i]:self.bounds[i + 1]].tobytes()


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The documents of a text column in slices of about ``limit`` bytes; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    blob = column.buffers()[2]
    data = np.frombuffer(blob, np.uint8) if blob is not None and blob.size else np.zeros(0, np.uint8)
    at, n = 0, len(column)
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(n, max(end, at + 1))
        yield Texts(at, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at])
        at = end


@dataclass
class Words:
    """The words of a slice: byte ranges, 64-bit hashes, and ``bounds`` of each document's words."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    @property
    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words_of(texts: Texts, codes: np.ndarray = BYTE_CODES, breaks: np.ndarray = SPACE) -> Words:
    """Runs of bytes outside ``breaks``; ``codes`` gives each byte's part in the hash (equal codes, equal words)."""
    n = len(texts.data)
    solid = ~breaks[texts.data]
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    inner = texts.bounds[(texts.bounds > 0) & (texts.bounds < n)]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    bounds = np.searchsorted(starts, texts.bounds)
    hashes = RollingHash(codes[texts.data]).between(starts, ends) if len(starts) else np.zeros(0, U64)
    return Words(starts, ends, bounds, hashes)
