"""Removal of repeated byte strings by a suffix array of each shard.

Each byte covered by a 50-byte string that also starts in a document with a smaller id is removed; strings are judged on
the input. ``repeats`` routes the candidate strings; a shard here concatenates its segments, builds their suffix array
by induced sorting and the common prefixes of neighbours, and finds the smallest id of each run of suffixes that share
50 bytes.

Defined results: null text is empty; texts under 50 bytes, equal ids and repeated rows remove nothing from each other;
a null id counts as larger than any; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyrewatch.llm.repeats import Segment, Windows, digests
from pyrewatch.llm.suffixes import common_prefixes, suffix_array

BYTES = Windows(words=False, size=50, gram=20, cut=1024)
#: Bytes of a shard. A worker holds some fifty times as much while it sorts.
SHARD_BYTES = 2 << 20
#: Stands between segments; no UTF-8 text holds it.
SEPARATOR = 0xFF


def smallest_ids(segments: list[Segment], kind: Windows) -> list[np.ndarray]:
    """For every window of every segment, the smallest id among all segments that hold the same bytes."""
    lengths = np.array([len(s.content) for s in segments], np.int64)
    text = np.frombuffer(b"".join(s.content + bytes([SEPARATOR]) for s in segments), np.uint8)
    begins = np.cumsum(lengths + 1) - lengths - 1
    array = suffix_array(text, 256)
    shared = common_prefixes(text, array, 256)
    owner = np.repeat(np.arange(len(segments), dtype=np.int32), lengths + 1)
    left = (begins + lengths)[owner] - np.arange(len(text))
    whole = left[array] >= kind.size
    order, joined = array[whole], np.empty(int(whole.sum()), bool)
    # A suffix too short to hold a window never stands between two that share one.
    joined[:] = shared[whole] >= kind.size
    heads = np.flatnonzero(~joined)
    ids = np.array([s.smallest for s in segments], np.int64)[owner[order]]
    least = np.repeat(np.minimum.reduceat(ids, heads), np.diff(heads, append=len(ids))) if len(ids) else ids
    found = np.empty(len(text), np.int64)
    found[order] = least
    return [found[b: b + max(0, n - kind.size + 1)] for b, n in zip(begins.tolist(), lengths.tolist(), strict=True)]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return digests(docs, BYTES, smallest_ids, SHARD_BYTES).withColumnRenamed("n", "n_bytes")
