"""Shape of a text as a fixed set of binned measures, each one an index into a table of weights.

Measured over the whole text: shares of byte classes, repeated, shouted and decorated words, word length, and size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from pyrewatch.llm.arrays import Texts, Words, text_slices, words_of

_UPPER, _LOWER, _DIGIT, _SPACE, _LINE, _SHOUT, _BAR, _SYMBOL, _MARK, _WIDE, _OTHER = range(11)


def _classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    for kind, letters in ((_SYMBOL, "#$%&*@^~_=+<>/\\`{}[]"), (_MARK, ".,;:?'\"()-"), (_SPACE, " \t\x0b\x0c\r"),
                          (_LINE, "\n"), (_SHOUT, "!"), (_BAR, "|")):
        table[[ord(c) for c in letters]] = kind
    table[ord("A"): ord("Z") + 1] = _UPPER
    table[ord("a"): ord("z") + 1] = _LOWER
    table[ord("0"): ord("9") + 1] = _DIGIT
    table[128:] = _WIDE
    return table


CLASSES = _classes()
N_CLASSES = 11
#: Upper edges of the bins of a share, and bins per measure.
SHARE_EDGES = np.array([0, .001, .003, .01, .02, .04, .07, .12, .2, .3, .45, .6, .75, .9, .999])
BINS = 16
MEASURES = ("upper", "lower", "digit", "space", "line", "shout", "bar", "symbol", "mark", "wide", "other",
            "repeated words", "distinct words", "shouted words", "decorated words", "single marks", "word length", "words")
WIDTH = BINS * len(MEASURES)


def measures(texts: Texts, words: Words) -> np.ndarray:
    """Bin index of every measure of every document of a slice."""
    n = len(texts)
    lengths = np.diff(texts.bounds)
    kinds = CLASSES[texts.data]
    document = np.repeat(np.arange(n, dtype=np.int32), lengths)
    counts = np.bincount(document * N_CLASSES + kinds, minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    shares = counts / np.maximum(lengths, 1)[:, None]

    owner, n_words = words.document, np.diff(words.bounds)
    per = np.maximum(n_words, 1)

    def within(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(kind)))
        return sums[words.ends] - sums[words.starts]

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(owner[flag], minlength=n) / per

    upper, lower = within(kinds == _UPPER), within(kinds == _LOWER)
    symbols = within((kinds == _SYMBOL) | (kinds == _SHOUT))
    size = words.ends - words.starts
    again = np.zeros(len(owner), bool)
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((words.hashes, owner))
    sorted_hash, sorted_owner = words.hashes[order], owner[order]
    first = np.ones(len(owner), bool)
    first[1:] = (sorted_hash[1:] != sorted_hash[:-1]) | (sorted_owner[1:] != sorted_owner[:-1])
    distinct = np.bincount(sorted_owner[first], minlength=n) / per
    columns = [*shares.T, share(again), distinct, share((upper > 1) & (lower == 0)),
               share((symbols > 0) & (symbols < size)), share((size == 1) & (upper + lower == 0))]
    bins = [np.searchsorted(SHARE_EDGES, column, "left") for column in columns]
    mean = np.bincount(owner, weights=size, minlength=n) / per
    bins.append(np.minimum(mean.astype(np.int64), BINS - 1))
    bins.append(np.minimum(np.log2(n_words + 1).astype(np.int64), BINS - 1))
    return np.stack(bins, axis=1) + np.arange(len(bins)) * BINS


def each_slice(column: pa.Array) -> Iterator[tuple[Texts, Words]]:
    for texts in text_slices(column):
        yield texts, words_of(texts)


def style_of(column: pa.Array) -> np.ndarray:
    """Measures of a whole text column."""
    parts = [measures(texts, words) for texts, words in each_slice(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(MEASURES)), np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
