"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another. The first model sees a text's words and beginnings of words (hashed, found
once, twice, four times) and its shape (``style``); every later one also sees the chances of the categories before it. In training these chances are made out
of fold: each row's come from models that did not see the row, so a later model learns from the errors it will meet.

The labels hold two judgements, so the chain is: ``junk`` (quality 0), then ``toxic``, then ``toxic_junk`` (both). Other
label columns can be given. Models are fitted with follow-the-regularised-leader on a bounded sample of about
``LABELLED`` labelled rows chosen by a hash of the id; every document is scored over its whole text.

Defined results: null and empty texts hold no words; repeated rows each get a row; labels with a null id or null
judgement train nothing; a category without both outcomes among the labels has its rate as chance everywhere; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrewatch.llm.arrays import BYTE_CODES, U64, RollingHash, Texts, mix, text_slices, words_of
from pyrewatch.llm.ftrl import Rows, Settings, fit
from pyrewatch.llm.quality import held_out
from pyrewatch.llm.style import WIDTH as STYLE
from pyrewatch.llm.style import measures, sigmoid

LABELLED = 12_000
FOLDS = 4
BITS = 18
#: Bytes of the beginnings of words that count as features beside whole words.
BEGINNINGS = (5, 7)
#: A feature stands for a word or beginning found at least so many times.
TIMES = (1, 2, 4)
#: Bins of an earlier category's chance.
CHANCE_BINS = 16
THRESHOLD = 0.3
#: A word counts if so many sampled texts hold it and its chi-square with the category is as large.
LEAST_SEEN = 5
LEAST_TEST = 20.0


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Hash codes that ignore the case of A-Z, and the bytes that end a word: ASCII without letters."""
    codes, breaks = BYTE_CODES.copy(), np.ones(256, bool)
    codes[ord("A"): ord("Z") + 1] = codes[ord("a"): ord("z") + 1]
    breaks[ord("A"): ord("Z") + 1] = breaks[ord("a"): ord("z") + 1] = False
    breaks[128:] = False
    return codes, breaks


_CODES, _BREAKS = _letters()


@dataclass(frozen=True)
class Chain:
    categories: tuple[str, ...]
    weights: tuple[np.ndarray, ...]
    biases: tuple[float, ...]

    def chances(self, rows: Rows) -> np.ndarray:
        out = np.zeros((len(rows), len(self.categories)))
        for c, (weights, bias) in enumerate(zip(self.weights, self.biases, strict=True)):
            wide = with_chances(rows, out[:, :c])
            out[:, c] = sigmoid(wide.scores(weights[:, None], np.array([bias]))[:, 0])
        return out


def width(earlier: int) -> int:
    return (1 << BITS) + STYLE + earlier * CHANCE_BINS


def with_chances(rows: Rows, chances: np.ndarray) -> Rows:
    """Add to each row one entry per earlier category: the bin of its chance."""
    earlier = chances.shape[1]
    if not earlier:
        return rows
    bins = np.minimum((chances * CHANCE_BINS).astype(np.int64), CHANCE_BINS - 1) + width(0) + np.arange(earlier) * CHANCE_BINS
    lengths = np.diff(rows.bounds)
    bounds = np.concatenate(([0], np.cumsum(lengths + earlier)))
    index = np.empty(bounds[-1], np.int64)
    value = np.ones(bounds[-1], np.float32)
    own = np.arange(len(rows.index)) + np.repeat(np.arange(len(rows)) * earlier, lengths)
    index[own], value[own] = rows.index, rows.value
    index[bounds[1:, None] - earlier + np.arange(earlier)] = bins
    return Rows(bounds, index, value)


def word_features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Document and number of each feature: a word or beginning of a word, and how often at least."""
    words = words_of(texts, _CODES, _BREAKS)
    document, hashes = [words.document], [words.hashes]
    rolling = RollingHash(_CODES[texts.data])
    for size in BEGINNINGS:
        longer = np.flatnonzero(words.ends - words.starts > size)
        document.append(words.document[longer])
        hashes.append(rolling.between(words.starts[longer], words.starts[longer] + size) + U64(size))
    document, hashes = np.concatenate(document), np.concatenate(hashes)
    key = np.sort((document.astype(U64) << U64(40)) | (mix(hashes) >> U64(24)))
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    times = np.diff(head, append=len(key))
    key = key[head]
    found = [((key[times >= t] >> U64(40)).astype(np.int64),
              (mix((key[times >= t] & U64((1 << 40) - 1)) * U64(8) + U64(t)) >> U64(64 - BITS)).astype(np.int64)) for t in TIMES]
    document, number = (np.concatenate(part) for part in zip(*found, strict=True))
    both = np.unique((document << BITS) | number)
    return both >> BITS, both & ((1 << BITS) - 1)


def features(column: pa.Array):
    """Sparse rows of each slice of a text column: words, their beginnings, and shape."""
    for texts in text_slices(column):
        style = measures(texts, words_of(texts))
        document, word = word_features(texts)
        counts = np.bincount(document, minlength=len(texts))
        bounds = np.concatenate(([0], np.cumsum(counts + style.shape[1])))
        index = np.empty(bounds[-1], np.int64)
        index[np.arange(len(word)) + document * style.shape[1]] = word
        index[bounds[1:, None] - style.shape[1] + np.arange(style.shape[1])] = style + (1 << BITS)
        yield Rows(bounds, index, np.ones(len(index), np.float32))


def _row_batches(batches):
    for batch in batches:
        blobs = [rows.index[a:b].astype("<i4").tobytes() for rows in features(batch.column(0))
                 for a, b in zip(rows.bounds[:-1].tolist(), rows.bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), *batch.columns[1:]], batch.schema.names)


def _telling(rows: Rows, truth: np.ndarray) -> Rows:
    """Without the words that are rare or say nothing about the category (a chi-square test of presence)."""
    n, positive = len(truth), float(truth.sum())
    owner = np.repeat(np.arange(n), np.diff(rows.bounds))
    word = rows.index < (1 << BITS)
    seen = np.bincount(rows.index[word], minlength=1 << BITS).astype(float)
    hit = np.bincount(rows.index[word], weights=truth[owner[word]], minlength=1 << BITS)
    spread = seen * (n - seen) * positive * (n - positive)
    test = n * (hit * n - seen * positive) ** 2 / np.maximum(spread, 1e-9)
    use = (seen >= LEAST_SEEN) & (test >= LEAST_TEST)
    keep = ~word | use[np.minimum(rows.index, (1 << BITS) - 1)]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(owner[keep], minlength=n))))
    return Rows(bounds, rows.index[keep], rows.value[keep])


def _fit_one(rows: Rows, truth: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    size = int(max(width(0), rows.index.max(initial=0) + 1))
    if not len(truth) or truth.min() == truth.max():
        rate = min(max(float(truth.mean()) if len(truth) else 0.0, 1e-6), 1 - 1e-6)
        return np.zeros(size), float(np.log(rate / (1 - rate)))
    telling = _telling(rows, truth)
    used, index = np.unique(telling.index, return_inverse=True)
    fitted, bias = fit(Rows(telling.bounds, index, telling.value), truth[:, None].astype(float), len(used), settings)
    weights = np.zeros(size)
    weights[used] = fitted[:, 0]
    return weights, float(bias[0])


def fit_chain(rows: Rows, truth: np.ndarray, categories: tuple[str, ...], settings: Settings) -> Chain:
    """Fit the categories in order; earlier chances are made out of fold."""
    fold = np.arange(len(rows)) % FOLDS
    unseen = np.zeros((len(rows), 0))
    weights, biases = [], []
    for c in range(len(categories)):
        wide = with_chances(rows, unseen)
        w, b = _fit_one(wide, truth[:, c], settings)
        full = np.zeros(width(c))
        full[: min(len(w), len(full))] = w[: len(full)]
        weights.append(full)
        biases.append(b)
        if c + 1 == len(categories):
            break
        own = np.zeros(len(rows))
        for f in range(FOLDS):
            train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if not len(test):
                continue
            w, b = _fit_one(wide.take(train), truth[train, c], settings)
            padded = np.zeros(max(len(w), int(wide.index.max(initial=0)) + 1))
            padded[: len(w)] = w
            own[test] = sigmoid(wide.take(test).scores(padded[:, None], np.array([b]))[:, 0])
        unseen = np.column_stack((unseen, own))
    return Chain(categories, tuple(weights), tuple(biases))


def label_categories() -> dict[str, Column]:
    """The chain's categories from the columns of ``labels``."""
    junk, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return {"junk": junk, "toxic": toxic, "toxic_junk": junk & toxic}


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None,
          settings: Settings = Settings(rate=0.3, smooth=0.1, l1=1e-4, l2=1e-4, epochs=8, batch=64)) -> Chain:
    """Fit on labels of rows that are not held out (crc32 of the id modulo 5 is not 0)."""
    categories = categories or label_categories()
    names = tuple(categories)
    known = labels.select(F.col("doc_id").cast("long"), *[c.cast("int").alias(f"c_{n}") for n, c in categories.items()])
    known = known.filter(~held_out() & F.col("doc_id").isNotNull()).dropna().groupBy("doc_id").agg(
        *[F.max(f"c_{n}").alias(f"c_{n}") for n in names])
    total = known.count()
    if total > LABELLED:
        known = known.filter(F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * LABELLED / total))
    schema = "row binary, doc_id long, " + ", ".join(f"c_{n} int" for n in names)
    found = (docs.select(F.col("text").cast("string").alias("row"), F.col("doc_id").cast("long")).join(known, "doc_id")
                 .select("row", "doc_id", *[f"c_{n}" for n in names]).mapInArrow(_row_batches, schema).toArrow())
    found = found.sort_by([("doc_id", "ascending"), ("row", "ascending")])
    blobs = found.column("row").to_pylist()
    truth = np.column_stack([found.column(f"c_{n}").to_numpy() for n in names]) if blobs else np.zeros((0, len(names)))
    return fit_chain(_common(blobs), truth, names, settings)


def _common(blobs: list[bytes]) -> Rows:
    """The sample's rows without the words that too few of them hold to count in any fit."""
    flat = np.frombuffer(b"".join(blobs), "<i4")
    keep = np.bincount(flat, minlength=width(0))[flat] >= LEAST_SEEN
    keep |= flat >= 1 << BITS
    ends = np.cumsum([len(b) // 4 for b in blobs], dtype=np.int64)
    before = np.concatenate(([0], np.cumsum(keep, dtype=np.int32)))
    flat = flat[keep]
    return Rows(np.concatenate(([0], before[ends])).astype(np.int64), flat, np.ones(len(flat), np.float32))


def _score_batches(chain: Chain):
    def run(batches):
        for batch in batches:
            parts = [chain.chances(rows) for rows in features(batch.column(1))]
            chances = np.concatenate(parts) if parts else np.zeros((0, len(chain.categories)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(column) for column in np.ascontiguousarray(chances.T)]],
                                             ["doc_id", *[f"p_{c}" for c in chain.categories]])
    return run


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, toxic and predicted (both 1 if the score reaches the threshold, else 0), score (chance of toxic) and the
    chance of every category, of every document."""
    chain = train(docs, labels)
    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in chain.categories)
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_score_batches(chain), schema)
    flag = (F.col("p_toxic") >= threshold).cast("int")
    return scored.select("doc_id", flag.alias("toxic"), flag.alias("predicted"), F.col("p_toxic").alias("score"),
                         *[f"p_{c}" for c in chain.categories])
