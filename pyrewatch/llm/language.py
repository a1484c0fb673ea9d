"""Language identification by sparse multinomial logistic regression over character n-grams.

A text's characters (letters lower-cased, everything else a gap) give hashed n-grams of one to three characters,
weighted by relative frequency and inverse document frequency. The model is trained with follow-the-regularised-leader
and an elastic net on a bounded sample, ``PER_LANGUAGE`` texts of each language at most, chosen by a hash of the id;
document frequencies and language counts cover all training texts. A part of the sample held back from the fit sets
the temperature of the scores.

Defined results: a null text, and one without a letter, is ``und`` with score 0; without any labelled text everything
is; repeated rows each get a row; a null id is never held out and never trains; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyrewatch.llm.arrays import U64, Texts, mix, text_slices
from pyrewatch.llm.ftrl import Rows, Settings, fit, softmax
from pyrewatch.llm.quality import held_out

ORDERS = (1, 2, 3)
BITS = 13
WIDTH = len(ORDERS) << BITS
PER_LANGUAGE = 2500
UNKNOWN = "und"
#: Gains of the frequencies, so that coordinates are of a size that the rates suit.
GAIN = 40.0


def _lower() -> np.ndarray:
    """Lower-cased ASCII letters; other ASCII becomes a gap (0); bytes of longer characters stay."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 0
    table[ord("a"): ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    table[ord("A"): ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return table


_LOWER = _lower()


def characters(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """One code per character, and the bounds of each document. Capitals of Latin-1 are lower-cased."""
    data = texts.data
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    codes = _LOWER[data[starts]].astype(np.uint32)
    wide = np.flatnonzero(data[starts] >= 0x80)
    if len(wide):
        at = starts[wide]
        padded = np.concatenate((data, np.zeros(4, np.uint8)))
        second = padded[at + 1].astype(np.uint32)
        capital = (data[at] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        code = codes[wide] | (second + np.where(capital, 0x20, 0).astype(np.uint32)) << 8
        for k in (2, 3):
            more = data[at] >= (0xE0, 0xF0)[k - 2]
            code[more] |= padded[at[more] + k].astype(np.uint32) << (8 * k)
        codes[wide] = code
    return codes, np.searchsorted(starts, texts.bounds)


def grams(codes: np.ndarray, bounds: np.ndarray):
    """For each order: the hashed n-gram at every character, and whether it lies in one document and is not all gaps."""
    n = len(codes)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    value = np.zeros(n, U64)
    for order in range(1, max(ORDERS) + 1):
        if n < order:
            return
        value = value[: n - order + 1] * U64(0x9E3779B97F4A7C15) + codes[order - 1:].astype(U64) + U64(1)
        if order in ORDERS:
            number = ORDERS.index(order)
            index = (mix(value) >> U64(64 - BITS)).astype(np.int64) + (number << BITS)
            inside = np.arange(len(value)) + order <= ends[: len(value)]
            inside &= (codes[: len(value)] > 0) | (codes[order - 1:] > 0)
            yield index, inside


def has_letter(raw: bytes) -> bool:
    return any(map(str.isalpha, raw.decode("utf-8", "replace")))


def lettered(texts: Texts, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each document holds a letter; only those without a plain one are looked at closely."""
    plain = np.concatenate(([0], np.cumsum((codes > 0) & (codes < 0x80))))
    out = plain[bounds[1:]] > plain[bounds[:-1]]
    for i in np.flatnonzero(~out).tolist():
        out[i] = has_letter(texts.raw(i))
    return out


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray
    """Weight times inverse document frequency times gain, per n-gram and language."""
    bias: np.ndarray
    temperature: float

    def chances(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated chances of each document, and whether it holds a letter."""
        codes, bounds = characters(texts)
        n = len(bounds) - 1
        owner = np.repeat(np.arange(n), np.diff(bounds))
        sums, counts = np.zeros((n, len(self.languages))), np.zeros(n)
        for index, inside in grams(codes, bounds):
            here = owner[: len(index)]
            counts += np.bincount(here[inside], minlength=n)
            gathered = self.table[index]
            gathered[~inside] = 0
            prefix = np.zeros((len(index) + 1, gathered.shape[1]))
            np.cumsum(gathered, axis=0, out=prefix[1:])
            at = np.minimum(bounds, len(index))
            sums += prefix[at[1:]] - prefix[at[:-1]]
        scores = sums / np.maximum(counts, 1)[:, None] + self.bias
        return softmax(scores / self.temperature), lettered(texts, codes, bounds)


def _frequency_batches(batches):
    """How many documents hold each n-gram: one set of rows per task. Index -1 counts documents."""
    seen, total = np.zeros(WIDTH, np.int64), 0
    for batch in batches:
        for texts in text_slices(batch.column(0)):
            codes, bounds = characters(texts)
            found = list(grams(codes, bounds))
            flag = np.zeros(WIDTH, bool)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                for index, inside in found:
                    own = index[a:b]
                    flag[own[inside[a:b]]] = True
                seen += flag
                flag[:] = False
            total += len(texts)
    index = np.concatenate(([-1], np.flatnonzero(seen)))
    yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(np.concatenate(([total], seen[index[1:]])))], ["gram", "n"])


def _row_batches(batches):
    """Sparse frequencies of the sample: n-gram numbers as 16 bits, frequencies as 32-bit floats."""
    for batch in batches:
        out = [[], [], []]
        for texts in text_slices(batch.column(1)):
            codes, bounds = characters(texts)
            found = list(grams(codes, bounds))
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                own = np.concatenate([index[a:b][inside[a:b]] for index, inside in found] or [np.zeros(0, np.int64)])
                index, count = np.unique(own, return_counts=True)
                out[0].append(batch.column(0)[texts.first + i].as_py())
                out[1].append(index.astype("<u2").tobytes())
                out[2].append((count / max(1, len(own))).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())],
                                         ["lang", "index", "value"])


def _temperature(scores: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of smallest log loss, by golden section over its logarithm."""
    def loss(log_t: float) -> float:
        return -np.log(softmax(scores / np.exp(log_t))[np.arange(len(truth)), truth] + 1e-12).mean()

    if not len(truth):
        return 1.0
    low, high, ratio = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(known: DataFrame, per_language: int = PER_LANGUAGE, settings: Settings = Settings(l1=1e-4, l2=1e-4, rate=0.3)) -> Model | None:
    """Fit on rows (doc_id, text, lang), all of which may be learned from."""
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    frequency = known.select("text").mapInArrow(_frequency_batches, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    seen = {r["gram"]: r["n"] for r in frequency.collect()}
    total = seen.pop(-1, 0)
    idf = np.full(WIDTH, np.log(1 + total))
    for gram, n in seen.items():
        idf[gram] = np.log((1 + total) / (1 + n)) + 0.1
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30))
    share = None
    for language, n in sorted(counts.items()):
        bound = int((1 << 30) * min(1.0, per_language / n))
        share = F.when(F.col("lang") == language, F.lit(bound)) if share is None else share.when(F.col("lang") == language, F.lit(bound))
    sample = known.filter(draw < share).select("lang", "text").mapInArrow(_row_batches, "lang string, index binary, value binary").toArrow()
    order = np.lexsort((np.array(sample.column("index").to_pylist(), object), np.array(sample.column("lang").to_pylist(), object)))
    sample = sample.take(pa.array(order))
    languages = tuple(sorted(counts))
    truth = np.array([languages.index(name) for name in sample.column("lang").to_pylist()], np.int64)
    index = [np.frombuffer(b, "<u2").astype(np.int32) for b in sample.column("index").to_pylist()]
    bounds = np.concatenate(([0], np.cumsum([len(i) for i in index]))).astype(np.int64)
    index = np.concatenate(index) if index else np.zeros(0, np.int32)
    value = np.frombuffer(b"".join(sample.column("value").to_pylist()), "<f4")
    rows = Rows(bounds, index, value * idf[index].astype(np.float32) * np.float32(GAIN))
    back = np.arange(len(truth)) % 5 == 4
    targets = np.eye(len(languages))[truth]
    if len(languages) == 1:
        return Model(languages, np.zeros((WIDTH, 1), np.float32), np.zeros(1), 1.0)
    weights, bias = fit(rows.take(np.flatnonzero(~back)), targets[~back], WIDTH, settings)
    warm = _temperature(rows.take(np.flatnonzero(back)).scores(weights, bias), truth[back])
    return Model(languages, (weights * idf[:, None] * GAIN).astype(np.float32), bias, warm)


def _predict_batches(model: Model | None):
    def run(batches):
        for batch in batches:
            names, scores = [], []
            for texts in text_slices(batch.column(1)):
                if model is None:
                    names += [UNKNOWN] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                chances, letters = model.chances(texts)
                best = chances.argmax(axis=1)
                names += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                scores += np.where(letters, chances.max(axis=1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             ["doc_id", "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _predict_batches(model), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, held_out, lang_pred, score; learned from rows that are not held out."""
    out = held_out(3, 1)
    model = train(docs.filter(~out & F.col("doc_id").isNotNull()))
    return predict(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")
