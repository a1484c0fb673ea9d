"""Classifiers: held-out accuracy, defined results, and parts against plain versions."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pyrewatch.llm import ftrl, language, quality, toxicity
from pyrewatch.llm.arrays import text_slices
from pyrewatch.llm.style import MEASURES, style_of

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(llm):
    return llm.read.parquet(f"{SF}/documents.parquet"), llm.read.parquet(f"{SF}/labels.parquet")


def left(doc_id, of):
    return zlib.crc32(str(doc_id).encode()) % of


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (left(r["doc_id"], 5) == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([truth[r["doc_id"]] == r["predicted"] for r in held]) > 0.93
    assert np.mean([r["predicted"] for r in held if truth[r["doc_id"]] == 1]) > 0.97


def test_quality_learns_nothing_from_held_out_rows(tables):
    docs, labels = tables
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, turned)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_the_negative_part_of_the_risk_is_not_driven_below_zero():
    """With positives that are all of the unlabelled texts the model does not call them negative."""
    rng = np.random.default_rng(0)
    style = rng.integers(0, 16, (500, len(MEASURES))) + np.arange(len(MEASURES)) * 16
    model = quality.fit(style, style, 0.9)
    assert model.score(style).mean() > 0.8
    assert quality.fit(style[:0], style, 0.9).score(style).tolist() == [0.5] * 500


def test_quality_of_awkward_rows(awkward, nothing, tables, llm):
    labels = llm.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score_documents(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (5, 6)}
    assert len(empty) == 1
    kept = quality.drop_rejected(awkward, labels)
    assert kept.columns == awkward.columns and kept.count() == sum(r["predicted"] for r in rows)
    assert quality.score_documents(nothing, labels).count() == 0
    assert {r["score"] for r in quality.score_documents(awkward, labels.limit(0)).collect()} == {0.5}


def test_style_counts():
    import pyarrow as pa

    found = style_of(pa.array(["ab ab!", None, "AB CD"]))
    bins = {name: (found[:, i] - 16 * i).tolist() for i, name in enumerate(MEASURES)}
    assert bins["words"] == [1, 0, 1] and bins["repeated words"] == [0, 0, 0]
    assert bins["shouted words"][2] > bins["shouted words"][0] == bins["shouted words"][1] == 0
    again = style_of(pa.array(["ha ha ha ha"]))[0, MEASURES.index("repeated words")] - 16 * MEASURES.index("repeated words")
    assert again == np.searchsorted([0, .001, .003, .01, .02, .04, .07, .12, .2, .3, .45, .6, .75, .9, .999], 0.75)


def test_languages_on_held_out_rows(tables):
    docs, _ = tables
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = language.identify(docs).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (left(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in rows if r["held_out"]]) > 0.98


def test_language_of_awkward_rows(awkward, nothing, documents):
    docs = documents.select("doc_id", "text", "lang").union(
        awkward.select(F.col("doc_id") + 10_000, "text", F.lit(None).cast("string")))
    rows = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert all(rows[10_000 + i]["lang_pred"] == "und" for i in (5, 6, 7, 18))
    assert rows[10_013]["lang_pred"] in {"en", "de", "fr", "es"}
    assert language.identify(nothing).count() == 0
    unknown = language.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unknown} == {("und", 0.0)} and len(unknown) == awkward.count()


def test_characters_and_grams():
    import pyarrow as pa

    texts = next(text_slices(pa.array(["Éa1B", "éab", None, "日😀"])))
    codes, bounds = language.characters(texts)
    assert bounds.tolist() == [0, 4, 7, 7, 9]
    assert codes[0] == codes[4] and codes[3] == ord("b") and codes[2] == 0
    assert len(set(codes.tolist())) == 6
    (one, inside), (two, both), _ = language.grams(codes, bounds)
    assert one[0] == one[4] and not inside[2] and two[0] == two[4] and not both[3]


def test_ftrl_separates_and_is_sparse():
    rng = np.random.default_rng(1)
    n, width = 600, 50
    truth = rng.integers(0, 3, n)
    index = np.stack([truth, *(rng.integers(3, width, n) for _ in range(4))], axis=1)
    rows = ftrl.Rows(np.arange(n + 1) * 5, index.ravel(), np.ones(n * 5))
    weights, bias = ftrl.fit(rows, np.eye(3)[truth], width, ftrl.Settings(l1=0.5))
    assert (rows.scores(weights, bias).argmax(axis=1) == truth).mean() > 0.99
    assert (weights[3:] == 0).mean() > 0.5
    assert rows.take(np.array([5, 2])).index.tolist() == [*index[5].tolist(), *index[2].tolist()]


def test_temperature_is_the_best_scale():
    rng = np.random.default_rng(2)
    truth = rng.integers(0, 2, 4000)
    sure = np.where(truth == 1, 1.0, -1.0) + rng.normal(size=4000)
    scores = np.stack([-sure, sure], axis=1)
    fitted = language._temperature(scores * 5, truth)
    assert abs(fitted / (5 * language._temperature(scores, truth)) - 1) < 0.05


def test_toxic_texts_on_held_out_rows(tables):
    docs, labels = tables
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if left(r["doc_id"], 5) == 0 and r["doc_id"] in truth]
    clean = [r["toxic"] for r in held if truth[r["doc_id"]] == 0]
    caught = [r["toxic"] for r in held if truth[r["doc_id"]] == 1]
    assert np.mean(clean) < 0.05
    assert np.mean(caught) > 0.3
    assert all(r["score"] == r["p_toxic"] and r["toxic"] == int(r["score"] >= toxicity.THRESHOLD) for r in rows)


def test_chain_feeds_earlier_chances():
    """The second category is the first one where it is hard to see from the words alone."""
    rng = np.random.default_rng(3)
    n = 1500
    first = rng.integers(0, 2, n)
    index = np.stack([np.where(first == 1, rng.integers(0, 15, n), rng.integers(15, 30, n)), rng.integers(100, 900, n)], axis=1)
    rows = ftrl.Rows(np.arange(n + 1) * 2, index.ravel(), np.ones(2 * n, np.float32))
    chain = toxicity.fit_chain(rows, np.stack([first, first], axis=1), ("a", "b"), ftrl.Settings(smooth=0.1, l1=1e-4))
    chances = chain.chances(rows)
    assert ((chances > 0.5) == (first[:, None] == 1)).mean() > 0.97
    assert np.abs(chain.weights[1][toxicity.width(0):]).sum() > 0


def test_toxicity_of_awkward_rows(awkward, nothing, llm):
    labels = llm.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, None), (4, 1, 0), (8, 1, 0)],
                                 "doc_id long, quality int, toxic int")
    rows = toxicity.score_documents(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_documents(nothing, labels).count() == 0
    assert len(toxicity.score_documents(awkward, labels.limit(0)).collect()) == awkward.count()
