"""The pipeline, stage by stage against plain versions, and the registered queries."""

import sys
import zlib

import numpy as np
import pytest
from brute import groups, pairs, removals, sort_rows
from conftest import SMALL
from pyspark.sql import functions as F
from test_layout import reference_ids

import __spark_entry__ as entry
import corpus_pipeline
from pyrewatch.llm import decontamination, packing, quality
from pyrewatch.llm.queries import QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages():
    return dict(corpus_pipeline.STAGES)


def test_names_and_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality", "near_duplicates", "repeated_passages", "benchmark_leaks", "packing"]
    found = entry.queries()
    assert sum(any(name.startswith(f"op{n}_") for name in found) for n in range(1, 11)) == 10 and "pipeline" in found
    assert set(QUERIES) <= set(found)


def test_every_stage_on_its_own_input(llm, documents, stages):
    docs = documents.filter("doc_id < 90").cache()
    labels = llm.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.train(docs, labels)
    from pyrewatch.llm.style import style_of
    import pyarrow as pa

    texts = pairs(docs)
    good = model.score(style_of(pa.array([t for _, t in texts]))) >= 0.3
    kept = stages["quality"](llm, docs, SMALL)
    assert kept.columns == COLUMNS
    assert sort_rows(pairs(kept)) == sort_rows([row for row, ok in zip(texts, good.tolist(), strict=True) if ok])

    one = stages["near_duplicates"](llm, docs, SMALL)
    smallest = {c for _, _, c in groups(texts)}
    assert one.columns == COLUMNS
    assert sort_rows(pairs(one)) == sort_rows([row for row in texts if row[0] in smallest])

    cut = stages["repeated_passages"](llm, docs, SMALL)
    want = [(i, " ".join(w for w, g in zip(s, gone, strict=True) if not g) if any(gone) else text)
            for (i, text), (s, gone) in zip(texts, removals(texts, True), strict=True)]
    assert cut.columns == COLUMNS
    assert sort_rows(pairs(cut)) == sort_rows(want)

    clean = stages["benchmark_leaks"](llm, docs, SMALL)
    items = [decontamination.normal(r["text"]) for r in llm.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    patterns = [(decontamination.Pattern(x), decontamination.budget(x)) for x in items if x]
    want = [(i, t) for i, t in texts if all(p.best(decontamination.normal(t))[0] > k for p, k in patterns)]
    assert clean.columns == COLUMNS
    assert sort_rows(pairs(clean)) == sort_rows(want)

    packed = stages["packing"](llm, docs, SMALL).collect()
    want = []
    for doc_id, text in texts:
        ids = [*reference_ids(text), packing.END]
        want += [(doc_id, a, n, zlib.crc32(np.array(ids[a:a + n], "<u4").tobytes()), len(ids)) for a, n in packing.cuts(len(ids))]
    assert sort_rows([(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in packed]) == sort_rows(want)


def test_the_run_is_the_stages_in_a_row(llm, documents, stages):
    docs = documents
    for stage in list(stages.values())[:-1]:
        docs = stage(llm, docs, SMALL)
    rows = corpus_pipeline.run(llm, SMALL).collect()
    want = {i: len(reference_ids(t)) + 1 for i, t in pairs(docs)}
    found = {}
    for r in rows:
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
        assert r["doc_tokens"] == want[r["doc_id"]]
    assert found == want


def test_stages_take_awkward_and_empty_tables(llm, awkward, nothing, stages):
    for name, stage in stages.items():
        for docs in (awkward, nothing):
            out = stage(llm, docs, SMALL)
            assert name == "packing" or out.columns == docs.columns
            assert out.count() <= (10 * awkward.count() if name == "packing" else docs.count())


def test_the_entry_works_without_the_package(tmp_path):
    """The rest of the repository imports where both folders and the pipeline are missing."""
    import os
    import shutil
    import subprocess

    root = os.path.dirname(os.path.abspath(entry.__file__))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op1_') for n in q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True,
                         env={**os.environ, "PYTHONPATH": str(copy)})
    assert out.returncode == 0 and int(out.stdout.split()[-1]) > 100, out.stderr


def test_queries_return_the_contract_columns(llm):
    want = {
        "op1_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
        "op2_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
        "op3_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op4_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op5_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        "op6_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op7_exact_top_k": ["query_id", "rank", "vec_id", "score"],
        "op10_suffix_array_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    }
    for name, columns in want.items():
        assert QUERIES[name](llm, SMALL).columns == columns, name


def test_shards_with_their_sql_twin_for_top_k(llm):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SMALL}/embeddings.parquet')")
    sql = entry.oracle_sql()["op7_exact_top_k"]
    found = QUERIES["op7_exact_top_k"](llm, SMALL).select("query_id", F.col("rank"), "vec_id", "score").collect()
    assert sorted(tuple(r) for r in found) == sorted(con.execute(sql).fetchall())
