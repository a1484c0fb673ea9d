"""Registered queries against their SQL on the smallest tables; `python tests/compare.py` runs all of them."""

import os

import pytest
from compare import connect, difference, duck_rows, spark_rows

import __spark_entry__ as entry
from pyrewatch.plans import load_queries

SMALL = "/root/testdata/sf0.001"
CHOSEN = [
    "accepted_logs", "accepted_metrics", "anomaly_windows", "canonical_references", "corpus_checks", "evidence_items", "evidence_packs",
    "grounding_violations", "incident_contexts", "incident_signals", "log_row_checks", "long_series_detector",
    "nearest_to_label_centers", "note_chunks", "observation_scores", "query_texts", "sequential_detector", "similar_documents",
    "file_manifest", "incident_files", "log_files", "metric_files", "note_files", "postmortem_reads", "postmortem_texts",
    "replaced_collection", "scenario_checks", "template_similarity", "timeline_summary", "window_links",
]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    return connect(SMALL)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_its_sql(spark, duck, name):
    query = load_queries()[name]
    assert difference(spark_rows(query.run(spark, SMALL)), duck_rows(duck, query.sql)) is None


def test_notes_are_many_files_of_lines(spark, tmp_path):
    """Tasks write their own files and no file is a value: eight tasks make more files than there are names."""
    texts = ["a\rb", "", "x\n", "two\nlines", "é"]
    rows = [(i, texts[i % len(texts)]) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", 128 << 20)
    try:
        found = load_queries()["note_files"].run(spark, str(tmp_path))
        assert len(found.inputFiles()) > 4
        names = ["database.md", "memory.md", "networking.md", "troubleshooting.md"]
        want = {}
        for i, text in rows:
            characters, lines = want.get(names[i % 4], (-1, 0))
            want[names[i % 4]] = (characters + len(text) + 1, lines + text.count("\n") + 1)
        assert {r["document_name"]: (r["characters"], r["lines"]) for r in found.collect()} == want
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_contract():
    queries, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(queries)
    assert len(queries) > 100


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["incident_id", "window_no"]


def test_every_inventory_row_is_covered():
    covered = {row for q in load_queries().values() for row in q.covers}
    letters = {"A": 20, "B": 17, "C": 12, "D": 42, "E": 15, "F": 9, "G": 11, "H": 8, "I": 8}
    wanted = {f"{k}{i}" for k, n in letters.items() for i in range(1, n + 1)}
    assert wanted <= covered


@pytest.mark.parametrize("name", ["late_stream_points", "streamed_points", "streamed_windows"])
def test_streams_over_several_months(spark, tmp_path, name):
    """Arrivals follow the whole period, so the first days of a second month do not come before the last of the first."""
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    events = spark.read.parquet(f"{SMALL}/events.parquet").selectExpr("*", "explode(array(0, 1)) AS copy").selectExpr(
        "event_id + copy * 1000000 AS event_id", "ts + copy * INTERVAL '31' DAY AS ts", "user_id", "event_type", "value", "props")
    events.coalesce(1).write.parquet(f"{tmp_path}/part")
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "events.parquet")
    query = load_queries()[name]
    found = spark_rows(query.run(spark, str(tmp_path)))
    assert found[2] and difference(found, duck_rows(connect(str(tmp_path)), query.sql)) is None


def test_cards_do_not_store_whole_reports(spark, monkeypatch):
    """A card reads two lists of a report once, so no report is written."""
    from pyrewatch.plans import grounded

    def refuse(_):
        raise AssertionError("reports were stored")
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    run = load_queries()["evidence_cards"].run
    monkeypatch.setattr(grounded, "cut_lineage", refuse)
    run(spark, SMALL)
