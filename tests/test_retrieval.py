import math
import random

import numpy as np
import pyarrow as pa
import pytest
from builders import collect, incident, points
from pyspark.sql import functions as F

from pyrewatch.operators import grounding as g, knowledge as kn, packs, retrieval as r
from pyrewatch.operators.quality import label_columns
from pyrewatch.schemas import EVIDENCE, PACK, POSTMORTEM, RESULT


def test_hash_vectors(spark):
    """The SHA-256 of "x" starts 2d 71 16 42 b7 26 b0 44: slots 45, 49, 22, 2 of 64, the first with an odd sign byte."""
    x = [0.0] * 64
    x[45], x[49], x[22], x[2] = -0.5, 0.5, 0.5, 0.5
    # That of "42" starts 73 47 5c b4 0a 56 8e 8d: slots 51, 7, 28, 52, the last one negative.
    both = [0.0] * 64
    for slot, sign in ((45, -1), (49, 1), (22, 1), (2, 1), (51, 1), (7, 1), (28, 1), (52, -1)):
        both[slot] = sign / math.sqrt(8)
    texts = {"once": "x", "case and copies": "X, x! x", "two words": "42 x", "no word": " ... "}
    table = spark.createDataFrame(list(texts.items()), "id string, text string")
    got = {row["id"]: row["vector"] for row in r.hash_vectors(table).collect()}
    assert got == {"once": pytest.approx(x), "case and copies": pytest.approx(x), "two words": pytest.approx(both)}
    assert [row["id"] for row in r.without_vector(table, r.hash_vectors(table)).collect()] == ["no word"]
    with pytest.raises(ValueError):
        r.hash_vectors(table, 4)


def test_top_k_is_exact_for_every_block_size(spark):
    rng = random.Random(5)
    items = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    items += [(100 + i, items[7][1]) for i in range(5)]
    queries = [(f"q{i}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(9)] + [("same", items[7][1])]

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    expected = set()
    for name, q in queries:
        best = sorted((-round(cosine(q, v), 9), i) for i, v in items)[:4]
        expected |= {(name, i, rank + 1) for rank, (_, i) in enumerate(best)}
    left = spark.createDataFrame(queries, "query_id string, vector array<double>")
    right = spark.createDataFrame(items, "id long, vector array<double>")
    for block in (1 << 20, 150):
        got = {(x["query_id"], x["id"], x["rank"]) for x in r.top_k(left, right, 4, block).collect()}
        assert got == expected, block
    assert r.top_k(left, right.limit(2), 3).count() == 2 * len(queries)
    assert r.top_k(left, right.where("false"), 3).count() == 0
    for bad in (0, True, 1.5):
        with pytest.raises(ValueError):
            r.top_k(left, right, bad)


def test_blank_queries_are_left_out(spark):
    table = spark.createDataFrame([("a", "  x "), ("b", " \n ")], "query_id string, text string")
    assert [(x["query_id"], x["text"]) for x in r.usable_queries(table).collect()] == [("a", "x")]


def chunks_of(spark, text, name="note.md"):
    table = spark.createDataFrame([(name, text)], "document_name string, text string")
    return [(x["id"], x["metadata"]["section"], x["text"]) for x in collect(kn.chunk_markdown(table), "position")]


LONG, SHORT = "word " * 60 + "end", "few words"


def test_each_long_section_is_a_chunk(spark):
    text = f"# Pools \r\nintro\r\n## One\r\n{LONG}\r\n## Two \r\n{LONG}\r\n"
    assert chunks_of(spark, text) == [
        ("note_001", "One", f"Document: Pools\nSection: One\n\n{LONG}\n"),
        ("note_002", "Two", f"Document: Pools\nSection: Two\n\n{LONG}\n")]


def test_short_sections_join_the_next_and_a_short_end_the_one_before(spark):
    text = f"## One\n{SHORT}\n## Two\n{LONG}\n## Three\n{LONG}\n## Four\n{SHORT}"
    assert chunks_of(spark, text, "memory.md") == [
        ("memory_001", "One / Two", f"Document: memory\nSection: One / Two\n\n{SHORT}\n\n{LONG}\n"),
        ("memory_002", "Three / Four", f"Document: memory\nSection: Three / Four\n\n{LONG}\n\n{SHORT}\n")]


def test_a_very_long_section_is_cut_between_paragraphs(spark):
    a, b, c = "a" * 1000, "b" * 798, "c" * 300
    assert [(i, s, t.split("\n\n", 1)[1]) for i, s, t in chunks_of(spark, f"## Big\n{a}\n\n{b}\n\n{c}")] == [
        ("note_001", "Big (part 1)", f"{a}\n\n{b}\n"), ("note_002", "Big (part 2)", f"{c}\n")]
    # One character more and the second paragraph no longer fits.
    assert [t.split("\n\n", 1)[1] for _, _, t in chunks_of(spark, f"## Big\n{a}\n\n{b}x\n\n{c}")] == [
        f"{a}\n", f"{b}x\n\n{c}\n"]


def test_a_note_without_sections_has_no_chunk(spark):
    assert chunks_of(spark, "# Title\nonly an introduction") == []


def postmortem(spark, **changes):
    record = {"incident_id": "HIST-001", "title": "Pool ran dry", "occurred_at": "2025-01-01T00:00:00", "service": "api", "severity": "HIGH",
              "duration_minutes": 30, "root_cause": "MEMORY_LEAK", "root_cause_service": None, "environment": "prod", "status": "done",
              "symptoms": ["a", "b"], "observed_signals": [], "timeline": [("+05m", "it broke")], "contributing_factors": ["c"],
              "resolution": ["d"], "lessons_learned": ["e"], "tags": ["t1", "t2"], "affected_services": ["api", "db"], **changes}
    return spark.createDataFrame([tuple(record[f.name] for f in POSTMORTEM.fields)], POSTMORTEM)


def test_postmortem_text_leaves_the_cause_out(spark):
    row = kn.postmortem_documents(postmortem(spark)).first()
    assert row["text"].startswith("Incident HIST-001\nTitle: Pool ran dry\nService: api\n")
    assert "Symptoms:\n- a\n- b\nObserved signals:\nTimeline:\n- +05m: it broke\n" in row["text"]
    assert row["text"].endswith("Tags: t1, t2\n")
    assert "MEMORY_LEAK" not in row["text"]
    assert row["metadata"]["historical_root_cause"] == "MEMORY_LEAK"
    assert "historical_root_cause_service" not in row["metadata"]
    leaking = kn.postmortem_documents(postmortem(spark, title="a MEMORY_LEAK again"))
    assert kn.leaking_documents(leaking).count() == 1


def test_query_text_without_evidence(spark):
    none = spark.createDataFrame([], EVIDENCE)
    text = r.query_texts(incident(spark), points(spark, (1, "x", "cpu_usage", 1, "LOW")).where("false"), none).first()["text"]
    assert text == (
        "payment-api alert (HIGH, about 30 minutes): payment alert. Checkouts fail. No metric anomaly points were observed. "
        "No timeout, connection-wait, memory-pressure, or error events were retained on the observed timeline. "
        "Related observations stayed on payment-api. No anomaly was placed on the timeline before or during the alert.")
    assert r.leaking_queries(spark.createDataFrame([("q", "the scenario"), ("p", "ok")], "query_id string, text string")).count() == 1


def test_series_facts_prefer_the_alerting_service(spark):
    rows = [(m, "payment-api", k, 5, "LOW") for k in ("cpu_usage", "memory_usage", "latency_ms", "error_rate") for m in (1, 2)]
    rows += [(3, "payment-api", "error_rate", 60, "HIGH")]
    rows += [(m, "db", "cpu_usage", 12, "MEDIUM") for m in range(9)] + [(m, "web", "cpu_usage", 5, "LOW") for m in range(9)]
    facts = collect(r.series_facts(points(spark, *rows), incident(spark)), "place")
    assert [(f["service"], f["metric_name"]) for f in facts] == [
        ("payment-api", "error_rate"), ("payment-api", "cpu_usage"), ("payment-api", "latency_ms"), ("db", "cpu_usage")]
    assert {f["own_high"] for f in facts} == {True}
    quiet = [(m, s, "cpu_usage", 5, "LOW") for s in ("a", "b", "c", "d") for m in range(3)]
    assert [f["service"] for f in collect(r.series_facts(points(spark, *quiet), incident(spark)), "place")] == ["a", "b", "c"]


def result(spark, **changes):
    base = {"incident_id": "INC-001", "summary": "s", "root_cause": ("c", 0.5, ["E1"], [], "r"), "confidence": 0.5,
            "alternative_causes": [("d", 0.2, ["E2", "E1"], ["E3"], "r")], "supporting_evidence": [("E1", "LOG", "invented")],
            "contradicting_evidence": [], "timeline": [("E2", "9999", "invented")], "recommended_actions": [("a", "b", ["E1"])],
            "similar_incidents": [("HIST-1", "alike")], **changes}
    return spark.createDataFrame([tuple(base[f.name] for f in RESULT.fields)], RESULT)


def pack(spark, *ids):
    rows = [("INC-001", i, "HISTORICAL_INCIDENT" if i.startswith("HIST") else "LOG", f"text of {i}", "d", "2026") for i in ids]
    return spark.createDataFrame(rows, PACK)


ALL = ("E1", "E2", "E3", "HIST-1")


def violations(spark, report, *ids):
    return {x["violation"] for x in g.grounding_violations(report, pack(spark, *(ids or ALL)), incident(spark)).collect()}


def test_grounded_report_passes(spark):
    assert violations(spark, result(spark)) == set()
    assert g.result_violations(result(spark)).count() == 0


def test_unknown_ids_are_named(spark):
    assert violations(spark, result(spark), "E1", "E3", "HIST-2") == {
        "alternative_causes[0] cites E2", "timeline cites E2", "similar incident HIST-1 was not retrieved"}


def test_uncited_claims(spark):
    bare = result(spark, alternative_causes=[("d", 0.2, [], [], "r")], recommended_actions=[("a", "b", [])], incident_id="INC-009")
    assert {"alternative without support", "action without evidence", "unknown incident"} <= violations(spark, bare)
    calm = result(spark, root_cause=("INSUFFICIENT_EVIDENCE", 0.5, [], [], "r"), recommended_actions=[("a", "b", [])])
    assert "action without evidence" not in violations(spark, calm)


def test_schema_rules(spark):
    bad = result(spark, confidence=1.5, root_cause=("c", 0.4, [], [], "r"), summary="")
    assert {x["violation"] for x in g.result_violations(bad).collect()} == {
        "summary is empty", "score is outside 0..1", "score differs from the root cause's", "stated cause has no support"}


def test_text_comes_from_the_pack(spark):
    found = collect(g.canonical_references(result(spark), pack(spark, *ALL)), "role", "position")
    assert [(x["role"], x["evidence_id"], x["short_description"]) for x in found] == [
        ("contradicting", "E3", "text of E3"), ("supporting", "E1", "text of E1"), ("supporting", "E2", "text of E2"),
        ("timeline", "E2", "text of E2")]
    cards = collect(g.evidence_cards(g.canonical_references(result(spark), pack(spark, *ALL))), "evidence_id")
    assert [(x["evidence_id"], x["role"]) for x in cards] == [("E1", "supporting"), ("E2", "supporting"), ("E3", "contradicting")]


def test_insufficient_result_is_valid(spark):
    empty = g.insufficient_results(incident(spark), pack(spark, "E1").where("false"), "nothing")
    assert empty.schema.fieldNames() == RESULT.names
    assert g.result_violations(empty).count() == 0
    assert label_columns(empty) == []
    assert g.insufficient_results(incident(spark), pack(spark, "E1"), "nothing").count() == 0


def test_pack_clips_and_hides_metadata(spark):
    hits = spark.createDataFrame([("INC-001", 1, "HIST-1", 0.5, "word " * 200, {"historical_root_cause": "X", "date": "2025"})],
                                 "query_id string, rank int, id string, score double, text string, metadata map<string,string>")
    row = packs.from_history(hits).first()
    assert row["short_description"].startswith("Retrieved prior incident HIST-1 (similarity 0.500). word")
    assert (len(row["short_description"]), len(row["detail"]), row["timestamp"]) == (240, 500, "2025")
    assert hits.select(F.size("metadata")).first()[0] == 2


def test_blocks_below_the_floor_are_not_scored(spark):
    """Short texts over many slots: a query meets few blocks, and the hits are those of a full scan."""
    from pyrewatch.operators import search

    draw = np.random.default_rng(6)
    topics = [[f"t{topic}w{i}" for i in range(6)] for topic in range(40)]
    texts = [(f"d{i:04}", " ".join(draw.choice(topics[i % 40], 5))) for i in range(1200)]
    items = r.hash_vectors(spark.createDataFrame(texts, "id string, text string"), 512)
    queries = items.where("id < 'd0060'").withColumnRenamed("id", "query_id")
    found = search.search(queries, items, 3, items=32, chunk=16)
    rows = {x["id"]: np.array(x["vector"]) for x in items.collect()}
    want = set()
    for q in queries.collect():
        ranked = sorted((-round(float(np.dot(q["vector"], v)), 9), i) for i, v in rows.items())[:3]
        want |= {(q["query_id"], rank, i, -score) for rank, (score, i) in enumerate(ranked, 1)}
    got = {(x["query_id"], x["rank"], x["id"], x["score"]) for x in found.hits.collect()}
    assert {x[:3] for x in got} == {x[:3] for x in want}
    assert found.scored() < 0.2 * 60 * 1200
    assert search.search(queries.limit(0), items).hits.count() == 0


def test_search_collects_nothing():
    """No query, item or set passes through the driver."""
    import pathlib

    for name in ("search.py", "retrieval.py", "templates.py"):
        text = pathlib.Path(r.__file__).with_name(name).read_text()
        assert ".collect()" not in text and "toPandas" not in text, name


def test_chunks_of_a_very_long_note_take_linear_time(spark):
    """Twice the sections, about twice the time; every paragraph is in a chunk."""
    import time

    paragraph = "w" * 700
    seconds = []
    for sections in (2_000, 8_000):
        text = "# T\n" + "\n".join(f"## S{i}\n{paragraph}\n\n{i} {paragraph}\n\n{paragraph} {i}" for i in range(sections))
        start = time.process_time()
        found = [c for s, b in kn._pieces(text, kn.LONG_CHUNK) for c in [(s, b)]]
        seconds.append(time.process_time() - start)
        assert len(found) == 2 * sections and found[0][0] == "S0 (part 1)"
    assert seconds[1] < 12 * max(seconds[0], 0.02)
    table = spark.createDataFrame([("big.md", text)], "document_name string, text string")
    rows = kn.chunk_markdown(table)
    assert rows.count() == 16_000
    last = rows.orderBy(F.desc("position")).first()
    assert last["id"] == "big_16000" and last["text"].endswith(f"{paragraph} 7999\n")


def test_short_pieces_in_a_row(spark):
    sections = [("A", "x"), ("B", "y"), ("C", "z" * 300), ("D", ""), ("E", "q")]
    text = "".join(f"## {s}\n{b}\n" for s, b in sections)
    assert [(i, s) for i, s, _ in chunks_of(spark, text)] == [("note_001", "A / B / C / D / E")]
    assert chunks_of(spark, "## Only\nshort") == [("note_001", "Only", "Document: note\nSection: Only\n\nshort\n")]


def test_vectors_of_long_texts_and_many_tokens(spark, monkeypatch):
    """Pieces end between tokens, and forgetting tokens changes nothing."""
    import hashlib
    import re

    draw = random.Random(1)
    words = ["ab", "Éa", "x1", "日本", "_", "--", "Ünder_score", "ΣΑΣ", "42", "\u00b2", "a\u0301b"]
    texts = [" ".join(draw.choice(words) + str(draw.randint(0, 9)) for _ in range(n)) for n in (0, 1, 50, 4000)] + [None, "", "___", "ab" * 900]
    want = {}
    for i, text in enumerate(texts):
        sums = [0] * 32
        for token in re.findall(r"[^\W_]+", (text or "").lower()):
            digest = hashlib.sha256(token.encode()).digest()
            for slot, sign in zip(digest[:4], digest[4:8]):
                sums[slot % 32] += 1 if sign % 2 == 0 else -1
        norm = math.sqrt(sum(x * x for x in sums))
        if norm:
            want[i] = [x / norm for x in sums]
    table = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = [{x["id"]: x["vector"] for x in r.hash_vectors(table, 32).collect()}]
    monkeypatch.setattr(r, "PIECE_CHARS", 64)
    monkeypatch.setattr(r, "MOST_TOKENS", 30)
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    found.append({x["id"]: x["vector"] for out in r._vectors(32)(iter([batch])) for x in out.to_pylist()})
    for got in found:
        assert set(got) == set(want)
        for i, vector in want.items():
            assert got[i] == pytest.approx(vector)


def test_a_task_forgets_tokens_that_do_not_return():
    """Most distinct tokens of a large table are met once, so what a task remembers may not grow with the table."""
    known = r._Slots(64)
    for part in range(20):
        known.of([f"token{part}x{i}" for i in range(20_000)])
    assert len(known.known) < 100_000


def test_a_block_comes_once_for_all_its_visits():
    from pyrewatch.operators import search

    rng = np.random.default_rng(3)
    items, queries = rng.normal(size=(5, 8)), rng.normal(size=(6, 8))
    none = np.full(2, search.NO_FLOOR).tobytes()
    rows = pa.table({
        "ids": pa.array([[10, 11, 12, 13, 14], None, None, None], pa.list_(pa.int64())),
        "query_ids": pa.array([None, [0, 1], [2, 3], [4, 5]], pa.list_(pa.int64())),
        "floors": pa.array([None, none, none, none], pa.binary()),
        "data": pa.array([items.tobytes(), *[queries[i:i + 2].tobytes() for i in (0, 2, 4)]], pa.binary())})
    # One row at a time, as a block and its visits may lie in different batches.
    found = pa.Table.from_batches(list(search._scores(1)(iter(rows.to_batches(max_chunksize=1)))))
    assert found["query_id"].to_pylist() == list(range(6))
    assert found["id"].to_pylist() == (10 + (queries @ items.T).argmax(axis=1)).tolist()


def test_hits_take_texts_without_vectors(spark):
    """The texts are not joined with their vectors, and the setting for wide rows is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    texts = spark.createDataFrame([(f"d{i}", f"word{i} other") for i in range(5)], "id string, text string").withColumn(
        "metadata", F.create_map(F.lit("n"), "id"))
    asked = r.hash_vectors(spark.createDataFrame([("q", "word3")], "id string, text string")).withColumnRenamed("id", "query_id")
    best = r.hits(asked, texts, 1).collect()
    assert [(x["query_id"], x["id"], x["text"], x["metadata"]["n"]) for x in best] == [("q", "d3", "word3 other", "d3")]
    assert spark.conf.get(key) == before
