"""Quality rules, centroid clustering and conversation repair against plain versions."""

import hashlib
import heapq
import itertools
import random
import zlib

import numpy as np
import pytest
from brute import pairs, words
from pyspark.sql import functions as F

from pyrewatch.llm import audits, conversations, lloyd, rules
from pyrewatch.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
SPACES = " \t\n\v\f\r"


def judged(text):
    text = text or ""
    w = words(text)
    lines = [line for line in text.split("\n") if words(line)]
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    again = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)} if len(windows) < 500 else _again(windows)
    base = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), base)


def _again(windows):
    counts = {}
    for x in windows:
        counts[x] = counts.get(x, 0) + 1
    return {i + k for i, x in enumerate(windows) if counts[x] > 1 for k in range(3)}


@pytest.mark.parametrize("source", ["awkward", "documents", "nothing"])
def test_rules_measure_whole_texts(source, request):
    docs = request.getfixturevalue(source)
    found = rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    rows = [tuple(r) for r in found.collect()]
    assert sorted((r[:7] for r in rows), key=str) == sorted(((i, *judged(t)) for i, t in pairs(docs)), key=str)
    assert not any(r[6] and r[7] for r in rows)


def test_rules_run_without_python_or_shuffle(documents):
    plan = rules.judge(documents)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Exchange", "Generate"))


def test_odd_lines_and_symbols(llm):
    texts = ["#*$% &|<>\na\n \na\n\na", "a b c a b c a b c", "x\r\nx\r\nx", "a b a b a", "🙂 é\t| 日本"]
    docs = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: tuple(r)[1:6] for r in rules.judge(docs).collect()}
    assert rows == {i: judged(t)[:5] for i, t in enumerate(texts)}
    assert rows[0] == (5, 11, 8, 2, 0) and rows[1][4] == 9 and rows[3][4] == 5


def test_each_rule_can_reject(llm):
    prose = " ".join(f"the {a}{b}q word" for a in "abcd" for b in "efghi")
    texts = {"": prose, "symbols": prose + " |" * 12, "shouts": prose.replace("word", "word!"), "stop words": prose.replace("the", "xyz"),
             "word length": " ".join("x" * (20 + i) for i in range(60)) + " the" * 2, "repeated lines": "\n".join([prose, *["the end"] * 30]),
             "cut lines": "\n".join(f"{w} the..." for w in prose.split()), "listed lines": "\n".join(f"- {w} the" for w in prose.split()),
             "few words": "the end of it"}
    docs = llm.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in rules.judge(docs).collect()}
    for i, name in enumerate(texts):
        assert name in rows[i]["broken_rules"] and rows[i]["kept"] == (not name), (name, rows[i])
    lenient = rules.judge(docs, rules=(), base=()).collect()
    assert all(r["kept"] for r in lenient)


def test_rules_part_junk_from_prose(llm, documents):
    labels = llm.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality")
    rows = rules.judge(documents).join(labels, "doc_id").where("n_words >= 50").collect()
    assert rows and all(r["kept"] == (r["quality"] == 1) for r in rows)


def lloyd_rows(rows, centroids, rounds, dims, seed=3):
    kept = [(i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, [max(-lloyd.LARGEST, min(lloyd.LARGEST, x)) for x in v]) for i, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] is not None and hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in first[:centroids]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        near = nearest()
        for n in range(len(centres)):
            own = [v for (_, v), (_, at) in zip(kept, near, strict=True) if at == n]
            if own:
                centres[n] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    near = nearest()
    total = sum(d for d, _ in near)
    return sorted(((i, n, d, sum(x for x, at in near if at == n), total, hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest())
                   for (i, _), (d, n) in zip(kept, near, strict=True)), key=str)


def clusters(df, **settings):
    return sorted((tuple(r) for r in lloyd.cluster(df, **settings).collect()), key=str)


@pytest.mark.parametrize("width,chunk", [(3, 1024), (7, 16), (16, 50)])
def test_clusters(llm, monkeypatch, width, chunk):
    monkeypatch.setattr(lloyd, "CHUNK_ROWS", chunk)
    draw = np.random.default_rng(7)
    rows = [(i, (draw.normal(size=7) + 3 * (i % 4)).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(60)] + [rows[5], rows[5], (None, rows[6][1]), (None, [-0.0005] * 7)]
    rows += [(300, None), (301, []), (302, [1.0] * 6), (303, [1.0] * 6 + [None]), (304, [float("nan")] * 7), (305, [float("-inf")] * 7), (306, [3e9] * 7)]
    df = llm.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, chunk int, q string")
    for centroids in (5, 1, 200):
        got = clusters(df, centroids=centroids, rounds=3, dimensions=7, width=width)
        assert got == lloyd_rows(rows, centroids, 3, 7)


def test_clusters_of_the_query_and_of_nothing(llm):
    df = llm.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    found = sorted((tuple(r) for r in QUERIES["op11_centroid_clustering"](llm, SMALL).collect()), key=str)
    assert found == lloyd_rows(rows, 8, 10, 64)
    assert lloyd.cluster(df.limit(0)).collect() == []
    assert not [t for t in llm.catalog.listTables() if t.name.startswith("blocks_")]
    with pytest.raises(ValueError):
        lloyd.cluster(df, centroids=1 << 20)


NEXT = {"": "u", "s": "u", "a": "u", "u": "a"}


def cheapest(rows):
    """Cheapest edits by search in order of (cost, string)."""
    done, heap = {}, [(0, "", 0, "")]
    while heap:
        cost, text, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done[i, state] = (cost, text)
        heapq.heappush(heap, (cost + 3, text + "I", i, NEXT[state]))
        if i < len(rows):
            initial, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 4, text + "D", i + 1, state))
            if not gone:
                if (initial == "s" and state == "") or (initial == "u" and state != "u") or (initial == "a" and state == "u"):
                    heapq.heappush(heap, (cost + 3 * cut, text + "K", i + 1, initial))
                heapq.heappush(heap, (cost + 3 + 3 * cut, text + "R", i + 1, NEXT[state]))
    return min(done[len(rows), s] for s in ("", "a"))


def repaired(rows):
    """Every column of the result from (conv_id, turn, role, text) rows."""
    out, by = [], {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(rest)
    for conv, own in by.items():
        left = []
        for turn, role, text in sorted(own, key=lambda r: (r[0] is not None, r[0] or 0)):
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = (" " if x is None else x for x in (role, text))
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            left += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        turns = {t for t, _, _ in left if t is not None}
        marks, seen, counts = [], set(), [0, 0, 0]
        for _, role, text in left:
            shown = text.strip(SPACES)
            fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            marks.append((role[:1], fault in (0, 1), fault == 2))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marks))
        cost, audit = cheapest(marks)
        lines, state, at = [], "", 0
        for edit in audit:
            if edit == "I":
                state = NEXT[state]
                lines.append({"u": "user:", "a": "assistant:"}[state])
                continue
            _, role, text = left[at]
            at += 1
            if edit != "D":
                state = role[:1] if edit == "K" else NEXT[state]
                lines.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[state]}:{text}")
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def found_repairs(df):
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert df.columns == columns
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def talks():
    draw, rows = random.Random(11), []
    for conv in range(140):
        for turn in range(draw.choice([1, 2, 3, 5, 8, 12, 40])):
            if draw.random() < 0.9:
                rows.append((conv or None, turn or (None if draw.random() < 0.5 else 0),
                             draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]),
                             draw.choice(["Hi.", "yes", "", None, f"text {turn}.", f"x{turn}!", "what? ", "  \n", "é…", "One?\v"])))
    return rows + [(1000, 5, "user", None), (1001, None, None, None), (1002, -(1 << 62), "user", "a."), (1002, 1 << 62, "assistant", "b.")]


@pytest.mark.parametrize("segment", [4096, 3, 1])
def test_repairs_in_segments_of_any_size(llm, talks, segment):
    df = llm.createDataFrame([(*r, 1, "x") for r in talks], "conv_id long, turn long, role string, text string, part int, result string")
    got = found_repairs(conversations.repair(conversations.damaged(df.repartition(5)), segment_rows=segment))
    assert got == [tuple(min(x, (1 << 63) - 1) if isinstance(x, int) else x for x in r) for r in repaired(talks)]


def test_one_conversation_spreads_over_ranges(llm):
    draw = random.Random(2)
    rows = [(7, t, draw.choice(["user", "assistant", "system"]), draw.choice(["Yes.", f"t{t}.", f"t{t}", ""])) for t in range(3000)]
    rows += [(8, 1, "user", "Alike.")] * 400
    df = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    assert found_repairs(conversations.repair(conversations.damaged(df), segment_rows=100)) == repaired(rows)


def test_repairs_of_the_query_and_of_nothing(llm):
    df = llm.read.parquet(f"{SMALL}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]
    assert found_repairs(QUERIES["op12_conversation_repair"](llm, SMALL)) == repaired(rows)
    assert found_repairs(conversations.repair_damaged(df.limit(0))) == []


def test_audits_compare_like_strings():
    draw = random.Random(3)
    nodes = [audits.EMPTY]
    for _ in range(400):
        nodes.append(audits.Audit(draw.choice(nodes[-20:]), bytes(draw.choice(b"DIKR") for _ in range(draw.choice([1, 1, 5])))))
    for _ in range(2000):
        a, b = draw.choice(nodes), draw.choice(nodes)
        assert audits.less(a, b) == (a.letters() < b.letters())
        length = draw.randint(0, a.length)
        assert a.prefix(length) == audits._longer(0, a.letters()[:length])


def test_colliding_hashes_are_noticed(monkeypatch):
    monkeypatch.setattr(audits, "_PRIME", 3)
    draw = random.Random(4)
    texts = ["".join(draw.choice("DIKR") for _ in range(draw.randint(1, 12))) for _ in range(60)]

    def chain(text):
        node = audits.EMPTY
        for letter in text.encode():
            node = audits.Audit(node, bytes([letter]))
        return node
    for a, b in itertools.product(texts, texts):
        assert audits.less(chain(a), chain(b)) == (a < b)


def test_the_recurrence_is_cheapest_and_least():
    draw = random.Random(5)
    for _ in range(400):
        rows = [(draw.choice("usau "), draw.random() < 0.3, draw.random() < 0.3) for _ in range(draw.randint(0, 14))]
        cost, audit = audits.cheapest(audits.walk(rows, audits.first_states()))
        assert (cost, audit.letters().decode()) == cheapest(rows)


def test_contract_columns(llm):
    assert QUERIES["op11_centroid_clustering"](llm, SMALL).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert QUERIES["op13_quality_rules"](llm, SMALL).columns[:8] == [
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert QUERIES["op12_conversation_repair"](llm, SMALL).where(F.col("cost") < 0).count() == 0
