"""Sharding, packing, search and decontamination."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import fewest_edits, pairs, sort_rows
from pyspark.sql import functions as F

from pyrewatch.llm import ball_tree, decontamination, packing, sharding
from pyrewatch.llm.stages import Stages


@pytest.mark.parametrize("source", ["awkward", "documents", "nothing"])
def test_shards(source, request):
    docs = request.getfixturevalue(source)
    rows = sharding.shard_documents(docs).collect()
    want = sort_rows([(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs(docs)])
    assert sort_rows([(r["doc_id"], r["size"], r["text_crc32"]) for r in rows]) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and 0 <= r["shard"] < 8 and r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    placed = {(r["doc_id"], r["shard"], r["grown_shard"]) for r in rows}
    assert len(placed) == len({r["doc_id"] for r in rows})


def test_weights_and_confined_moves(llm):
    ids = llm.range(20_000).withColumnRenamed("id", "doc_id")
    leaves = [sharding.Leaf("east", "a", 0, 1), sharding.Leaf("east", "a", 1, 3), sharding.Leaf("east", "b", 2, 2),
              sharding.Leaf("west", "c", 3, 2), sharding.Leaf("west", "d", 4, 2)]
    heavier = [leaf if leaf.shard != 2 else sharding.Leaf("east", "b", 2, 4) for leaf in leaves]
    rows = sharding.place(sharding.place(ids, F.col("doc_id"), leaves), F.col("doc_id"), heavier, "after").collect()
    counts = Counter(r["shard"] for r in rows)
    assert all(abs(counts[leaf.shard] / 20_000 - leaf.weight / 10) < 0.02 for leaf in leaves)
    region = {leaf.shard: leaf.region for leaf in leaves}
    moves = {(r["shard"], r["after"]) for r in rows if r["shard"] != r["after"]}
    # Rows move into the rack that grew, or into its region from the other one; never out of it, never within "west".
    assert moves and all(region[b] == "east" for _, b in moves) and all(a != 2 for a, _ in moves)
    assert all(b == 2 for a, b in moves if region[a] == "east")
    with pytest.raises(ValueError):
        sharding.place(ids, F.col("doc_id"), [])
    with pytest.raises(ValueError):
        sharding.place(ids, F.col("doc_id"), [leaves[0], leaves[0]])


def reference_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_equal_pieces_spread_over_groups(llm):
    """Repeated rows are all kept and no group gets more than its share of them."""
    rows = [(None, "one two three " * 40)] * 1000 + [(i, f"text {i}") for i in range(50)]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    found = packing.pack(docs, Stages(llm), group_windows=2).collect()
    alike = [r["sequence_id"] >> 32 for r in found if r["doc_id"] is None]
    groups = len(set(alike))
    assert len(found) == 1050 and len(alike) == 1000 and groups > 4
    assert max(alike.count(g) for g in set(alike)) <= -(-1000 // groups)


@pytest.mark.parametrize("source", ["awkward", "documents", "nothing"])
def test_packed_pieces(source, request, llm):
    docs = request.getfixturevalue(source)
    rows = packing.pack(docs, Stages(llm)).collect()
    want = []
    for doc_id, text in pairs(docs):
        ids = [*reference_ids(text), packing.END]
        want += [(doc_id, start, length, zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes()), len(ids))
                 for start, length in packing.cuts(len(ids))]
        assert sum(length for _, length in packing.cuts(len(ids))) == len(ids)
    assert sort_rows([(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows]) == sort_rows(want)
    windows = defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for window in windows.values():
        at = 0
        for offset, length in sorted(window):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    if source == "documents":
        assert sum(r["length"] for r in rows) / (packing.CAPACITY * len(windows)) > 0.97


def test_tokenizer_agrees_on_odd_text():
    draw = random.Random(0)
    letters = "aAéÉ'sSdD 19.,!|İıŉſß́\n\tKΣσςµªº²½\xad\x1c\x85 "
    own = packing.word_tokenizer(packing.TOKENIZER)
    texts = ["", " ", "<|endoftext|>a", "a<|x", "It's we'll I'D", "ÉCOLE naïve", "日本語 テキスト", "é a\x00b", "👍🏽 a😀b"]
    texts += ["".join(draw.choice(letters) for _ in range(draw.randint(1, 30))) for _ in range(400)]
    for text in texts:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == reference_ids(text), text


def test_differencing():
    assert packing.fill_windows([]) == []
    with pytest.raises(ValueError):
        packing.fill_windows([5], 4)
    sums, _, _ = packing.difference([8, 7, 6, 5, 4], 2)
    assert sums.tolist() == [16, 14]
    draw = random.Random(1)
    for _ in range(60):
        sizes = [draw.randint(1, 1024) for _ in range(draw.randint(1, 150))]
        windows = packing.fill_windows(sizes)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
        assert max(sum(sizes[i] for i in w) for w in windows) <= packing.CAPACITY


def best_products(rows, k, every):
    ints = {i: np.floor(np.array(v, float) * 256) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in ints if i % every == 0):
        scored = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return out


@pytest.mark.parametrize("small_shards", [False, True])
def test_largest_products(llm, monkeypatch, small_shards):
    if small_shards:
        monkeypatch.setattr(ball_tree, "SHARD_ROWS", 40)
        monkeypatch.setattr(ball_tree, "QUERY_BLOCK", 20)
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.3 * draw.normal(size=8)).tolist()) for i in range(400)]
    rows += [(400 + i, rows[50][1]) for i in range(150)]
    rows += [(1000, None), (1001, []), (1002, [1.0] * 7 + [None]), (1003, [float("nan")] * 8), (1005, [float("inf")] * 8),
             (None, [1.0] * 8), (1010, [2.0] * 5), (1015, [1.0] * 5), rows[3], rows[3], (-50, [-1.0] * 8)]
    vectors = llm.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, query int, shard int")
    found = ball_tree.top_products(vectors, F.col("vec_id") % 5 == 0).collect()
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = best_products(single, 5, 5)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == sorted(want)


def test_no_vectors(llm):
    empty = llm.createDataFrame([], "vec_id long, embedding array<float>")
    assert ball_tree.top_products(empty, F.col("vec_id") % 5 == 0).count() == 0


def test_large_integers_stay_exact():
    a = np.array([[2.0 ** 40, 1.0]])
    assert ball_tree.products(a, a).tolist() == [[2 ** 80 % 2 ** 64 + 1]]
    assert ball_tree.products(np.array([[3.0, -2.0]]), np.array([[5.0, 7.0]])).tolist() == [[1]]


def test_myers_distance():
    draw = random.Random(2)
    for _ in range(400):
        item = "".join(draw.choice("ab c") for _ in range(draw.randint(1, 20)))
        text = "".join(draw.choice("ab c") for _ in range(draw.randint(0, 40)))
        assert decontamination.Pattern(item).best(text)[0] == fewest_edits(item, text)


def edited(draw, text, edits):
    letters = list(text)
    for _ in range(edits):
        at = draw.randrange(len(letters))
        kind = draw.randint(0, 2)
        if kind == 0:
            letters[at] = draw.choice("abcdef")
        elif kind == 1:
            letters.insert(at, draw.choice("abcdef"))
        else:
            del letters[at]
    return "".join(letters)


def test_every_copy_within_the_budget_is_found(llm):
    draw = random.Random(3)
    items = [(i, "".join(draw.choice("abcd ef") for _ in range(draw.randint(20, 90)))) for i in range(12)]
    items += [(20, None), (21, "!!"), (22, "x"), (3, items[3][1])]
    texts = []
    for i in range(60):
        text = "".join(draw.choice("abcd ef") for _ in range(150))
        for _, item in draw.sample(items[:12], 2):
            at = draw.randrange(len(text))
            text = text[:at] + edited(draw, item.upper() if i % 2 else item, draw.randint(0, 6)) + text[at:]
        texts.append((i if i else None, text))
    texts += [(100, None), (101, ""), (102, "-- !!")]
    docs = llm.createDataFrame([(i, t, "c") for i, t in texts], "doc_id long, text string, item_id string")
    benchmark = llm.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    want = set()
    for doc_id, text in texts:
        for item_id, item in items:
            a, b = decontamination.normal(item), decontamination.normal(text)
            if a and fewest_edits(a, b) <= decontamination.budget(a):
                want.add((doc_id, item_id, fewest_edits(a, b)))
    for block_chars in (1 << 20, 100):
        found = decontamination.matches(docs, benchmark, block_chars).collect()
        assert {(r["doc_id"], r["item_id"], r["edits"]) for r in found} == want
        assert all(r["edits"] <= r["edits_allowed"] for r in found)
        kept = decontamination.drop_contaminated(docs, benchmark, block_chars)
        assert kept.columns == docs.columns
        assert sort_rows([(r["doc_id"],) for r in kept.collect()]) == sort_rows(
            [(i,) for i, _ in texts if i not in {d for d, _, _ in want}])
    assert decontamination.matches(docs, benchmark.limit(0)).count() == 0
    assert decontamination.matches(docs.limit(0), benchmark).count() == 0


def test_bounds_of_many_balls_stay_small():
    """Ten thousand queries of a batch against five thousand balls: bounds are taken in slices."""
    import tracemalloc

    import pyarrow as pa

    draw = np.random.default_rng(0)
    balls = {32: (np.arange(5000), draw.normal(size=(5000, 32)) * 256, np.full(5000, 1.0))}
    rows = draw.normal(size=(10_000, 32))
    batch = pa.record_batch([pa.array(np.arange(10_000)), pa.array(list(rows), pa.list_(pa.float64())), pa.array(np.full(10_000, 1 << 20))],
                            names=["query", "embedding", "floor"])
    for first in (True, False):
        tracemalloc.start()
        found = sum(out.num_rows for out in ball_tree._visits(balls, first)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found == 10_000 if first else found < 10_000 * 5000
        assert peak < 200e6


def test_very_many_short_pieces_are_several_groups(llm):
    """Six hundred thousand empty texts: a group has a bounded number of pieces, and windows are full."""
    docs = llm.range(600_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    found = packing.pack(docs, Stages(llm)).groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.count("*").alias("pieces"))
    rows = found.collect()
    groups = Counter()
    for r in rows:
        groups[r["sequence_id"] >> 32] += r["pieces"]
    assert sum(groups.values()) == 600_000 and max(groups.values()) < 1.1 * packing.GROUP_PIECES
    assert all(r["tokens"] <= packing.CAPACITY for r in rows)
    assert 600_000 / (packing.CAPACITY * len(rows)) > 0.85
