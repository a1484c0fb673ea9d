import time
from pathlib import Path

import numpy as np
import pytest
from brute import groups, pairs, removal_rows, removals, sort_rows, words

from pyrewatch.llm import repeats, simhash, substring_dedup, suffix_dedup
from pyrewatch.llm.fm_index import BitVector, ShardIndex, WaveletMatrix
from pyrewatch.llm.stages import Stages
from pyrewatch.llm.suffixes import common_prefixes, suffix_array


def got(df, *columns):
    return sort_rows([tuple(r[c] for c in columns) for r in df.collect()])


@pytest.mark.parametrize("source", ["awkward", "documents", "nothing"])
def test_fingerprint_groups(source, request):
    docs = request.getfixturevalue(source)
    found = simhash.near_duplicate_groups(docs)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert got(found, *found.columns) == sort_rows(groups(pairs(docs)))


def test_chains_join_and_crowded_cells_are_cut(llm):
    """A chain of fingerprints two bits apart is one component, also when every cell is cut into strips."""
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    fps = set()
    for s in seeds.tolist():
        for _ in range(30):
            fps.add(s)
            for bit in rng.choice(64, 2, replace=False).tolist():
                s ^= 1 << bit
    fps = np.array(sorted(fps), np.uint64)
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= 3).tolist():
            up[root(i + 1 + j)] = root(i)
    table = llm.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for strip_rows in (20_000, 3):
        stages = Stages(llm)
        found = simhash.connected(simhash.links(table, strip_rows), stages).collect()
        label = {r["node"]: r["label"] for r in found}
        mine = [label.get(int(x), int(x)) for x in fps.view(np.int64)]
        both = {(root(i), m) for i, m in enumerate(mine)}
        assert len(both) == len({root(i) for i in range(len(fps))}) == len(set(mine))


def test_a_cell_yields_a_forest():
    rng = np.random.default_rng(2)
    start = int(rng.integers(0, 1 << 62))
    cell = np.unique(np.array([start ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 24, (400, 2))], np.uint64))
    links = simhash.cell_links(cell)
    assert len(links) < len(cell)
    assert all(int(cell[a] ^ cell[b]).bit_count() <= 3 for a, b in links)


def test_one_of_each_keeps_the_smallest_id(awkward, nothing):
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    rows = kept.collect()
    want = {c for _, _, c in groups(pairs(awkward)) if c is not None}
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == sorted(want)
    assert sum(r["doc_id"] is None for r in rows) == 1
    assert {r["a.b"] for r in rows} == {7}
    assert simhash.one_of_each(nothing).count() == 0


@pytest.mark.parametrize("source", ["awkward", "documents", "nothing"])
def test_repeated_words(source, request):
    docs = request.getfixturevalue(source)
    want = sort_rows([(i, n, gone, kept) for i, n, gone, _, kept in removal_rows(pairs(docs), True)])
    found = substring_dedup.remove_repeats(docs)
    assert got(found, "doc_id", "n_words", "n_removed", "kept_sha256") == want


@pytest.mark.parametrize("source", ["awkward", "documents", "nothing"])
def test_repeated_bytes(source, request):
    docs = request.getfixturevalue(source)
    found = suffix_dedup.remove_repeats(docs)
    assert got(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sort_rows(removal_rows(pairs(docs), False))


def test_hot_anchors_are_dealt_further(awkward, documents, monkeypatch):
    """With every anchor hot and tiny groups and shards the rows are the same."""
    monkeypatch.setattr(repeats, "GROUP_BYTES", 1 << 14)
    docs = awkward.select("doc_id", "text").union(documents.select("doc_id", "text").filter("doc_id < 60"))
    want = sort_rows([(i, n, gone, kept) for i, n, gone, _, kept in removal_rows(pairs(docs), True)])
    shared = repeats._shared_rows

    def every_anchor_hot(table):
        repeats.HOT_TEXTS = 1
        return shared(table)

    monkeypatch.setattr(repeats, "_shared_rows", every_anchor_hot)
    found = repeats.digests(docs, repeats.Windows(words=True, cut=7), substring_dedup.smallest_ids, 1 << 10)
    assert got(found, "doc_id", "n", "n_removed", "kept_sha256") == want


@pytest.mark.parametrize("by_words", [True, False])
def test_a_hot_passage_is_no_shard(llm, monkeypatch, by_words):
    """A passage in very many texts: no shard gets over two limits, and the rows are those of brute force."""
    monkeypatch.setattr(repeats, "GROUP_BYTES", 1 << 14)
    rng = np.random.default_rng(4)

    def prose(n):
        return " ".join(str(x) for x in rng.integers(0, 1 << 40, n))

    shared, twice = prose(60), prose(55)
    rows = [(int(i), f"{prose(12)} {shared} {prose(9)}") for i in rng.permutation(300)]
    rows += [(400, f"{twice} {prose(3)} {shared}"), (350, f"{shared} {twice}"), (None, f"{prose(2)} {shared}"), (401, prose(70))]
    method = substring_dedup if by_words else suffix_dedup
    kind, limit = method.WORDS if by_words else method.BYTES, 1 << 14
    decide = method.smallest_ids

    def bounded(segments, kind):
        assert sum(len(s.content) for s in segments) <= 2 * limit
        return decide(segments, kind)

    docs = llm.createDataFrame(rows, "doc_id long, text string")
    found = repeats.digests(docs, kind, bounded, limit)
    assert got(found, "doc_id", "n", "n_removed", "n_spans", "kept_sha256") == sort_rows(removal_rows(rows, by_words))


@pytest.fixture
def tables(monkeypatch):
    """Folders of the stages that ``repeats`` makes."""
    made, kind = [], repeats.Stages

    def noted(spark):
        made.append(kind(spark))
        return made[-1]

    monkeypatch.setattr(repeats, "Stages", noted)
    return made


def many_texts(spark, n, passage=""):
    rng = np.random.default_rng(11)
    rows = [(i, passage + " ".join(str(x) for x in rng.integers(0, 1 << 40, 40))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(50)


@pytest.mark.parametrize("partitions", [7, 60, 200])
def test_files_of_texts_do_not_multiply(llm, monkeypatch, tables, partitions):
    """As many as groups or partitions, not a file of each group from each partition."""
    monkeypatch.setattr(repeats, "GROUP_BYTES", 1 << 12)
    _, docs = many_texts(llm, 400)
    before = {k: llm.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        llm.conf.set("spark.sql.shuffle.partitions", partitions)
        llm.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        plan, stages = repeats._Plan.of(docs), repeats.Stages(llm)
        texts = repeats.distinct_texts(docs, stages, plan)
        assert 45 <= plan.groups <= 200
        files = len(list(Path(stages.folder.removeprefix("file:")).glob("texts/*.parquet")))
        assert 30 <= files <= max(plan.groups, partitions)
        assert texts.count() == 400
    finally:
        for key, value in before.items():
            llm.conf.set(key, value)


def test_disk_is_given_back_before_the_result(llm, tables):
    """Of shuffles nothing stays, of stages only the texts and what is to be removed from them."""
    def shuffled():
        kept = llm._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {name.rsplit("/", 1)[-1] for name in kept.split("\n") if "/shuffle_" in name}

    _, docs = many_texts(llm, 60, "shared passage " * 40)
    before = shuffled()
    repeats.repeats(docs, suffix_dedup.BYTES, suffix_dedup.smallest_ids, suffix_dedup.SHARD_BYTES)
    until = time.time() + 30
    while (left := shuffled() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    stages = [p for p in Path(tables[0].folder.removeprefix("file:")).iterdir() if p.name != "texts"]
    columns = [set(llm.read.parquet(str(p)).columns) for p in stages]
    assert not [c for c in columns if "content" in c or "sid" in c]


def test_what_many_groups_send_is_judged_once(llm, monkeypatch):
    """A passage that every group sends is one segment of its shard, also where it is merged before."""
    monkeypatch.setattr(repeats, "GROUP_BYTES", 1 << 9)
    rng = np.random.default_rng(12)
    rows, docs = many_texts(llm, 90, " ".join(str(x) for x in rng.integers(0, 1 << 40, 200)) + " ")
    heavy, shared = [], repeats._shared_rows

    def few_anchors_hot(table):
        repeats.HOT_TEXTS = 512  # a worker may have another test's
        return shared(table)

    def once(segments, kind):
        contents = [s.content for s in segments]
        assert len(set(contents)) == len(contents)
        return suffix_dedup.smallest_ids(segments, kind)

    monkeypatch.setattr(repeats, "_shared_rows", few_anchors_hot)
    joined = type(docs).unionByName
    monkeypatch.setattr(type(docs), "unionByName", lambda a, b, *rest: (heavy.append(b.count()), joined(a, b, *rest))[1])
    found = repeats.digests(docs, suffix_dedup.BYTES, once, 1 << 17)
    assert got(found, "doc_id", "n", "n_removed", "n_spans", "kept_sha256") == sort_rows(removal_rows(rows, False))
    assert heavy[0] > 0


def test_drop_repeats_changes_only_repeats(awkward, nothing):
    found = substring_dedup.drop_repeats(awkward)
    assert found.columns == awkward.columns
    want = []
    for (doc_id, text), (symbols, gone) in zip(pairs(awkward), removals(pairs(awkward), True), strict=True):
        want.append((doc_id, " ".join(w for w, g in zip(symbols, gone, strict=True) if not g) if any(gone) else text))
    assert got(found, "doc_id", "text") == sort_rows(want)
    assert all(r["n_chars"] == len(r["text"] or "") for r in found.collect())
    assert substring_dedup.drop_repeats(nothing).count() == 0
    assert words(" a b\x0bc ") == ["a b", "c"]


def test_suffix_arrays_and_prefixes():
    rng = np.random.default_rng(0)
    for turn in range(300):
        symbols = int(rng.integers(1, 6))
        text = rng.integers(0, symbols, int(rng.integers(1, 70)))
        if turn % 3 == 0:
            text = np.tile(text[: max(1, len(text) // 4)], 4)
        array = suffix_array(text, symbols)
        plain = text.tolist()
        assert array.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
        for i, shared in enumerate(common_prefixes(text, array, symbols).tolist()):
            n = 0
            if i:
                a, b = plain[array[i - 1]:], plain[array[i]:]
                while n < min(len(a), len(b)) and a[n] == b[n]:
                    n += 1
            assert shared == n


def test_wavelet_ranks_and_matching_statistics():
    rng = np.random.default_rng(3)
    sequence = rng.integers(0, 37, 500)
    tree = WaveletMatrix(sequence, 37)
    at, symbol = rng.integers(0, 501, 400), rng.integers(0, 37, 400)
    assert tree.rank(symbol, at).tolist() == [int((sequence[:a] == s).sum()) for a, s in zip(at, symbol, strict=True)]
    bits = rng.integers(0, 2, 130)
    assert BitVector(bits).rank(np.arange(131)).tolist() == [0, *np.cumsum(bits).tolist()]
    streams = [rng.integers(1, 4, int(n)) for n in rng.integers(3, 40, 12)]
    ids = [int(x) for x in rng.permutation(12)]
    text = np.concatenate([np.append(s, 0) for s in streams])
    index = ShardIndex(text, 4, np.repeat(ids, [len(s) + 1 for s in streams]), 3)
    for stream, found in zip(streams, index.statistics(streams), strict=True):
        for start, smallest in enumerate(found.tolist()):
            window = stream[start:start + 3].tolist()
            holders = [i for i, s in zip(ids, streams, strict=True)
                       if any(s[k:k + 3].tolist() == window for k in range(len(s) - 2))]
            assert smallest == min(holders)
