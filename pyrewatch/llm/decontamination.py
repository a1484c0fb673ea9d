"""Benchmark decontamination: pieces that must survive, found exactly, then Myers' bit-parallel distance.

A test item with an error budget of ``k`` edits is split into ``k + 1`` pieces. Whatever ``k`` edits do to a copy, one
piece survives unchanged, so a document holds a copy only if it holds a piece at about the right place. Pieces of all
items are found in one pass over each text by an Aho-Corasick automaton; around each hit the item is aligned with the
text by Myers' bit vectors, which give the smallest number of edits over all its substrings there.

Texts and items are compared lower-cased, with every run of characters that are no letters or digits as one space.

Items are taken in blocks of a checked size, so an automaton is bounded whatever the benchmark holds; each block is one
pass over the documents.

Defined results: null or empty texts and items without letters or digits match nothing; repeated rows and items are
reported each for itself; a null id is kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyrewatch.llm.stages import keep_rows

#: Edits allowed per item: one in so many characters. A shorter item must be held as it is.
CHARS_PER_EDIT = 16
#: Characters of items in a block.
BLOCK_CHARS = 8 << 20

_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def budget(item: str) -> int:
    return len(item) // CHARS_PER_EDIT


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces of nearly equal length with their places; fewer if the item has fewer characters."""
    parts = min(edits + 1, len(item))
    edges = [len(item) * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


class Pattern:
    """An item prepared for Myers' algorithm; a Python integer holds a whole column of the matrix."""

    def __init__(self, item: str):
        self.length = len(item)
        self.last = 1 << (self.length - 1)
        self.full = (1 << self.length) - 1
        self.where: dict[str, int] = {}
        for i, letter in enumerate(item):
            self.where[letter] = self.where.get(letter, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """Fewest edits between the item and any substring of ``text``, and the end of the first such substring."""
        up, down, score = self.full, 0, self.length
        best, end = score, 0
        full, last, where = self.full, self.last, self.where
        for at, letter in enumerate(text, 1):
            equal = where.get(letter, 0)
            across = (((equal & up) + up) ^ up) | equal | down
            more = down | (full & ~(across | up))
            less = up & across
            if more & last:
                score += 1
            elif less & last:
                score -= 1
            more = more << 1 & full
            less = less << 1 & full
            vertical = equal | down
            up = less | (full & ~(vertical | more))
            down = more & vertical
            if score < best:
                best, end = score, at
        return best, end


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(item_id, text, budget(text)) for item_id, text in items]
        self.patterns: list[Pattern | None] = [None] * len(items)
        places: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, edits) in enumerate(self.items):
            for at, piece in pieces(text, edits):
                places.setdefault(piece, []).append((number, at))
        self.automaton = ahocorasick.Automaton() if places else None
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if self.automaton is not None:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item, edits, edits allowed, start, end) of the best copy of every item that the normal text holds; first end on ties.

        The start is that of the stretch looked at, which the copy lies in.
        """
        if self.automaton is None:
            return []
        spans: dict[int, list[tuple[int, int]]] = {}
        for last, (size, where) in self.automaton.iter(text):
            first = last + 1 - size
            for number, at in where:
                _, item, edits = self.items[number]
                start = max(0, first - at - edits)
                end = min(len(text), first - at + len(item) + edits)
                own = spans.setdefault(number, [])
                # Hits of one copy come in order and look at almost the same stretch.
                if own and start <= own[-1][1] and end - own[-1][0] <= len(item) + 4 * edits + size:
                    own[-1] = (min(own[-1][0], start), max(own[-1][1], end))
                else:
                    own.append((start, end))
        found = []
        for number, own in sorted(spans.items()):
            item_id, item, edits = self.items[number]
            if self.patterns[number] is None:
                self.patterns[number] = Pattern(item)
            best = None
            for start, end in sorted(set(own)):
                if text.startswith(item, start + min(edits, max(0, end - start - len(item)))):
                    score, stop = 0, min(edits, max(0, end - start - len(item))) + len(item)
                else:
                    score, stop = self.patterns[number].best(text[start:end])
                if score <= edits and (best is None or score < best[0]):
                    best = (score, edits, start, start + stop)
                    if not score:
                        break
            if best:
                found.append((item_id, *best))
        return found


@lru_cache(maxsize=2)
def _matcher(items: tuple[tuple[int, str], ...]) -> Matcher:
    return Matcher(list(items))


_MATCH = "doc_id long, item_id long, edits int, edits_allowed int, start int, end int"


def _match_batches(items: tuple[tuple[int, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(items)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for match in matcher.find(normal(text.as_py())):
                    for column, value in zip(out, (doc_id, *match), strict=True):
                        column.append(value)
            kinds = [pa.int64()] * 2 + [pa.int32()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)],
                                             ["doc_id", "item_id", "edits", "edits_allowed", "start", "end"])
    return run


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[tuple[int, str], ...]]:
    """Items in blocks of at most ``block_chars`` characters (an item is never split), one block on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text")
    block, size = [], 0
    for item_id, text in items.toLocalIterator():
        item = normal(text)
        if not item:
            continue
        if block and size + len(item) > block_chars:
            yield tuple(block)
            block, size = [], 0
        block.append((item_id, item))
        size += len(item)
    if block:
        yield tuple(block)


def matches(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, edits, edits_allowed, start, end: the best copy of each item in each document that holds one.

    ``start`` and ``end`` are places in the normal text.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = None
    for block in item_blocks(benchmark, block_chars):
        part = rows.mapInArrow(_match_batches(block), _MATCH)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], _MATCH)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows whose text holds a copy of an item. Rows pass through whole, in one pass per block."""
    for block in item_blocks(benchmark, block_chars):
        docs = keep_rows(docs, "text", _clean(block))
    return docs


def _clean(items: tuple[tuple[int, str], ...]):
    def keep(texts: pa.Array) -> pa.Array:
        matcher = _matcher(items)
        return pa.array([not matcher.find(normal(t.as_py())) for t in texts], pa.bool_())
    return keep
