"""Conversation structure repair: faults of every conversation and the cheapest edits that give it a sound shape.

One shuffle orders all rows by conversation and turn in ranges, so a conversation of any size spreads over tasks. A task
walks its rows once (``audits``). A conversation that lies within a task and a segment is resolved there. Others are cut to
segments of bounded size: a segment gives the cheapest audit from every state before it to every state after it, the segments
of a conversation are joined by the same recurrence with whole segments as letters, and a last pass over the segments in order
hashes the repaired text. That hash and the audit are single values of the result, so one task has to finish them; it holds
the audit and one segment.

Defined results: a null role or text is one space, so such a text is blank; a null conversation id is a conversation of its
own; rows of one turn come in order of role and a hash of their text, null turns first; a conversation whose rows are all
dropped has zeros, an empty audit and the hash of nothing; a gap count beyond the range of a long is cut to it. An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrewatch.llm import audits
from pyrewatch.llm.audits import EMPTY, START, Audit
from pyrewatch.llm.stages import Stages

_SPACES = " \t\n\x0b\x0c\r"
_ENDS = (".", "!", "?")
_LEGAL = {"su", "ua", "au"}
_LONG = (1 << 63) - 1
#: Rows and characters from which a segment ends.
SEGMENT_ROWS, SEGMENT_CHARS = 4096, 2 << 20

_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = pa.struct([*[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
_ROWS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
_RESULT_DDL = f"struct<{', '.join(f'{c}: bigint' for c in _COUNTS)}, audit: string, repaired_sha256: string>"
_ROWS_DDL = "array<struct<turn: bigint, role: string, text: string>>"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows after damage by a checksum of ``conv_id:turn``; dropped ones have no copy."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(filled("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def _fault(text: str) -> tuple[bool, bool]:
    """Whether a text is blank, and whether it is cut off."""
    shown = text.strip(_SPACES)
    return not shown, not shown.endswith(_ENDS)


@dataclass
class Tally:
    """Counts over rows in order; tallies of consecutive rows add up."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first: str | None = None
    last: str | None = None
    least: int | None = None
    most: int | None = None
    rows: list[tuple[str, bool, bool]] = field(default_factory=list)

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        blank, cut = _fault(text)
        repeated = repeated and not blank
        cut = cut and not blank and not repeated
        self.blank += blank
        self.duplicate += repeated
        self.truncated += cut
        self.join(Tally(turns=0 if turn is None else 1, first=role[:1], last=role[:1], least=turn, most=turn))
        self.rows.append((role[:1], blank or repeated, cut))

    def join(self, later: Tally) -> None:
        """Take up the counts of the rows that follow."""
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(later, name))
        if later.first is not None:
            self.illegal += self.last is not None and self.last + later.first not in _LEGAL
            self.first, self.last = later.first if self.first is None else self.first, later.last
        if later.most is not None:
            # Rows come by turn, so only the turn at the border can be on both sides.
            self.turns += later.turns - (self.most == later.least)
            self.least, self.most = later.least if self.least is None else self.least, later.most

    @property
    def gaps(self) -> int:
        return 0 if self.most is None else min(_LONG, self.most - self.least + 1 - self.turns)


def resolve(rows: list[tuple[int | None, str, str]]) -> dict:
    """The result of one conversation from its (turn, role, text) rows in order."""
    tally, seen = Tally(), set()
    for turn, role, text in rows:
        tally.add(turn, role, text, (role, text) in seen)
        seen.add((role, text))
    cost, audit = audits.cheapest(audits.walk(tally.rows, audits.first_states()))
    letters = audit.letters()
    lines, _ = audits.repaired(letters, [(role, text) for _, role, text in rows], START)
    return {"gaps": tally.gaps, "blank": tally.blank, "duplicate": tally.duplicate, "truncated": tally.truncated,
            "illegal": tally.illegal, "cost": cost, "audit": letters.decode(),
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def _resolve_or_cut(most_rows: int, most_chars: int):
    """Resolve conversations that lie within the task and a segment; cut the others, which may go on elsewhere."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("rows", _ROWS), ("result", _RESULT)])

    def emit(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(map(list, zip(*out, strict=True)), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out = TaskContext.get().partitionId(), 0, []
        current, rows, chars, edge, begun = None, [], 0, True, False

        def segment() -> tuple:
            nonlocal seq
            seq += 1
            return current, part, seq, [{"turn": t, "role": r, "text": x} for t, r, x in rows], None

        for batch in batches:
            for conv_id, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun and conv_id != current:
                    out.append(segment() if edge else (current, part, None, None, resolve(rows)))
                    rows, chars, edge = [], 0, False
                current, begun = conv_id, True
                for _ in range(copies):
                    rows.append((turn, role, text))
                    chars += len(text)
                    if len(rows) >= most_rows or chars >= most_chars:
                        edge = True
                        out.append(segment())
                        yield emit(out)
                        out, rows, chars = [], [], 0
            if out:
                yield emit(out)
                out = []
        if begun:
            yield emit([segment()])
    return run


_SUMMARY = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()),
    *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "turns")],
    ("first", pa.string()), ("last", pa.string()), ("least", pa.int64()), ("most", pa.int64()),
    ("steps", pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("piece", pa.string())])))])
_SUMMARY_DDL = (
    "conv_id bigint, part int, seq bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, "
    "first string, last string, least bigint, most bigint, "
    "steps array<struct<before: int, after: int, cost: bigint, piece: string>>")


def _summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a segment, and the cheapest audit between every two states."""
    for batch in batches:
        for row in batch.to_pylist():
            tally, repeated = Tally(), set(row["repeated"] or ())
            for at, r in enumerate(row["rows"]):
                tally.add(r["turn"], r["role"], r["text"], at in repeated)
            steps = []
            for before in range(4):
                ends = audits.walk(tally.rows, [(0, EMPTY) if s == before else None for s in range(4)])
                steps += [{"before": before, "after": s, "cost": end[0], "piece": end[1].letters().decode()}
                          for s, end in enumerate(ends) if end]
            found = {name: getattr(tally, name) for name in _SUMMARY.names if hasattr(tally, name)}
            yield pa.RecordBatch.from_pylist([{**row, **found, "steps": steps}], schema=_SUMMARY)


@dataclass
class _Link:
    """The segments of a path, last one first."""

    before: _Link | None
    state: int
    piece: bytes


def _best_path(found: list[tuple[int, Audit, _Link]]) -> tuple[int, Audit, _Link]:
    least = min(cost for cost, _, _ in found)
    best = None
    for way in found:
        if way[0] == least and (best is None or audits.less(way[1], best[1])):
            best = way
    return best


class _Chain:
    """The recurrence over the segments of one conversation."""

    def __init__(self):
        self.tally, self.places = Tally(), []
        self.states = [s and (*s, None) for s in audits.first_states()]

    def add(self, row: dict) -> None:
        self.places.append((row["part"], row["seq"]))
        self.tally.join(Tally(**{n: row[n] for n in ("blank", "duplicate", "truncated", "illegal", "turns", "first", "last", "least", "most")}))
        found: list[list[tuple[int, Audit, _Link]]] = [[], [], [], []]
        for step in row["steps"]:
            known = self.states[step["before"]]
            if known:
                piece = step["piece"].encode()
                # Turns inserted ahead of the first row belong to the first segment.
                own, state = (piece, step["before"]) if known[2] else (known[1].letters() + piece, START)
                found[step["after"]].append((known[0] + step["cost"], Audit(known[1], piece) if piece else known[1],
                                             _Link(known[2], state, own)))
        self.states = [_best_path(f) if f else None for f in found]

    def rows(self, conv_id: int | None) -> list[dict]:
        """One row per segment with its part of the audit; the first one carries the conversation's counts."""
        cost, audit, link = _best_path([s for s in (self.states[START], self.states[audits.ASSISTANT]) if s])
        t, ways = self.tally, []
        while link:
            ways.append(link)
            link = link.before
        out = [{"conv_id": conv_id, "part": part, "seq": seq, "state": way.state, "piece": way.piece.decode(), "result": None}
               for (part, seq), way in zip(self.places, reversed(ways), strict=True)]
        out[0]["result"] = {"gaps": t.gaps, "blank": t.blank, "duplicate": t.duplicate, "truncated": t.truncated,
                            "illegal": t.illegal, "cost": cost, "audit": audit.letters().decode(), "repaired_sha256": None}
        return out


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("state", pa.int32()),
                        ("piece", pa.string()), ("result", _RESULT)])
    current, chain = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if chain is None or row["conv_id"] != current:
                if chain:
                    yield pa.RecordBatch.from_pylist(chain.rows(current), schema=schema)
                current, chain = row["conv_id"], _Chain()
            chain.add(row)
    if chain:
        yield pa.RecordBatch.from_pylist(chain.rows(current), schema=schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash the repaired text of each conversation, segment by segment."""
    schema = pa.schema([("conv_id", pa.int64()), ("result", _RESULT)])
    current, result, digest, lines = None, None, None, 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"conv_id": current, "result": {**result, "repaired_sha256": digest.hexdigest()}}], schema=schema)

    for batch in batches:
        for row in batch.to_pylist():
            if row["result"]:
                if digest:
                    yield done()
                current, result, digest, lines = row["conv_id"], row["result"], hashlib.sha256(), 0
            made, _ = audits.repaired(row["piece"].encode(), [(r["role"], r["text"]) for r in row["rows"]], row["state"])
            for line in made:
                digest.update(f"\n{line}".encode() if lines else line.encode())
                lines += 1
    if digest:
        yield done()


def _across_segments(cut: DataFrame, stages: Stages) -> DataFrame:
    """(conv_id, result) of the conversations that were cut."""
    place = F.struct("part", "seq", "at")
    said = cut.select("part", "seq", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("key"), F.posexplode("rows").alias("at", "r"))
    texts = said.select("part", "seq", "at", F.sha2(F.concat_ws("\0", "key", "r.role", "r.text"), 256).alias("said"))
    firsts = texts.groupBy("said").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = texts.join(firsts, "said").where(place > F.col("first")).groupBy("part", "seq").agg(F.collect_list("at").alias("repeated"))
    summary = cut.select("conv_id", "part", "seq", "rows").join(later, ["part", "seq"], "left").select(
        "conv_id", "part", "seq", "rows", "repeated").mapInArrow(_summarize, _SUMMARY_DDL)
    order = ("conv_id", "part", "seq")
    ways = stages.keep(summary.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(
        _chained, f"conv_id bigint, part int, seq bigint, state int, piece string, result {_RESULT_DDL}"))
    texts = ways.join(cut.select("part", "seq", "rows"), ["part", "seq"]).select(*ways.columns, "rows")
    return texts.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_hashed, f"conv_id bigint, result {_RESULT_DDL}")


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Faults and cheapest edits of every conversation of (conv_id, turn, role, text, copies) rows.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    stages = Stages(rows.sparkSession)
    keyed = rows.select("conv_id", "turn", "role", "text", "copies", F.xxhash64("text").alias("h1"),
                        F.xxhash64(F.lit(1), "text").alias("h2"))
    order = ["conv_id", "turn", "role", "h1", "h2"]
    # Equal rows are alike, so a number may deal them to several ranges.
    ranges = keyed.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    found = stages.keep(ranges.select("conv_id", "turn", "role", "text", "copies").mapInArrow(
        _resolve_or_cut(segment_rows, segment_chars), f"conv_id bigint, part int, seq bigint, rows {_ROWS_DDL}, result {_RESULT_DDL}"))
    whole = found.where("result is not null").select("conv_id", "result")
    cut = found.where("result is null").select("conv_id", "part", "seq", "rows")
    return whole.unionByName(_across_segments(cut, stages)).select("conv_id", "result.*")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    return repair(damaged(conversations))
