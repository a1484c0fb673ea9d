"""Audits of cheapest edits: persistent strings that share their prefixes, and the recurrence that builds them.

An audit is a node that names the audit before it and the letters added, so the four states of the recurrence share what
they have in common. A node knows ancestors at distances 1, 2, 4, ... and a rolling hash of its whole string. Of two equally
cheap audits the ASCII-least counts: their longest common prefix is searched by hashes of prefixes, and the prefix found is
verified on the letters that the two do not share.

Two equally cheap audits of the same rows and state are never prefixes of one another: both hold one K, R or D per row, and
an insertion costs something. So the smaller prefix stays the smaller one whatever follows.
"""

from __future__ import annotations

from collections.abc import Iterable

_BASE, _PRIME = 256, (1 << 61) - 1


class Audit:
    """A string as the audit before it and some more letters."""

    __slots__ = ("before", "hash", "length", "piece", "ups")

    def __init__(self, before: Audit | None, piece: bytes):
        self.before, self.piece = before, piece
        if before is None:
            self.length, self.hash, self.ups = 0, 0, ()
            return
        self.length = before.length + len(piece)
        self.hash = _longer(before.hash, piece)
        ups, up, level = [before], before, 0
        while level < len(up.ups):
            up = up.ups[level]
            ups.append(up)
            level += 1
        self.ups = tuple(ups)

    def prefix(self, length: int) -> int:
        """Hash of the first ``length`` letters: the deepest ancestor within them, and a part of the next piece."""
        node, level = self, len(self.ups) - 1
        while level >= 0:
            if level < len(node.ups) and node.ups[level].length >= length:
                node = node.ups[level]
            else:
                level -= 1
        if node.length == length:
            return node.hash
        return _longer(node.before.hash, node.piece[:length - node.before.length])

    def letters(self) -> bytes:
        return _pieces(self, EMPTY)


EMPTY = Audit(None, b"")


def _longer(start: int, piece: bytes) -> int:
    return (start * pow(_BASE, len(piece), _PRIME) + int.from_bytes(piece)) % _PRIME


def _pieces(node: Audit, above: Audit) -> bytes:
    """The letters of ``node`` after its ancestor ``above``."""
    pieces = []
    while node is not above:
        pieces.append(node.piece)
        node = node.before
    return b"".join(reversed(pieces))


def _shared(x: Audit, y: Audit) -> Audit:
    """The last node that both audits go through."""
    while x is not y:
        if x.length < y.length or (x.length == y.length and len(x.ups) < len(y.ups)):
            x, y = y, x
        x = x.before
    return x


def less(x: Audit, y: Audit) -> bool:
    """Whether ``x`` stands before ``y`` in ASCII order."""
    if x is y:
        return False
    low, high = 0, min(x.length, y.length)
    while low < high:
        middle = (low + high + 1) // 2
        if x.prefix(middle) == y.prefix(middle):
            low = middle
        else:
            high = middle - 1
    above = _shared(x, y)
    a, b, at = _pieces(x, above), _pieces(y, above), low - above.length
    if at < 0 or a[:at] != b[:at] or a[at:at + 1] == b[at:at + 1]:
        return a < b  # two prefixes had one hash
    return a[at:at + 1] < b[at:at + 1]


# States: nothing kept yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}

#: Per state the cost and the audit, or nothing.
States = list[tuple[int, Audit] | None]


def _best(found: list[tuple[int, Audit, bytes]]) -> tuple[int, Audit] | None:
    """The cheapest candidate; of equal ones the ASCII-least."""
    if not found:
        return None
    least = min(cost for cost, _, _ in found)
    best = None
    for cost, before, letter in found:
        if cost == least:
            audit = Audit(before, letter) if letter else before
            if best is None or less(audit, best):
                best = audit
    return least, best


def inserted(states: States) -> States:
    """States after insertions: a user turn wherever one may stand, and an assistant turn after a user turn."""
    out = list(states)
    for target, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
        found = [(*out[target], b"")] if out[target] else []
        found += [(out[s][0] + INSERT, out[s][1], b"I") for s in sources if out[s]]
        out[target] = _best(found)
    return out


def _useful(states: States) -> States:
    """Without states that can not be part of a cheapest end.

    All that may follow a system turn may follow an assistant turn; what may follow nothing may too, once a kept system turn
    is deleted.
    """
    if states[ASSISTANT]:
        cost = states[ASSISTANT][0]
        for state, room in ((SYSTEM, 0), (START, DELETE)):
            if states[state] and states[state][0] > cost + room:
                states[state] = None
    return states


def after(states: States, initial: str, gone: bool, cut: bool) -> States:
    """States after one more row: its role's initial, whether it has to be deleted, and whether its text is cut off."""
    found: list[list[tuple[int, Audit, bytes]]] = [[], [], [], []]
    extra = CUT if cut else 0
    kept = _KEPT.get(initial, {})
    for state, known in enumerate(states):
        if known is None:
            continue
        cost, audit = known
        found[state].append((cost + DELETE, audit, b"D"))
        if not gone:
            if state in kept:
                found[kept[state]].append((cost + KEEP + extra, audit, b"K"))
            found[_NEXT[state]].append((cost + REROLE + extra, audit, b"R"))
    return _useful(inserted([_best(f) for f in found]))


def first_states() -> States:
    return inserted([(0, EMPTY), None, None, None])


def cheapest(states: States) -> tuple[int, Audit]:
    """The cheapest end: nothing at all, or after an assistant turn."""
    return _best([(*states[s], b"") for s in (START, ASSISTANT) if states[s]])


def walk(rows: Iterable[tuple[str, bool, bool]], states: States) -> States:
    for initial, gone, cut in rows:
        states = after(states, initial, gone, cut)
    return states


def repaired(audit: bytes, rows: list[tuple[str, str]], state: int) -> tuple[list[str], int]:
    """The lines that the edits make of (role, text) rows, from ``state`` on, and the state after them."""
    lines, at = [], 0
    for letter in audit.decode():
        if letter == "I":
            state = _NEXT[state]
            lines.append(f"{ROLES[state]}:")
            continue
        role, text = rows[at]
        at += 1
        if letter == "K":
            state = _KEPT[role[:1]][state]
            lines.append(f"{role}:{text}")
        elif letter == "R":
            state = _NEXT[state]
            lines.append(f"{ROLES[state]}:{text}")
    return lines, state
