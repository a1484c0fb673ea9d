"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

import xxhash

LAST = 1 << 63


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def simhash(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(lowered)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows):
    """Fingerprint and smallest id of the component of each row."""
    prints = [simhash(t) for _, t in rows]
    up = {f: f for f in prints}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    distinct = sorted(up)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                up[root(a)] = root(b)
    least = {}
    for (doc_id, _), f in zip(rows, prints, strict=True):
        if doc_id is not None:
            least[root(f)] = min(least.get(root(f), LAST), doc_id)
    return [(doc_id, f"{f:016x}", least.get(root(f))) for (doc_id, _), f in zip(rows, prints, strict=True)]


def removals(rows, by_word, size=50):
    """Per row the symbols, and which of them are covered by a window of a smaller id."""
    split = [(LAST if i is None else i, words(t) if by_word else (t or "").encode()) for i, t in rows]
    first = {}
    for doc_id, s in split:
        for at in range(len(s) - size + 1):
            w = " ".join(s[at:at + size]) if by_word else s[at:at + size]
            first[w] = min(first.get(w, LAST), doc_id)
    out = []
    for doc_id, s in split:
        gone = [False] * len(s)
        for at in range(len(s) - size + 1):
            w = " ".join(s[at:at + size]) if by_word else s[at:at + size]
            if first[w] < doc_id:
                gone[at:at + size] = [True] * size
        out.append((s, gone))
    return out


def removal_rows(rows, by_word):
    out = []
    for (doc_id, _), (s, gone) in zip(rows, removals(rows, by_word), strict=True):
        kept = " ".join(x for x, g in zip(s, gone, strict=True) if not g).encode() if by_word else bytes(
            x for x, g in zip(s, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc_id, len(s), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def fewest_edits(item, text):
    """Smallest edit distance of ``item`` to any substring of ``text``."""
    before = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (a != b)))
        before = row
    return min(before)


def sort_rows(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))
