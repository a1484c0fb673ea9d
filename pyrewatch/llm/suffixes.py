"""Suffix arrays by induced sorting, and permuted common prefixes, for the text of one shard.

``suffix_array`` classifies suffixes as larger or smaller than their right neighbour, sorts and names the substrings
between leftmost-smaller positions, recurses on the string of names until all are distinct, and induces the whole
array in two linear scans. A scan advances in fronts: all slots up to the first one that is still to be filled are
final, so one numpy step handles them. Over very large alphabets fronts are short and a plain loop is faster.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are scanned in fronts.
FRONT_SYMBOLS = 400_000


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour. The end of the text is smaller than any symbol."""
    n = len(text)
    up = np.zeros(n, bool)
    up[:-1] = text[1:] > text[:-1]
    differs = np.ones(n, bool)
    differs[:-1] = text[1:] != text[:-1]
    decided = np.flatnonzero(differs)
    return np.repeat(up[decided], np.diff(decided, prepend=-1))


def _induce(text: np.ndarray, smaller: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The whole array, from the sorted leftmost-smaller positions."""
    n = len(text)
    array = np.full(n, -1, np.int32 if n < 1 << 31 else np.int64)
    symbols = text[seeds]
    count = np.bincount(symbols, minlength=len(starts))
    first = np.cumsum(count) - count
    array[(ends - count)[symbols] + (np.arange(len(seeds)) - first[symbols])] = seeds
    scan = _scan_fronts if len(starts) <= FRONT_SYMBOLS else _scan_loop
    array = scan(array, text, ~smaller, starts.copy(), True)
    # The seeds only carried the scan of the larger suffixes; all smaller ones are placed from the right.
    array[array >= 0] = np.where(smaller[array[array >= 0]], -1, array[array >= 0])
    return scan(array, text, smaller, ends.copy(), False)


def _scan_loop(array: np.ndarray, text: np.ndarray, wanted: np.ndarray, heads: np.ndarray, up: bool) -> np.ndarray:
    slots, symbols, kind, heads = array.tolist(), text.tolist(), wanted.tobytes(), heads.tolist()
    if up:
        if kind[-1]:
            slots[heads[symbols[-1]]] = len(symbols) - 1
            heads[symbols[-1]] += 1
        for at in range(len(slots)):
            before = slots[at] - 1
            if before >= 0 and kind[before]:
                symbol = symbols[before]
                slots[heads[symbol]] = before
                heads[symbol] += 1
    else:
        for at in range(len(slots) - 1, -1, -1):
            before = slots[at] - 1
            if before >= 0 and kind[before]:
                symbol = symbols[before]
                heads[symbol] -= 1
                slots[heads[symbol]] = before
    return np.array(slots, array.dtype)


def _scan_fronts(array: np.ndarray, text: np.ndarray, wanted: np.ndarray, heads: np.ndarray, up: bool) -> np.ndarray:
    n = len(text)
    due = _due(text, wanted, heads, up)
    if up and wanted[n - 1]:
        # The last suffix is the one that the end of the text induces.
        array[heads[text[n - 1]]] = n - 1
        heads[text[n - 1]] += 1
    at, size = 0 if up else n, 1024
    while at < n if up else at > 0:
        window = slice(at, at + size) if up else slice(max(0, at - size), at)
        block, waiting = array[window], due[window]
        waiting = waiting & (block < 0)
        if not up:
            block, waiting = block[::-1], waiting[::-1]
        stop = int(waiting.argmax())
        if not waiting[stop]:
            stop = len(block)
        before = block[:stop] - 1
        before = before[before >= 0]
        before = before[wanted[before]]
        if len(before):
            symbols = text[before]
            order = symbols.argsort(kind="stable")
            before, symbols = before[order], symbols[order]
            head = np.empty(len(symbols), bool)
            head[0] = True
            np.not_equal(symbols[1:], symbols[:-1], out=head[1:])
            head = head.nonzero()[0]
            count = np.empty(len(head), np.int64)
            count[:-1] = head[1:] - head[:-1]
            count[-1] = len(symbols) - head[-1]
            found = symbols[head]
            place = np.arange(len(symbols))
            if up:
                place += np.repeat(heads[found] - head, count)
                heads[found] += count
            else:
                place = np.repeat(heads[found] - 1 + head, count) - place
                heads[found] -= count
            array[place] = before
        at += stop if up else -stop
        size = min(1 << 18, max(256, stop * 2))
    return array


def _due(text: np.ndarray, wanted: np.ndarray, heads: np.ndarray, up: bool) -> np.ndarray:
    """The slots that a scan fills."""
    count = np.bincount(text[wanted], minlength=len(heads))
    begin = heads if up else heads - count
    marks = np.zeros(len(text) + 1, np.int32)
    some = count > 0
    np.add.at(marks, begin[some], 1)
    np.add.at(marks, (begin + count)[some], -1)
    return np.cumsum(marks[:-1]) > 0


def _names(text: np.ndarray, seeds: np.ndarray, length: np.ndarray, symbols: int) -> np.ndarray:
    """Order-preserving names of the substrings, from 0 without gaps; equal substrings share a name.

    A substring that goes on where another ends is the smaller one (there it holds a larger suffix); only the last one
    ends with the text, before everything. Substrings are compared some symbols at a time, packed into one integer.
    """
    bits = int(symbols + 1).bit_length()
    step = max(1, 63 // bits)
    rank = np.zeros(len(seeds), np.int64)
    live, offset = np.arange(len(seeds)), 0
    top = (1 << bits) - 1
    while len(live):
        key = np.zeros(len(live), np.int64)
        at, left = seeds[live] + offset, length[live] - offset
        for k in range(step):
            inside = left > k
            symbol = np.full(len(live), top, np.int64)
            symbol[inside] = text[at[inside] + k] + np.int64(1)
            key = (key << bits) | symbol
            if not inside.any():
                key <<= bits * (step - 1 - k)
                break
        last = np.flatnonzero(live == len(seeds) - 1)
        if len(last):
            inside = int(max(0, min(step, left[last[0]])))
            key[last] = (key[last] >> (bits * (step - inside))) << (bits * (step - inside))
        order = np.lexsort((key, rank[live])) if offset else key.argsort(kind="stable")
        live, key, base = live[order], key[order], rank[live[order]]
        run = np.ones(len(live), bool)
        run[1:] = base[1:] != base[:-1]
        head = run.copy()
        head[1:] |= key[1:] != key[:-1]
        index = np.arange(len(live))
        run_start = np.maximum.accumulate(np.where(run, index, 0))
        head_start = np.maximum.accumulate(np.where(head, index, 0))
        rank[live] = base + head_start - run_start
        group = np.cumsum(head) - 1
        offset += step
        longest = np.maximum.reduceat(length[live], np.flatnonzero(head))
        count = np.bincount(group)
        live = live[((count > 1) & (longest > offset))[group]]
    return np.unique(rank, return_inverse=True)[1]


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Start positions of all suffixes in order. ``text`` holds integers below ``symbols``."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    counts = np.bincount(text, minlength=symbols)
    ends = np.cumsum(counts)
    starts = ends - counts
    smaller = _types(text)
    left = np.zeros(n, bool)
    left[1:] = smaller[1:] & ~smaller[:-1]
    seeds = np.flatnonzero(left)
    if len(seeds) > 1:
        length = np.diff(seeds, append=n) + 1
        length[-1] -= 1
        names = _names(text, seeds, length, symbols)
        distinct = int(names.max()) + 1
        if distinct < len(seeds):
            seeds = seeds[suffix_array(names, distinct)]
        else:
            seeds = seeds[names.argsort()]
    return _induce(text, smaller, starts, ends, seeds)


def common_prefixes(text: np.ndarray, array: np.ndarray, symbols: int) -> np.ndarray:
    """Length of the prefix that each suffix shares with the one before it in order (0 for the first).

    Only irreducible positions are compared: where the symbols before a suffix and before its predecessor agree, the
    value is one less than at the position before, so the permuted array is a running maximum. Symbols are compared
    several at a time, packed into one integer.
    """
    n = len(array)
    kind = np.int32 if n < 1 << 30 else np.int64
    if n < 2:
        return np.zeros(n, kind)
    bits = int(symbols).bit_length()
    step = 64 // bits
    packed = np.zeros(n + step, np.uint64)
    codes = np.zeros(n + step, np.uint64)
    codes[:n] = text
    codes[:n] += np.uint64(1)
    for k in range(step):
        packed[:n] |= codes[k:k + n] << np.uint64(bits * k)
    previous = np.empty(n, kind)
    previous[array[1:]] = array[:-1]
    previous[array[0]] = -1
    position = np.arange(n, dtype=kind)
    free = np.ones(n, bool)
    index = np.flatnonzero(previous[1:] > 0) + 1
    free[index] = text[index - 1] != text[previous[index] - 1]
    live = np.flatnonzero(free & (previous >= 0)).astype(kind)
    length = np.zeros(n, kind)
    here, other = live, previous[live]
    while len(live):
        differ = packed[here] ^ packed[other]
        same = (np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) // bits).astype(kind)
        same = np.minimum(same, step)
        length[live] += same
        on = np.flatnonzero((same == step) & (np.maximum(here, other) + step < n))
        live, here, other = live[on], here[on] + kind(step), other[on] + kind(step)
    permuted = np.maximum.accumulate(np.where(free, length + position, 0)) - position
    return permuted[array]
