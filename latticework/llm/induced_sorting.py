"""Suffix sorting by induction, with queues that go to disk: bucket by bucket, each suffix puts the one before it in the queue of its symbol."""

from __future__ import annotations

import tempfile

import numpy as np

ALPHABET = 6000  #: symbols up to which a level is induced bucket by bucket


class Queues:
    """First-in-first-out queues of integers, one for each symbol; beyond ``room`` bytes in memory they are appended to a scratch file.

    Suffixes enter a symbol's queue in the order of the suffixes after them, so that first in, first out is the order of priority
    (symbol, rank of the rest).
    """

    def __init__(self, room: int):
        self.room, self.used = room, 0
        self.memory: dict[int, list[np.ndarray]] = {}
        self.disk: dict[int, list[tuple[int, int]]] = {}
        self.file = None

    def put(self, symbols: np.ndarray, items: np.ndarray) -> None:
        if not len(items):
            return
        order = np.argsort(symbols.astype(np.uint16), kind="stable")  # ALPHABET symbols at most: a radix sort
        symbols, items = symbols[order], items[order]
        cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        for c, part in zip(symbols[np.r_[0, cuts]].tolist(), np.split(items, cuts)):
            self.memory.setdefault(c, []).append(part)
        self.used += items.nbytes
        if self.used > self.room:
            self.file = self.file or tempfile.TemporaryFile()
            for c, parts in self.memory.items():
                raw = np.concatenate(parts)
                self.disk.setdefault(c, []).append((self.file.seek(0, 2), len(raw)))
                self.file.write(raw.tobytes())
            self.memory, self.used = {}, 0

    def take(self, symbol: int) -> np.ndarray:
        parts = []
        for at, n in self.disk.pop(symbol, ()):
            self.file.seek(at)
            parts.append(np.frombuffer(self.file.read(8 * n), np.int64))
        for part in self.memory.pop(symbol, ()):
            self.used -= part.nbytes
            parts.append(part)
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def kinds(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are smaller than the next one, and the places where such a stretch begins ("leftmost")."""
    step = np.sign(np.diff(t.astype(np.int64)))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    following = np.minimum.accumulate(at[::-1])[::-1]
    small = np.r_[np.r_[step, 1][following] > 0, True]
    return small, np.flatnonzero(small[1:] & ~small[:-1]) + 1


def induce(t: np.ndarray, small: np.ndarray, leftmost: np.ndarray, room: int) -> np.ndarray:
    """All suffixes in order, from the order of the leftmost ones."""
    symbols = np.unique(t).tolist()
    seeds, up = Queues(room), Queues(room)
    seeds.put(t[leftmost], leftmost)
    large: dict[int, np.ndarray] = {}

    def grow(queue: Queues, c: int, first: np.ndarray, want_small: bool) -> np.ndarray:
        out = []
        while len(first):
            out.append(first)
            before = first[first > 0] - 1
            before = before[small[before] == want_small]
            s = t[before]
            same = s == c
            queue.put(s[~same], before[~same])
            first = before[same]
        return np.concatenate(out) if out else first

    for c in symbols:
        large[c] = grow(up, c, up.take(c), False)
        from_seeds = seeds.take(c)
        before = from_seeds[from_seeds > 0] - 1
        up.put(t[before], before)
    down = Queues(room)
    down.put(t[-1:], np.array([len(t) - 1]))  # nothing stands after the end to bring it forth
    parts = []
    for c in reversed(symbols):
        mine = grow(down, c, down.take(c), True)
        before = large[c][::-1]
        before = before[before > 0] - 1
        before = before[small[before]]
        down.put(t[before], before)
        parts.append(np.concatenate([large.pop(c), mine[::-1]]))
    return np.concatenate(parts[::-1])


def doubled(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order by doubling ranks, up to ``depth`` symbols."""
    rank, k = np.unique(t, return_inverse=True)[1].astype(np.int64), 1
    n = len(t)
    while True:
        key = rank * (n + 1) + np.r_[rank[k:] + 1, np.zeros(min(k, n), np.int64)]
        order = np.argsort(key, kind="stable")
        new = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])]
        rank[order] = new
        k *= 2
        if k >= depth or new[-1] == n - 1:
            return order


def suffix_order(t: np.ndarray, depth: int, room: int = 128 << 20) -> np.ndarray:
    """Suffixes of ``t`` in order of their first ``depth`` symbols, at least.

    Leftmost suffixes are sorted by induction on their substrings, which get names in order; if names repeat, the string of names is
    sorted the same way, recursively (with more than ALPHABET names by doubling ranks), and a second induction sorts all. An
    end of text is smaller than any symbol.
    """
    t = np.r_[t.astype(np.int64) + 1, 0]
    small, leftmost = kinds(t)
    leftmost = leftmost[leftmost < len(t) - 1]
    if len(leftmost) < 2:
        return induce(t, small, np.r_[leftmost, len(t) - 1] if small[-1] else leftmost, room)[1:]
    ends = np.r_[leftmost, len(t) - 1]
    rough = induce(t, small, ends, room)
    length = np.zeros(len(t), np.int64)
    length[leftmost] = np.diff(ends) + 1
    ordered = rough[length[rough] > 0]
    base = np.uint64(0xD1342543DE82EF95)
    up = np.cumprod(np.r_[np.uint64(1), np.full(len(t), base)], dtype=np.uint64)
    prefix = np.r_[np.uint64(0), np.cumsum((t.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) * up[:-1], dtype=np.uint64)]
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    ia, ib, n = a[same], b[same], length[a[same]]
    same[same] = (prefix[ia + n] - prefix[ia]) * up[ib - np.minimum(ia, ib)] == (prefix[ib + n] - prefix[ib]) * up[ia - np.minimum(ia, ib)]
    names = np.zeros(len(t), np.int64)
    names[ordered] = np.r_[0, np.cumsum(~same)]
    reduced = names[leftmost]
    if not same.any():
        final = ordered
    elif reduced.max() < ALPHABET:
        final = leftmost[suffix_order(reduced, depth, room)]
    else:
        final = leftmost[doubled(reduced, depth)]
    return induce(t, small, np.r_[len(t) - 1, final], room)[1:]
