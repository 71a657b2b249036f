"""Suffix order of a string by induced sorting, with common-prefix values carried along.

The suffixes that start a rising part (S*) are named by their substrings; the string of names is
sorted in the same way, recursively, or by doubling once its alphabet is large. From their order
all other suffixes are induced, first the falling ones in ascending order, then the rising ones in
descending order: a queue with first characters as priorities holds tuples of position and common
prefix with the tuple before. It appends in bulk, keeps a bounded number of bytes in memory and the
rest in a file that vanishes with the task. Common prefixes are exact up to a cap, and the order is
that of the first ``cap`` symbols at least.
"""

from __future__ import annotations

import tempfile

import numpy as np

MEMORY = 256 << 20
LARGE_ALPHABET = 2048


class Queue:
    """FIFO of (position, common prefix) per first character; beyond ``memory`` bytes it goes to disk."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.held, self.file = memory, 0, None
        self.parts: dict[int, list] = {}

    def put(self, c: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.parts.setdefault(c, []).append((pos, lcp))
        self.held += 9 * len(pos)
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # has no name, goes with the process
        self.file.seek(0, 2)
        for parts in self.parts.values():
            for i, part in enumerate(parts):
                if not isinstance(part[0], int):
                    at = self.file.tell()
                    self.file.write(np.ascontiguousarray(part[0], np.int64).tobytes())
                    self.file.write(np.ascontiguousarray(part[1], np.uint8).tobytes())
                    parts[i] = (at, len(part[0]))
        self.held = 0

    def load(self, part: tuple) -> tuple[np.ndarray, np.ndarray]:
        if not isinstance(part[0], int):
            self.held -= 9 * len(part[0])
            return part
        at, n = part
        self.file.seek(at)
        return np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(n), np.uint8)

    def take(self, c: int) -> tuple[np.ndarray, np.ndarray] | None:
        parts = self.parts.pop(c, None)
        if not parts:
            return None
        loaded = [self.load(p) for p in parts]
        return np.concatenate([p for p, _ in loaded]), np.concatenate([q for _, q in loaded])


def range_min(values: np.ndarray):
    """Function (i, j) -> minima of values[i..j], both ends included."""
    table, size = [values], 1
    while 2 * size <= len(values):
        table.append(np.minimum(table[-1][:-size], table[-1][size:]))
        size *= 2

    def ask(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        level = np.frexp((j - i + 1).astype(np.float64))[1] - 1
        out = np.empty(len(i), values.dtype)
        for one in np.unique(level).tolist():
            at = np.flatnonzero(level == one)
            out[at] = np.minimum(table[one][i[at]], table[one][j[at] - (1 << one) + 1])
        return out

    return ask


class Inducer:
    """One pass: takes suffixes in order and hands on those in front of them that have the type."""

    def __init__(self, text: np.ndarray, rising: np.ndarray, want: bool, cap: int, memory: int):
        self.text, self.rising, self.want, self.cap = text, rising, want, cap
        self.queue = Queue(memory)
        symbols = int(text.max()) + 1
        self.pending, self.started = np.full(symbols, 255, np.uint8), np.zeros(symbols, bool)

    def scan(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        before = pos - 1
        at = np.flatnonzero((pos > 0) & (self.rising[before] == self.want))
        lowest = lcp.min()
        if not len(at):
            np.minimum(self.pending, lowest, out=self.pending)
            return
        char = self.text[before[at]]
        order = np.argsort(char, kind="stable")
        at, char = at[order], char[order]
        head = np.concatenate([[True], char[1:] != char[:-1]])
        since = np.concatenate([[0], at[:-1] + 1])
        since[head] = 0
        ask = range_min(lcp)
        least = ask(since, at)
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], len(at))
        chars = char[starts]
        least[starts] = np.minimum(least[starts], self.pending[chars])
        made = np.minimum(least, self.cap - 1) + np.uint8(1)
        made[starts[~self.started[chars]]] = 0
        self.started[chars] = True
        np.minimum(self.pending, lowest, out=self.pending)
        final = at[ends - 1]
        rest = np.full(len(chars), 255, np.uint8)
        open_ = final < len(lcp) - 1
        if open_.any():
            rest[open_] = ask(final[open_] + 1, np.full(int(open_.sum()), len(lcp) - 1))
        self.pending[chars] = rest
        found = before[at]
        for c, i, j in zip(chars.tolist(), starts.tolist(), ends.tolist(), strict=True):
            self.queue.put(c, found[i:j], made[i:j])


def named(text: np.ndarray, rising: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Names of the S* substrings, equal for equal ones and in their order."""
    length = np.append(np.diff(starts) + 1, 1)
    symbol = 2 * text.astype(np.int64) + rising
    bits = int(symbol.max()).bit_length()
    width = max(1, 62 // bits)
    rank, act, off, n = np.zeros(len(starts), np.int64), np.arange(len(starts)), 0, len(text)
    while len(act):
        key = np.zeros(len(act), np.int64)
        for t in range(width):
            inside = off + t < length[act]
            key = (key << bits) | np.where(inside, symbol[np.minimum(starts[act] + off + t, n - 1)], 0)
        order = np.lexsort((key, rank[act]))
        act, key = act[order], key[order]
        old = rank[act]
        group = np.concatenate([[True], old[1:] != old[:-1]])
        part = group | np.concatenate([[True], key[1:] != key[:-1]])
        index = np.arange(len(act))
        in_group = index - index[group][np.cumsum(group) - 1]
        rank[act] = old + in_group[part][np.cumsum(part) - 1]
        off += width
        several = np.diff(np.append(np.flatnonzero(part), len(act))) > 1
        keep = several[np.cumsum(part) - 1] & (length[act] > off)
        act = act[keep]
    return np.unique(rank, return_inverse=True)[1].astype(np.int64)


def doubled(names: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of a string of names by ``depth`` names, and their common prefixes."""
    n = len(names)
    levels, size = [names + 1], 1
    order = np.argsort(names, kind="stable")
    while size < depth:
        after = np.zeros(n, np.int64)
        after[: n - size] = levels[-1][size:]
        key = levels[-1] * (n + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], key[1:] != key[:-1]]))
        levels.append(rank)
        size *= 2
        if rank[order[-1]] == n:
            break
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[inside] = levels[level][a[inside]] == levels[level][b[inside]]
        a[same] += 1 << level
        b[same] += 1 << level
        common[1:][same] += 1 << level
    return order, common


def suffixes(text: np.ndarray, cap: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all suffixes in order, and the common prefix of each with the one before.

    ``text`` holds numbers from 0 and ends with its only 0; ``cap`` is at most 254.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.uint8)
    turns = np.flatnonzero(text[:-1] != text[1:])
    ends = turns[np.searchsorted(turns, np.arange(n - 1))]
    rising = np.append(text[ends] < text[ends + 1], True)
    repeat = np.append(np.minimum(ends - np.arange(n - 1) + 1, cap), 1).astype(np.uint8)
    starts = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    names = named(text, rising, starts)
    count = int(names.max()) + 1
    if count == len(names):
        order, common = np.argsort(names), np.zeros(len(names), np.int64)
    elif count <= LARGE_ALPHABET:
        order, common = suffixes(names, cap, memory)
        common = common.astype(np.int64)
    else:
        order, common = doubled(names, cap)  # a name covers two symbols at least
    # common prefixes in symbols: those of equal names, and what the first different ones share
    a, b = order[:-1], order[1:]
    known = starts[np.minimum(a + common[1:], len(starts) - 1)] - starts[a]
    x, y, active = starts[a] + known, starts[b] + known, np.flatnonzero(known < cap)
    while len(active):
        active = active[(x[active] < n) & (y[active] < n)]
        active = active[text[x[active]] == text[y[active]]]
        known[active] += 1
        x[active] += 1
        y[active] += 1
        active = active[known[active] < cap]
    star = starts[order]
    star_lcp = np.concatenate([[0], np.minimum(known, cap)]).astype(np.uint8)
    star_char = text[star]
    symbols = int(text.max()) + 1
    cut = np.searchsorted(star_char, np.arange(symbols + 1))

    falling: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    pass_ = Inducer(text, rising, False, cap, memory)
    present = np.flatnonzero(np.bincount(text, minlength=symbols)).tolist()
    for c in present:
        found = []
        while (part := pass_.queue.take(c)) is not None:
            found.append(part)
            pass_.scan(*part)
        if found:
            falling[c] = np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found])
        i, j = int(cut[c]), int(cut[c + 1])
        if j > i:
            lcp = star_lcp[i:j].copy()
            lcp[0] = min(repeat[falling[c][0][-1]], repeat[star[i]]) if found else 0
            pass_.scan(star[i:j], lcp)
    pass_ = Inducer(text, rising, True, cap, memory)
    pass_.queue.put(0, np.array([n - 1]), np.zeros(1, np.uint8))
    pass_.started[0] = True
    up: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for c in reversed(present):
        found = []
        while (part := pass_.queue.take(c)) is not None:
            found.append(part)
            pass_.scan(*part)
        if found:
            up[c] = np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found])
        if c in falling:
            pos, lcp = falling[c]
            back = np.empty(len(lcp), np.uint8)
            back[1:] = lcp[:0:-1]
            back[0] = min(repeat[up[c][0][-1]], repeat[pos[-1]]) if found else 0
            pass_.scan(pos[::-1], back)
    positions, prefixes = [], []
    for c in present:
        if c in falling:
            positions.append(falling[c][0])
            prefixes.append(falling[c][1])
        if c in up:
            pos, lcp = up[c]
            ahead = np.empty(len(lcp), np.uint8)
            ahead[1:] = lcp[:0:-1]
            ahead[0] = min(repeat[falling[c][0][-1]], repeat[pos[-1]]) if c in falling else 0
            positions.append(pos[::-1])
            prefixes.append(ahead)
    return np.concatenate(positions), np.concatenate(prefixes)
