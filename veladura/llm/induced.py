"""Suffix order and common prefixes of one shard by induced sorting with disk-backed queues.

The last symbols of the text decide: a suffix is L (larger than the next one) or S (smaller). Sorting the leftmost S
suffixes (S*) orders all others: a scan in ascending order hands each suffix's left neighbour, if L, to the queue of its
first symbol, a descending scan does it for S. Arrivals of one first symbol come in their final order, so the priority
queue over (first symbol, order of arrival) is one first-in-first-out queue per symbol; each keeps a bounded part in
memory and the rest in a file that lives as long as the task. Entries travel as arrays (place, common prefix with the
entry before); the common prefix of two arrivals is one more than the least over the scanned entries between them.

S* substrings get names in order; the string of names is ordered by doubling, which replaces the recursion: as only
the first `depth` symbols count, and two S* places lie two symbols apart at least, log2(depth / 2) rounds do.
Common prefixes are counted up to `depth`.
"""

from __future__ import annotations

import tempfile

import numpy as np

HELD = 1 << 20
FAR = np.int32(1 << 30)


class Queue:
    """First in, first out, of (place, common prefix) arrays; beyond `held` entries the newest go to a file."""

    def __init__(self, held: int = HELD):
        self.held, self.size, self.parts, self.file, self.lengths = held, 0, [], None, []

    def put(self, place: np.ndarray, common: np.ndarray) -> None:
        part = np.stack([place.astype(np.int32), common.astype(np.int32)])
        self.size += part.shape[1]
        if self.file is None and sum(p.shape[1] for p in self.parts) + part.shape[1] <= self.held:
            self.parts.append(part)
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.write(part.tobytes())
        self.lengths.append(part.shape[1])

    def get(self) -> np.ndarray | None:
        """What came since the last call, oldest first; memory first, as the file only holds later arrivals."""
        parts, self.parts = self.parts, []
        if self.file is not None:
            self.file.seek(0)
            parts += [np.frombuffer(self.file.read(8 * n), np.int32).reshape(2, n) for n in self.lengths]
            self.file.close()
            self.file, self.lengths = None, []
        return np.concatenate(parts, axis=1) if parts else None


def least_between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """min(values[first..last]) per pair, by a table of spans of powers of two; no entries: FAR."""
    out = np.full(len(first), FAR, np.int32)
    width = last - first + 1
    level, size, row = np.where(width > 0, np.log2(np.maximum(width, 1)).astype(np.int64), -1), 1, values
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(row[first[at]], row[last[at] - size + 1])
        if len(row) > size:
            row = np.minimum(row[:-size], row[size:])
        size *= 2
    return out


class _Scan:
    """Hands left neighbours of scanned suffixes on and follows the least common prefix per first symbol."""

    def __init__(self, text, wanted, symbols: int, depth: int):
        self.text, self.wanted, self.depth = text, wanted, depth
        self.queues = [Queue() for _ in range(symbols)]
        self.pending = np.full(symbols, -1, np.int32)  # least common prefix since the last arrival; -1: none yet

    def feed(self, place: np.ndarray, common: np.ndarray) -> None:
        if not len(place):
            return
        k = np.flatnonzero(place > 0)
        k = k[self.wanted[place[k] - 1]]
        symbol = self.text[place[k] - 1].astype(np.int64)
        order = np.argsort(symbol, kind="stable")
        k, symbol = k[order], symbol[order]
        if not len(k):
            self.pending = np.minimum(self.pending, common.min())
            return
        new = np.concatenate([[True], symbol[1:] != symbol[:-1]])
        before = np.concatenate([[-1], k[:-1]])
        value = least_between(common, np.where(new, 0, before + 1), k)
        value[new] = np.minimum(value[new], self.pending[symbol[new]])
        value = np.minimum(np.maximum(value, -1) + 1, self.depth)
        self.pending = np.minimum(self.pending, common.min())
        starts = np.flatnonzero(new)
        for a, b in zip(starts, [*starts[1:], len(k)], strict=True):
            s = int(symbol[a])
            self.queues[s].put(place[k[a:b]] - 1, value[a:b])
            rest = common[k[b - 1] + 1 :]
            self.pending[s] = rest.min() if len(rest) else FAR


def _sorted_stars(text: np.ndarray, stars: np.ndarray, depth: int) -> np.ndarray:
    """S* places in the order of their suffixes' first `depth` symbols. text ends in its single least symbol, 0."""
    ends = np.concatenate([stars[1:], [len(text) - 1]])
    lengths = ends - stars + 1
    longest = int(lengths.max())
    padded = np.concatenate([text.astype(np.uint64), np.zeros(4, np.uint64)])
    name = np.zeros(len(stars), np.int64)
    # Names by four symbols a round. Where one substring is a prefix of another, the shorter one is larger (its last
    # symbol is S, the other's L): it is padded high.
    active = np.arange(len(stars))
    for at in range(0, longest, 4):
        key = np.zeros(len(active), np.uint64)
        for j in range(4):
            inside = at + j < lengths[active]
            key = key << np.uint64(16) | np.where(inside, padded[np.minimum(stars[active] + at + j, len(padded) - 1)], np.uint64(0xFFFF))
        order = np.lexsort((key, name[active]))
        a, n, q = active[order], name[active][order], key[order]
        new = np.concatenate([[True], n[1:] != n[:-1]])
        split = new | np.concatenate([[True], q[1:] != q[:-1]])
        group = np.flatnonzero(new)
        inside = np.arange(len(a)) - np.repeat(group, np.diff([*group, len(a)]))
        first = np.maximum.accumulate(np.where(split, np.arange(len(a)), 0))
        name[a] = n + inside[first]
        sizes = np.diff([*np.flatnonzero(split), len(a)])
        goes_on = lengths[a] > at + 4
        # Members that end here stay beside longer ones of their group; those are smaller, so the ended move up.
        more = np.add.reduceat(goes_on.astype(np.int64), np.flatnonzero(split))
        ended = ~goes_on
        name[a[ended]] += np.repeat(more, sizes)[ended]
        active = a[goes_on & np.repeat(more > 1, sizes)]
        if not len(active):
            break
    # Doubling over the string of names.
    rank, step = name, 1
    while step < depth:
        ahead = np.concatenate([rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64)])[: len(rank)]
        order = np.lexsort((ahead, rank))
        split = np.concatenate([[True], (rank[order][1:] != rank[order][:-1]) | (ahead[order][1:] != ahead[order][:-1])])
        if split.all():
            return stars[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.maximum.accumulate(np.where(split, np.arange(len(order)), 0))
        step *= 2
    return stars[np.argsort(rank, kind="stable")]


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b, up to depth; eight symbols a round."""
    padded = np.concatenate([text, np.full(depth + 8, 0xFFFF, text.dtype)])
    out, live = np.zeros(len(a), np.int32), np.arange(len(a))
    for at in range(0, depth, 8):
        x = padded[a[live][:, None] + at + np.arange(8)] == padded[b[live][:, None] + at + np.arange(8)]
        same = np.where(x.all(axis=1), 8, np.argmin(x, axis=1))
        out[live] += same.astype(np.int32)
        live = live[same == 8]
        if not len(live):
            break
    return np.minimum(out, depth)


def suffixes(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in suffix order, common prefix with the one before): equal beyond `depth` symbols counts as equal."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    text = np.concatenate([data.astype(np.uint16) + 1, np.zeros(1, np.uint16)])
    symbols = 257
    change = np.flatnonzero(text[1:] != text[:-1])  # a run ends there
    until = change[np.searchsorted(change, np.arange(n))]
    is_s = np.concatenate([text[until] < text[until + 1], [True]])
    run = np.concatenate([until - np.arange(n) + 1, [1]]).astype(np.int32)
    stars = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    stars = _sorted_stars(text, stars, depth)  # the end itself is the first of them
    common = np.concatenate([[0], _common(text, stars[:-1], stars[1:], depth)]).astype(np.int32)
    bounds = np.searchsorted(text[stars], np.arange(symbols + 1))

    def joint(x: np.ndarray, y: np.ndarray) -> int:
        """Common prefix of the last L and the first S of a symbol: their runs part them."""
        return int(min(run[x], run[y], depth))

    scan, large = _Scan(text, ~is_s, symbols, depth), []
    for c in range(symbols):
        parts = []
        while (part := scan.queues[c].get()) is not None:
            place, value = part[0], part[1].copy()
            parts.append((place, value))
            scan.feed(place, value)
        mine = (np.concatenate([p for p, _ in parts]), np.concatenate([v for _, v in parts])) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int32))
        large.append(mine)
        a, b = bounds[c], bounds[c + 1]
        if b > a:
            value = common[a:b].copy()
            value[0] = joint(mine[0][-1], stars[a]) if len(mine[0]) else 0
            scan.feed(stars[a:b], value)
    scan, out, shared = _Scan(text, is_s, symbols, depth), [], []
    for c in reversed(range(symbols)):
        parts = []
        while (part := scan.queues[c].get()) is not None:
            parts.append((part[0], part[1].copy()))
            scan.feed(*parts[-1])
        small = (np.concatenate([p for p, _ in parts]), np.concatenate([v for _, v in parts])) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int32))
        place, value = large[c]
        if len(place):
            down = np.concatenate([value[1:], [0]])[::-1].astype(np.int32)
            down[0] = joint(place[-1], small[0][-1]) if len(small[0]) else 0
            scan.feed(place[::-1], down)
        # Ascending order of the symbol: L, then S; a descending entry's value belongs to the one after it.
        s_place = small[0][::-1]
        s_value = np.concatenate([[joint(place[-1], s_place[0]) if len(place) and len(s_place) else 0], small[1][::-1][:-1]])[: len(s_place)]
        out.append(np.concatenate([place, s_place]))
        shared.append(np.concatenate([value, s_value]))
    return np.concatenate(out[::-1]).astype(np.int32), np.concatenate(shared[::-1]).astype(np.int32)
