"""Piece lattices of many words at once: substrings exploded, joined to the piece table, folded position by position.

Inside a task, the distinct words of a batch are a matrix of UTF-8 bytes per length. Their substrings, up to the
longest piece, are hashed at once (explode), looked up in the sorted hashes of the piece table (equi-join), and lie in
an array word x start x length (group by word). Viterbi, forward and backward passes fold it along the start.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SPACE = "▁"
BASE = np.uint64(0x100000001B3)
MIX = np.uint64(0x9E3779B97F4A7C15)
CELLS = 3_000_000
NO = -1e30
# Largest exponent, either way, of the products that stand for sums of paths.
RANGE = 680.0


def _hash(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * int(BASE) + b + 1) & (1 << 64) - 1
    return h


class PieceTable:
    """Pieces of a sentencepiece file: text pieces, byte pieces, and the scores as the file has them."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_proto=model)
        n = library.get_piece_size()
        self.unknown = library.unk_id()
        self.texts: list[bytes] = [b""] * n  # what an id decodes to
        self.byte_id = np.full(256, self.unknown, np.int64)
        self.scores = np.array([library.get_score(i) for i in range(n)])
        normal = []
        for i in range(n):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_id[b] = i
                self.texts[i] = bytes([b])
            elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
                self.texts[i] = piece.encode()
                normal.append(i)
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {piece!r} crosses words")
        hashes = np.array([_hash(self.texts[i]) for i in normal], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(normal)[order]
        if len(np.unique(self.hashes)) < len(self.hashes):
            raise ValueError("two pieces of one hash")
        self._place()
        self.sizes = np.array([len(t) for t in self.texts])
        self.longest = max(len(self.texts[i]) for i in normal)
        self.lowest = float(self.scores[normal].min())
        self.normal = np.array(normal)

    def _place(self) -> None:
        """Slots of the hashes, eight to a piece at least; a taken one sends to the next. No piece has the hash of an empty slot."""
        bits = max(10, int(8 * len(self.hashes) - 1).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        taken = set(self.hashes.tolist())
        empty = next(k for k in range(len(taken) + 1) if k not in taken)
        self.slots, self.slot_ids = np.full(1 << bits, empty, np.uint64), np.full(1 << bits, -1, np.int32)
        self.empty = np.uint64(empty)
        at, left = ((self.hashes * MIX) >> self.shift).astype(np.int64), np.arange(len(self.hashes))
        while len(left):
            slot, one = np.unique(at[left], return_index=True)
            one = left[one[self.slot_ids[slot] < 0]]
            self.slots[at[one]], self.slot_ids[at[one]] = self.hashes[one], self.ids[one]
            left = np.setdiff1d(left, one)
            at[left] = (at[left] + 1) & self.last

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces of these hashes, -1 where there is none."""
        at = ((hashes * MIX) >> self.shift).astype(np.int64)
        met = self.slots[at]
        same = met == hashes
        ids = np.where(same, self.slot_ids[at], np.int32(-1))
        left = np.nonzero(~same & (met != self.empty))
        wanted, at = hashes[left], at[left]
        while len(at):
            at = (at + 1) & self.last
            met = self.slots[at]
            same = met == wanted
            ids[tuple(x[same] for x in left)] = self.slot_ids[at[same]]
            on = ~same & (met != self.empty)
            left, wanted, at = tuple(x[on] for x in left), wanted[on], at[on]
        return ids


@lru_cache(maxsize=1)
def table_of(model: bytes) -> PieceTable:
    """The table of a file; the tasks of one worker read it once."""
    return PieceTable(model)


def by_length(words: list[bytes], longest: int):
    """(places in the list, byte matrix) of words of one length, in parts of bounded size."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        if len(group) and (n := int(lengths[group[0]])):
            size = max(1, CELLS // (n * min(n, longest)))
            for k in range(0, len(group), size):
                part = group[k : k + size]
                yield part, np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), n)


def _found(table: PieceTable, text: np.ndarray) -> list[np.ndarray]:
    """Piece id, or -1, per (start, word) of the substrings of each length from 1. text: bytes per (place, word)."""
    n, b = text.shape
    h = np.zeros((n + 1, b), np.uint64)
    for i in range(n):
        h[i + 1] = h[i] * BASE + text[i] + np.uint64(1)
    return [table.find(h[size:] - h[: n + 1 - size] * np.uint64(pow(int(BASE), size, 1 << 64))) for size in range(1, min(n, table.longest) + 1)]


def edges(table: PieceTable, matrix: np.ndarray) -> np.ndarray:
    """Piece id, or -1, per (word, start, length - 1) of the substrings of all words."""
    b, n = matrix.shape
    found = np.full((b, n, min(n, table.longest)), -1, np.int32)
    for k, ids in enumerate(_found(table, np.ascontiguousarray(matrix.T))):
        found[:, : n - k, k] = ids.T
    return found


def viterbi(table: PieceTable, matrix: np.ndarray) -> list[np.ndarray]:
    """Ids of the best path of every word. A character without a piece of its own has an edge for an unknown one,
    at the lowest score less 10; in the ids it stands as its bytes. Of equal paths the one with the longer last piece wins."""
    b, n = matrix.shape
    found = edges(table, matrix)
    weight = np.where(found >= 0, table.scores[found], NO)
    lead = (matrix & 0xC0) != 0x80
    width = 1 + (matrix >= 0xC0).astype(np.int64) + (matrix >= 0xE0) + (matrix >= 0xF0)
    longest = found.shape[2]
    for size in range(1, min(4, longest) + 1):
        alone = lead & (width == size) & (found[:, :, size - 1] < 0)
        weight[:, :, size - 1][alone] = table.lowest - 10
    best = np.full((b, n + 1), NO)
    best[:, 0] = 0
    back = np.zeros((b, n + 1), np.int64)
    for stop in range(1, n + 1):
        sizes = np.arange(min(stop, longest), 0, -1)
        value = best[:, stop - sizes] + weight[:, stop - sizes, sizes - 1]
        pick = value.argmax(axis=1)
        best[:, stop] = value[np.arange(b), pick]
        back[:, stop] = sizes[pick]
    out = []
    for w in range(b):
        ids, stop = [], n
        while stop:
            size = int(back[w, stop])
            piece = found[w, stop - size, size - 1]
            ids += [piece] if piece >= 0 else table.byte_id[matrix[w, stop - size : stop]][::-1].tolist()
            stop -= size
        out.append(np.array(ids[::-1], np.uint32))
    return out


def _weights(found: np.ndarray, matrix: np.ndarray, log_p: np.ndarray, log_byte: np.ndarray) -> np.ndarray:
    weight = np.where(found >= 0, log_p[found], NO)
    weight[:, :, 0] = np.logaddexp(weight[:, :, 0], log_byte[matrix])
    return weight


def _forward(weight: np.ndarray) -> np.ndarray:
    b, n, longest = weight.shape
    alpha = np.full((b, n + 1), NO)
    alpha[:, 0] = 0
    for stop in range(1, n + 1):
        sizes = np.arange(1, min(stop, longest) + 1)
        alpha[:, stop] = _log_sum(alpha[:, stop - sizes] + weight[:, stop - sizes, sizes - 1])
    return alpha


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


def _lift(n: int, log_byte: np.ndarray) -> float | None:
    """What each byte of a word of n bytes adds to the logarithms, so that no sum of its paths leaves the range of a double:
    the path of single bytes is no less than the rarest byte to the n, and paths of equally many pieces sum to 1 at most. None if that is too long."""
    lift = -float(log_byte.min()) / 2
    return lift if lift * n + np.log(n) <= RANGE else None


def _products(table: PieceTable, matrix: np.ndarray, log_p: np.ndarray, log_byte: np.ndarray, lift: float):
    """Ids, byte weights and all weights, each per (start, word) by length, with the sums of paths to every place."""
    n, b = matrix.shape[1], matrix.shape[0]
    text = np.ascontiguousarray(matrix.T)
    found = _found(table, text)
    # The last one is what id -1, no piece, takes.
    weights = np.append(np.exp(np.minimum(log_p + lift * table.sizes, RANGE)), 0.0)
    single = np.exp(log_byte + lift)[text]
    pieces = [weights[ids] for ids in found]
    alpha = np.zeros((n + 1, b))
    alpha[0] = 1
    for stop in range(1, n + 1):
        alpha[stop] = single[stop - 1] * alpha[stop - 1]
        for size in range(1, min(stop, len(pieces)) + 1):
            alpha[stop] += pieces[size - 1][stop - size] * alpha[stop - size]
    return text, found, single, pieces, alpha


def marginal(table: PieceTable, matrix: np.ndarray, log_p: np.ndarray, log_byte: np.ndarray) -> np.ndarray:
    """Log of the summed weight of all segmentations of every word; every byte also has a piece of its own."""
    n = matrix.shape[1]
    if (lift := _lift(n, log_byte)) is None:
        return _forward(_weights(edges(table, matrix), matrix, log_p, log_byte))[:, -1]
    return np.log(_products(table, matrix, log_p, log_byte, lift)[-1][n]) - lift * n


def expected(table: PieceTable, matrix: np.ndarray, counts: np.ndarray, log_p: np.ndarray, log_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected uses of every piece and every byte piece in words that occur counts times."""
    b, n = matrix.shape
    if (lift := _lift(n, log_byte)) is None:
        return _expected_by_logs(table, matrix, counts, log_p, log_byte)
    text, found, single, pieces, alpha = _products(table, matrix, log_p, log_byte, lift)
    beta = np.zeros((n + 1, b))
    beta[n] = 1
    for start in range(n - 1, -1, -1):
        beta[start] = single[start] * beta[start + 1]
        for size in range(1, min(n - start, len(pieces)) + 1):
            beta[start] += pieces[size - 1][start] * beta[start + size]
    scale = counts / alpha[n]
    uses, raw = np.zeros(len(log_p)), np.zeros(256)
    for size in range(1, len(pieces) + 1):
        ids, both = found[size - 1], alpha[: n + 1 - size] * beta[size:] * scale
        hit = np.nonzero(ids >= 0)
        uses += np.bincount(ids[hit], both[hit] * pieces[size - 1][hit], len(log_p))
        if size == 1:
            raw += np.bincount(text.ravel(), (both * single).ravel(), 256)
    return uses, raw


def _expected_by_logs(table: PieceTable, matrix: np.ndarray, counts: np.ndarray, log_p: np.ndarray, log_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for words that are too long for products."""
    found = edges(table, matrix)
    weight = _weights(found, matrix, log_p, log_byte)
    alpha = _forward(weight)
    b, n, longest = weight.shape
    beta = np.full((b, n + 1), NO)
    beta[:, n] = 0
    for start in range(n - 1, -1, -1):
        sizes = np.arange(1, min(n - start, longest) + 1)
        beta[:, start] = _log_sum(weight[:, start, sizes - 1] + beta[:, start + sizes])
    scale = np.log(counts) - alpha[:, n]
    pieces, raw = np.zeros(len(log_p)), np.zeros(256)
    for size in range(1, longest + 1):
        both = alpha[:, : n + 1 - size] + beta[:, size:] + scale[:, None]
        ids = found[:, : n + 1 - size, size - 1]
        hit = ids >= 0
        pieces += np.bincount(ids[hit], np.exp(both[hit] + log_p[ids[hit]]), len(log_p))
        if size == 1:
            raw += np.bincount(matrix.ravel(), np.exp(both + log_byte[matrix]).ravel(), 256)
    return pieces, raw
