"""Removal of every byte covered by a long string that also starts elsewhere, by suffix sorting of shards.

A window is a string of `length` bytes. Of the 200-byte strings inside a window the one of least hash is its anchor;
equal windows have equal anchors, so the windows of one anchor form a region of each text, and equal windows can only
meet in regions of one anchor. This deals the corpus into shards without loss:

1. Regions whose anchor occurs once hold no repeated window. Those whose anchor has several occurrences but one content
   are repeated whole, and so are contents that occur more than once.
2. What is left, one row per distinct content, is shuffled by anchor; a task puts regions together up to SHARD bytes
   and orders their suffixes by induced sorting with disk-backed queues (see induced.py). Neighbours whose common
   prefix reaches `length` form groups; a window in a group of two or more is repeated.
3. An anchor with more than HOT different contents is not sorted in one task: its windows are counted by digest, which
   is the same rule with the whole window as the anchor.

Matches never cross texts: a region lies in one text, and only its windows are asked about.

Rows: every input row gives one row, and repeated rows are repeats of each other; a null text is empty; texts shorter than
the length have nothing removed and can still not be a match; null ids are kept; an empty table gives no rows; other
columns are not read. Digests of contents have 128 bits (anchor and content).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veladura.llm.common import id_and_text, written
from veladura.llm.induced import suffixes

LENGTH, GRAM = 400, 200
CHUNK = 1 << 18
SHARD = 2 << 20
HOT = 4_000
BROADCAST_MARKS = 4_000_000
ODD = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        _POWERS[base] = np.cumprod(p)
    return _POWERS[base][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the string of `gram` bytes at every place."""
    n = len(data)
    inverse = pow(ODD, -1, 1 << 64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(inverse, CHUNK + LENGTH + 1)[:n])])
    h = (sums[gram:] - sums[:-gram]) * _powers(ODD, CHUNK + LENGTH + 1)[: n - gram + 1]
    for _ in range(2):
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def regions_of(text: bytes, length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, int, int]]:
    """(first window, windows, anchor, digest) of a text's regions; every window is in one of them."""
    out, width = [], length - gram + 1
    for begin in range(0, len(text) - length + 1, CHUNK):
        part = text[begin : begin + CHUNK + length - 1]
        h = gram_hashes(np.frombuffer(part, np.uint8), gram)
        n = len(part) - length + 1
        place = np.uint64((1 << 20) - 1)
        key = (h & ~place) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal hashes
        pad = -len(key) % width
        blocks = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & place).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:], [n]])
        for a, b, h64 in zip(first.tolist(), last.tolist(), h[anchor[first]].view(np.int64).tolist(), strict=True):
            digest = hashlib.blake2b(part[a : b - 1 + length], digest_size=8).digest()
            out.append((begin + a, b - a, h64, int.from_bytes(digest, "little", signed=True)))
    return out


def _regions(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                found = [regions_of(t.encode(), length, gram) for t in batch.column(1).to_pylist()]
                each = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                flat = np.array([r for f in found for r in f], np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(each), batch.column(2).take(each), *(pa.array(flat[:, i], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64())))],
                    ["doc_id", "th", "first", "n", "anchor", "digest"],
                )

    return texts.mapInArrow(rows, "doc_id bigint, th bigint, first int, n int, anchor bigint, digest bigint")


def repeated_in_shard(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Which of the places start a string of `length` bytes that starts at another of them too."""
    order, common = suffixes(data, length)
    group = np.cumsum(common < length)
    of_place = np.empty(len(data), np.int64)
    of_place[order] = group
    mine = of_place[places]
    return np.bincount(mine, minlength=int(group[-1]) + 1)[mine] > 1


def _sorted_shards(contents: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, first, last): runs of repeated windows in contents that occur once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, anchor = [], 0, None

        def done() -> pa.RecordBatch:
            data = np.frombuffer(b"".join(r["data"] for r in held), np.uint8)
            starts = np.cumsum([0, *(len(r["data"]) for r in held[:-1])])
            counts = np.array([r["n"] for r in held])
            offsets = np.repeat(np.cumsum(counts) - counts, counts)
            inner = np.arange(counts.sum()) - offsets
            hit = repeated_in_shard(data, np.repeat(starts, counts) + inner, length)
            out, at = [], 0
            for r in held:
                mine = hit[at : at + r["n"]]
                at += r["n"]
                if r["c"] == 1 and mine.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
                    out += [(r["doc_id"], r["th"], r["first"] + int(a), r["first"] + int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]
            columns = list(zip(*out, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "th", "first", "last"])

        for batch in batches:
            for r in batch.to_pylist():
                if size >= SHARD and r["anchor"] != anchor:
                    yield done()
                    held, size = [], 0
                held.append(r)
                size += len(r["data"])
                anchor = r["anchor"]
        if held:
            yield done()

    # Regions of one anchor lie together, so a shard can end after any anchor.
    return contents.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(rows, "doc_id bigint, th bigint, first int, last int")


def _contents(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted regions, one row each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "th", "first", "n", "anchor", "c", "data"]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            out = []
            for ident, th, text, parts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                data = text.encode()
                out += [(ident, th, p["first"], p["n"], p["anchor"], p["c"], data[p["first"] : p["first"] + p["n"] - 1 + length]) for p in parts]
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    found = _with_texts(texts, wanted, "inner").select("doc_id", "th", "text", "parts")
    return found.mapInArrow(rows, "doc_id bigint, th bigint, first int, n int, anchor bigint, c bigint, data binary")


def _with_texts(texts: DataFrame, side: DataFrame, how: str) -> DataFrame:
    """Joins lists per text; they are broadcast up to a stated number of entries of 32 bytes at most."""
    side = written(side, "exactsub-side")
    entries = side.agg(F.sum(F.size("parts") + 1)).head()[0] or 0
    right = side.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "parts")
    return texts.join(F.broadcast(right) if entries <= BROADCAST_MARKS else right, (F.col("th") == F.col("__th")) & F.col("doc_id").eqNullSafe(F.col("__id")), how).drop("__id", "__th")


def _by_digest(contents: DataFrame, length: int) -> DataFrame:
    """Repeated windows of hot anchors, counted by digest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n, data = r["n"], r["data"]
                keys = [hashlib.blake2b(data[i : i + length], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array([r["doc_id"]] * n, pa.int64()), pa.array([r["th"]] * n, pa.int64()), pa.array(range(r["first"], r["first"] + n), pa.int32()), pa.array([r["c"]] * n, pa.int64())],
                    ["key", "doc_id", "th", "first", "c"],
                )

    windows = contents.mapInArrow(rows, "key binary, doc_id bigint, th bigint, first int, c bigint")
    often = windows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    return windows.where("c = 1").join(often, "key").select("doc_id", "th", "first", F.col("first").alias("last"))


def repeated_windows(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, th, first, last): places of windows that start anywhere else too, as runs. texts: (doc_id, text, th)."""
    regions = _regions(texts, length, gram)
    anchors = regions.groupBy("anchor").agg(F.count("*").alias("total"), F.min("digest").alias("low"), F.max("digest").alias("high")).where("total > 1")
    met = written(regions.join(anchors.select("anchor", (F.col("low") != F.col("high")).alias("mixed")), "anchor"), "exactsub-met")
    run = lambda df: df.select("doc_id", "th", "first", (F.col("first") + F.col("n") - 1).alias("last"))
    mixed = met.where("mixed")
    variants = written(mixed.groupBy("anchor", "digest").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "th", "first", "n")).alias("r")).select("anchor", "digest", "c", "r.*"), "exactsub-variants")
    whole = mixed.join(variants.where("c > 1").select("anchor", "digest"), ["anchor", "digest"])
    marks = run(met.where("not mixed")).unionByName(run(whole))
    hot = written(variants.groupBy("anchor").agg(F.count("*").alias("v")).where(F.col("v") > HOT).select("anchor"), "exactsub-hot")
    wanted = variants.groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "n", "anchor", "c")).alias("parts"))
    contents = _contents(texts, wanted, length)
    if hot.isEmpty():
        return marks.unionByName(_sorted_shards(contents, length))
    contents = written(contents, "exactsub-contents")
    return marks.unionByName(_sorted_shards(contents.join(hot, "anchor", "left_anti"), length)).unionByName(_by_digest(contents.join(hot, "anchor"), length))


def kept_parts(size: int, parts: list[tuple[int, int]], length: int) -> tuple[list[tuple[int, int]], int, int]:
    """(kept stretches, removed bytes, removed runs) from runs of repeated windows."""
    kept, removed, spans, at, end = [], 0, 0, 0, -1
    for a, b in sorted(parts):
        b += length
        if a > end:  # a gap of a byte at least, or the first
            if end >= 0:
                at = end
            kept.append((at, a))
            spans += 1
            removed += b - a
            end = b
        elif b > end:
            removed += b - end
            end = b
    kept.append((max(end, 0), size))
    return kept, removed, spans


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): what is left of every text."""
    texts = id_and_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    marks = repeated_windows(texts, length, gram).groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "last")).alias("parts"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                kept, removed, spans = kept_parts(len(data), [(p["first"], p["last"]) for p in parts or []], length)
                out.append((len(data), removed, spans, b"".join(data[a:b] for a, b in kept)))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return _with_texts(texts, marks, "left").select("doc_id", "text", "parts").mapInArrow(rows, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
