"""Ranked lexical search over posting lists with range-maximum tables, best document intervals first.

The index has one row per shard and term: the shard's documents (by place in ascending id order) and the term's
occurrences in each. A search keeps, for every interval of a shard's documents, the sum over the item's terms of the
largest impact that the term's posting list has inside the interval, each answered by a sparse table in two look-ups.
No document inside scores more. The intervals of the highest bounds are taken first: the document of the largest single
impact is scored in full and splits its interval in two, each with a bound of its own. What cannot reach the tenth
document found so far is never opened.

A first round opens a few intervals per item and shard; the tenth best of all shards is a bound that every shard starts
the second, whole round with. It prunes only, the result does not depend on it.

Scores are whole numbers: the weight of a term times (10^9 tf) div (1000 tf + 8 m), m the document's length measure.
A shard holds at most SHARD_TOKENS terms (or one longer document) and SHARD_DOCS documents. Items are searched in blocks
of about BLOCK_TERMS terms, each broadcast; all shards are searched for each block.

Rows: a null text has no terms and is never found; repeated rows are ranked each; a null id comes before all others in
ties; an item without terms (null, empty) has no rows; repeated items are answered each; empty tables give no rows;
other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veladura.llm.common import id_and_text, shipped, written

TOP = 10
SHARD_TOKENS, SHARD_DOCS = 4_000_000, 1 << 16
BLOCK_TERMS = 500_000
OPENED_FIRST = 64
BATCH_CELLS = 1 << 13
NULL_ID = -(2**63)
# Bytes of terms: ASCII digits and letters, lower-cased, and all of other code points; the rest separates.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
INDEX_SCHEMA = "shard bigint, term binary, df bigint, total bigint, docs binary, tfs binary"
# Few rows of a shard's size to a row group, so that readers hold few at a time.
PACKED_OPTIONS = {"compression": "none", "parquet.block.row.count.limit": "2"}


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def _cells(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary cells of the stretches of an array that begin at the starts."""
    data = np.ascontiguousarray(values)
    offsets = (np.append(starts, len(data)) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _shard_batch(shard: int, doc_ids: list[int], lengths: list[int], vocabulary: dict[bytes, int], parts: list[np.ndarray]) -> pa.RecordBatch:
    ids, sizes = np.array(doc_ids, np.int64), np.array(lengths, np.int64)
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    names = sorted(vocabulary)
    rank = np.empty(len(names), np.int64)
    rank[[vocabulary[t] for t in names]] = np.arange(len(names))
    # One key per occurrence, by term and document; equal keys are one posting.
    keys = rank[np.concatenate(parts)] * len(ids) + np.repeat(place, sizes) if parts else np.zeros(0, np.int64)
    keys.sort()
    at = np.flatnonzero(np.diff(keys, prepend=-1))
    tfs = np.diff(at, append=len(keys))
    term, doc = np.divmod(keys[at], len(ids))
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    totals = np.add.reduceat(tfs, starts) if len(starts) else tfs
    # The row of the empty term is the shard's own: ids and lengths of its documents, how many have terms, all terms.
    columns = [
        pa.array(np.full(len(names) + 1, shard)), pa.array([b"", *names], pa.binary()),
        pa.array(np.append(np.count_nonzero(sizes), np.diff(starts, append=len(term)))), pa.array(np.append(sizes.sum(), totals)),
        pa.concat_arrays([_cells(ids[order], np.zeros(1, np.int64)), _cells(doc.astype("<i4"), starts)]), pa.concat_arrays([_cells(sizes[order], np.zeros(1, np.int64)), _cells(tfs.astype("<i4"), starts)]),
    ]
    return pa.RecordBatch.from_arrays(columns, ["shard", "term", "df", "total", "docs", "tfs"])


def posting_lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index rows (shard, term, df, total, docs, tfs) of every document; write them before use, shards are numbered by task."""
    frame = id_and_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    most_tokens, most_docs = SHARD_TOKENS, SHARD_DOCS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 24
        doc_ids, lengths, parts, total = [], [], [], 0
        vocabulary: defaultdict[bytes, int] = defaultdict()
        vocabulary.default_factory = vocabulary.__len__

        def rows() -> Iterator[pa.RecordBatch]:
            batch = _shard_batch(shard, doc_ids, lengths, vocabulary, parts)
            yield from (batch.slice(k, 10_000) for k in range(0, len(batch), 10_000))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms_of(text)
                if doc_ids and (total + len(words) > most_tokens or len(doc_ids) >= most_docs):
                    yield from rows()
                    shard += 1
                    doc_ids, lengths, parts, total = [], [], [], 0
                    vocabulary.clear()
                doc_ids.append(NULL_ID if doc_id is None else doc_id)
                lengths.append(len(words))
                total += len(words)
                if words:
                    parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
        if doc_ids:
            yield from rows()

    return frame.mapInArrow(build, INDEX_SCHEMA)


class Shard:
    """Posting lists of one shard with their impacts and range-maximum tables."""

    def __init__(self, doc_ids: np.ndarray, terms: np.ndarray, starts: np.ndarray, docs: np.ndarray, impacts: np.ndarray):
        self.doc_ids, self.starts, self.docs, self.impacts, self.span = doc_ids, starts, docs, impacts, len(doc_ids) + 1
        self.place = {int(t): i for i, t in enumerate(terms)}
        sizes = np.diff(starts)
        self.keys = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) * self.span + docs
        longest = int(sizes.max(initial=1))
        self.log = np.zeros(longest + 1, np.int8)
        for k in range(1, longest.bit_length()):
            self.log[1 << k :] = k
        # tables[k][i]: place of the largest impact among the 2^k postings from i, the first of equals. Stretches over
        # the end of a list are in the tables too, but no question asks for them.
        n = len(docs)
        self.tables = np.zeros((longest.bit_length(), n), np.int32)
        self.tables[0] = np.arange(n, dtype=np.int32)
        for k in range(1, len(self.tables)):
            left, right = self.tables[k - 1][: n - (1 << k) + 1], self.tables[k - 1][1 << (k - 1) :][: n - (1 << k) + 1]
            self.tables[k][: len(left)] = np.where(impacts[right] > impacts[left], right, left)

    def largest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of the largest impact in [low, high) of a list; any place where that is empty."""
        level = self.log[np.maximum(high - low, 1)]
        width = np.left_shift(1, level.astype(np.int64))
        left, right = self.tables[level, np.minimum(low, len(self.docs) - 1)], self.tables[level, np.maximum(high - width, 0)]
        return np.where(self.impacts[right] > self.impacts[left], right, left)

    def best(self, item: list[tuple[int, int]], bound: tuple[int, int] | None = None, opened: int | None = None, top: int = TOP) -> list[tuple[int, int]]:
        """(score, doc_id) of the first documents for (term, weight) pairs, highest first, ties by id; all not worse than bound.

        opened: ends after so many intervals with what has been found."""
        known = [(self.place[t], w) for t, w in item if t in self.place]
        if not known:
            return []
        rows, weights = np.array([p for p, _ in known]), np.array([w for _, w in known], np.int64)
        base = rows * self.span
        kept: list[tuple[int, int]] = []  # (-score, doc_id), best first
        # What has to be reached: as good as the bound, then better than the last one kept.
        limit = (-bound[0], bound[1]) if bound else (-1, 2**63 - 1)
        count, size = 0, 1

        def measured(first, low, high):
            place = self.largest(low, high)
            values = np.where(high > low, self.impacts[place] * weights, 0)
            split = self.docs[place[np.arange(len(low)), values.argmax(axis=1)]]
            return first, low, high, values.sum(axis=1), split

        open_ = measured(np.zeros(1, np.int64), self.starts[rows][None, :], self.starts[rows + 1][None, :])
        while True:
            # An interval whose bound equals the limit's score matters while an earlier document may be in it.
            full = len(kept) == top
            earliest = self.doc_ids[np.minimum(open_[0], self.span - 2)]
            live = (open_[3] > 0) & ((open_[3] > -limit[0]) | ((open_[3] == -limit[0]) & (earliest < limit[1] if full else earliest <= limit[1])))
            if not live.all():
                open_ = tuple(x[live] for x in open_)
            if not len(open_[0]) or (opened is not None and count >= opened):
                return [(-s, d) for s, d in kept]
            n = len(open_[0])
            if n > size:
                chosen = np.argpartition(-open_[3], size - 1)[:size]
                rest = np.ones(n, bool)
                rest[chosen] = False
                now, later = tuple(x[chosen] for x in open_), tuple(x[rest] for x in open_)
            else:
                now, later = open_, None
            first, low, high, _, split = now
            count += len(first)
            size = min(size * 2, max(1, BATCH_CELLS // len(rows)))
            at = np.searchsorted(self.keys, base + split[:, None])
            safe = np.minimum(at, len(self.docs) - 1)
            hit = (at < high) & (self.docs[safe] == split[:, None])
            scores = np.where(hit, self.impacts[safe] * weights, 0).sum(axis=1)
            for s, d in zip(scores.tolist(), self.doc_ids[split].tolist(), strict=True):
                if s and ((-s, d) < limit if full else (-s, d) <= limit):
                    kept.append((-s, d))
            kept.sort()
            del kept[top:]
            if len(kept) == top:
                limit = kept[-1]
            children = measured(np.concatenate([first, split + 1]), np.concatenate([low, at + hit]), np.concatenate([at, high]))
            open_ = children if later is None else tuple(np.concatenate([a, b]) for a, b in zip(later, children, strict=True))


def _packed(lists: DataFrame, vocabulary: list[bytes], n: int, total: int) -> DataFrame:
    """(shard, doc_ids, terms, starts, docs, impacts): one row per shard, its lists of the vocabulary's terms with their impacts."""
    place = {t: i for i, t in enumerate(vocabulary)}
    shared = lists.sparkSession.sparkContext.broadcast(place)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, current, own, held = shared.value, None, None, []

        def row() -> Iterator[pa.RecordBatch]:
            if not held or own is None:
                return
            doc_ids, lengths = own
            measure = 100 - 90 + (90 * lengths * n) // total
            docs, tfs = np.concatenate([d for _, d, _ in held]), np.concatenate([t for _, _, t in held]).astype(np.int64)
            impacts = (1_000_000_000 * tfs) // (1000 * tfs + 8 * measure[docs])
            starts = np.cumsum([0, *(len(d) for _, d, _ in held)])
            cells = (doc_ids, np.array([t for t, _, _ in held], "<i4"), starts.astype("<i8"), docs, impacts.astype("<i4"))
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in cells)], ["shard", "doc_ids", "terms", "starts", "docs", "impacts"])

        for batch in batches:
            for shard, term, docs, tfs in zip(*(batch.column(k).to_pylist() for k in ("shard", "term", "docs", "tfs")), strict=True):
                if shard != current:
                    yield from row()
                    current, own, held = shard, None, []
                if not term:
                    own = np.frombuffer(docs, "<i8"), np.frombuffer(tfs, "<i8")
                else:
                    held.append((places[term], np.frombuffer(docs, "<i4"), np.frombuffer(tfs, "<i4")))
        yield from row()

    # A shard's own row has the empty term and comes first.
    ordered = lists.select("shard", "term", "docs", "tfs").repartition("shard").sortWithinPartitions("shard", "term")
    return ordered.mapInArrow(pack, "shard bigint, doc_ids binary, terms binary, starts binary, docs binary, impacts binary")


def _searched(packed: DataFrame, items: list[list[tuple[int, int]]], bounds: dict[int, tuple[int, int]] | None = None) -> DataFrame:
    """(slot, doc_id, score): the first documents of each shard for each item; without bounds only those of a first round."""
    shared = packed.sparkSession.sparkContext.broadcast((items, bounds))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, given = shared.value
        for batch in batches:
            for cells in zip(*(batch.column(k) for k in ("doc_ids", "terms", "starts", "docs", "impacts")), strict=True):
                shard = Shard(*(np.array(np.frombuffer(c.as_buffer(), kind)) for c, kind in zip(cells, ("<i8", "<i4", "<i8", "<i4", "<i4"), strict=True)))
                found = [(slot, d, s) for slot, item in enumerate(wanted) for s, d in shard.best(item, given and given.get(slot), None if given is not None else OPENED_FIRST)]
                if found:
                    slots, ids, scores = zip(*found, strict=True)
                    ids = np.array(ids, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(ids, mask=ids == NULL_ID), pa.array(scores, pa.int64())], ["slot", "doc_id", "score"])

    return packed.drop("shard").mapInArrow(search, "slot int, doc_id bigint, score bigint")


def _first(found: DataFrame, top: int = TOP) -> DataFrame:
    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def search(lists: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the TOP documents of a written index for every item."""
    spark = lists.sparkSession
    shipped(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(set(terms_of(t))) for t in batch.column(1).to_pylist()], pa.list_(pa.binary()))], ["item_id", "terms"])

    texts = items.select(F.col(id_col).cast("bigint").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    wanted = written(texts.mapInArrow(cut, "item_id bigint, terms array<binary>").where("size(terms) > 0"), "ranked-items")
    sizes = wanted.agg(F.sum(F.size("terms")).alias("terms")).first().terms or 0
    whole = lists.where(F.length("term") == 0).agg(F.sum("df").alias("n"), F.sum("total").alias("total")).first()
    blocks = math.ceil(sizes / BLOCK_TERMS) if whole.total else 0
    results = None
    for block in range(blocks):
        # About BLOCK_TERMS terms, or those of one longer item.
        rows = wanted.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        every = spark.createDataFrame([(t,) for t in sorted({bytes(t) for r in rows for t in r.terms})], "term binary")
        counts = lists.select("term", "df").join(F.broadcast(every), "term").groupBy("term").agg(F.sum("df").alias("df")).collect()
        # A weight of 0 adds nothing to any score.
        weights = {bytes(r.term): w for r in counts if (w := weight(whole.n, r.df)) > 0}
        vocabulary = sorted(weights)
        known = spark.createDataFrame([(t,) for t in [b"", *vocabulary]], "term binary")
        packed = written(_packed(lists.join(F.broadcast(known), "term"), vocabulary, whole.n, whole.total), "ranked-packed", **PACKED_OPTIONS)
        place = {t: i for i, t in enumerate(vocabulary)}
        asked = [[(place[t], weights[t]) for t in map(bytes, r.terms) if t in place] for r in rows]
        tenth = _first(_searched(packed, asked)).where(F.col("rank") == TOP).collect()
        bounds = {r.slot: (r.score, NULL_ID if r.doc_id is None else r.doc_id) for r in tenth}
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], "slot int, item_id bigint")
        found = written(_first(_searched(packed, asked, bounds)).join(F.broadcast(names), "slot").select("item_id", "rank", "doc_id", "score"), "ranked-found")
        results = found if results is None else results.unionByName(found)
    return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint") if results is None else results


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Indexes all documents and answers every item."""
    return search(written(posting_lists(docs), "ranked-index"), items)
