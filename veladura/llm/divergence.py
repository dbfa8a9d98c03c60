"""Source divergence audit by count cells: how the terms of each (lang, source) group are used otherwise than elsewhere.

A term's share p in a group depends on its count there alone, and its divergence f from the lang on (group count, lang
count) alone. So terms are grouped into cells by those two counts and f is evaluated once per cell. Cells of equal f
are merged to one value, values are ranked by the number of terms before them, and only the values that reach the first
TOP ranks are expanded to terms, in UTF-8 order. For pairs of groups, sums over the terms that one group has and the
other lacks come from the cells (group count, number of terms) too; only terms that both have meet in a join.

Texts are cut into terms that a task counts in bounded arrays, by one sort. It hands its counts on as columns, one batch
per part of the terms (by hash), so that a shuffle moves few rows and a term of any frequency is few entries per task and
group; the parts are summed, and terms of too few documents left out, where they arrive. What is kept, (lang, source, term, count) rows,
goes through joins, groupings and windows. Integer arithmetic throughout; the products are decimals of 31 digits.

Rows: a null text, lang or source is ''; a group of documents without terms takes part with counts 0; repeated rows
count as documents of their own; an empty table gives no rows; other columns are not read. A lang that keeps no term has
pairs of value 0 and no terms. A group that is alone in its lang has no pairs.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veladura.llm.common import shipped, written

LEAST_DOCS = 30
TOP = 50
# Terms with repeats that a task holds at a time (or one longer text), about 30 bytes each, and rows of counts that are
# summed when so many have come together, about 60.
HELD, SUMMED = 4_000_000, 2_000_000
# Bytes of terms: ASCII letters, lower-cased, and all of other code points; the rest separates.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
# group: place in the batch's own list of (lang, source); n, docs: occurrences and documents.
COUNTS = pa.schema([("group", pa.int32()), ("term", pa.binary()), ("n", pa.int32()), ("docs", pa.int32())])
KEPT_SCHEMA = "lang string, source string, term binary, n bigint, lang_n bigint, first boolean"


def part_counts(docs: DataFrame, parts: int, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(part, groups, data): occurrences and documents of the terms of one part in every group, summed within a task.

    groups: lang and source in turn; data: a batch of COUNTS.
    """
    shipped(docs.sparkSession)
    frame = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang_col), ("source", source_col))), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    held_most = HELD

    def rows(groups: dict[tuple[str, str], int], of_doc: list[int], lengths: list[int], vocabulary: dict[bytes, int], cut: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The counts of some documents: of_doc and lengths are their groups and numbers of terms."""
        if not cut:
            return
        # Documents in the order of their groups, so that one sort by (term, document) also brings a term's groups together.
        of_doc, many = np.array(of_doc, np.int64), len(of_doc)
        order = np.argsort(of_doc, kind="stable")
        place = np.empty(many, np.int64)
        place[order] = np.arange(many)
        keys = np.concatenate(cut) * np.int64(many) + np.repeat(place, lengths)
        keys.sort()
        at = np.flatnonzero(np.diff(keys, prepend=-1))
        term, doc = np.divmod(keys[at], many)
        group = of_doc[order][doc]
        first = np.flatnonzero(np.diff(term * len(groups) + group, prepend=-1))
        n, in_docs, term, group = np.add.reduceat(np.diff(at, append=len(keys)), first), np.diff(first, append=len(term)), term[first], group[first]
        terms = pa.array(list(vocabulary), pa.binary())
        part = (np.fromiter(map(zlib.crc32, vocabulary), np.int64, len(vocabulary)) % parts)[term]
        order = np.argsort(part, kind="stable")
        columns = [pa.array(group[order].astype(np.int32)), terms.take(pa.array(term[order])), pa.array(n[order].astype(np.int32)), pa.array(in_docs[order].astype(np.int32))]
        listed = pa.RecordBatch.from_arrays(columns, schema=COUNTS)
        starts = np.flatnonzero(np.diff(part[order], prepend=-1))
        names = [x for g in groups for x in g]
        for a, b in zip(starts, np.append(starts[1:], len(part)), strict=True):
            data = pa.concat_batches([listed.slice(a, b - a)]).serialize().to_pybytes()
            yield pa.RecordBatch.from_arrays([pa.array([part[order[a]]], pa.int32()), pa.array([names], pa.list_(pa.string())), pa.array([data], pa.binary())], ["part", "groups", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        of_doc, lengths, cut, size = [], [], [], 0
        vocabulary: defaultdict[bytes, int] = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if words := text.translate(LETTERS).split():
                    if size and size + len(words) > held_most:
                        yield from rows(groups, of_doc, lengths, vocabulary, cut)
                        groups, of_doc, lengths, cut, size = {}, [], [], [], 0
                        vocabulary.clear()
                    of_doc.append(groups.setdefault((lang, source), len(groups)))
                    lengths.append(len(words))
                    cut.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
                    size += len(words)
        yield from rows(groups, of_doc, lengths, vocabulary, cut)

    return frame.mapInArrow(count, "part int, groups array<string>, data binary")


class Summed:
    """Counts of one part of the terms, as columns that are summed whenever they have doubled."""

    def __init__(self, most: int):
        self.most = self.full = most
        self.places: dict[tuple[str, str], int] = {}
        self.parts: list[pa.Table] = []
        self.rows = 0

    def add(self, groups: list[str], data: bytes) -> None:
        own = np.array([self.places.setdefault(g, len(self.places)) for g in zip(groups[::2], groups[1::2], strict=True)], np.int32)
        batch = pa.ipc.read_record_batch(pa.py_buffer(data), COUNTS)
        columns = [pa.array(own[batch.column(0).to_numpy()]), batch.column(1), *(batch.column(k).cast(pa.int64()) for k in (2, 3))]
        self.parts.append(pa.table(columns, COUNTS.names))
        self.rows += batch.num_rows
        if self.rows >= self.full:
            self.sum()
            self.full = max(self.most, 2 * self.rows)

    def sum(self) -> pa.Table:
        summed = pa.concat_tables(self.parts).group_by(["group", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        whole = pa.table([summed[c] for c in ("group", "term", "n_sum", "docs_sum")], COUNTS.names)
        self.parts, self.rows = [whole], whole.num_rows
        return whole

    def kept(self, least: int) -> Iterator[pa.RecordBatch]:
        """Rows of the terms that enough documents of a lang hold."""
        whole = self.sum().combine_chunks()
        langs, of_group = np.unique([g[0] for g in self.places], return_inverse=True)
        sources = [g[1] for g in self.places]
        group, terms = whole["group"].to_numpy(), whole["term"].combine_chunks().dictionary_encode()
        key = of_group[group] * len(terms.dictionary) + terms.indices.to_numpy()
        _, first, place = np.unique(key, return_index=True, return_inverse=True)
        n = whole["n"].to_numpy()
        lang_docs, lang_n = np.zeros((2, len(first)), np.int64)
        np.add.at(lang_docs, place, whole["docs"].to_numpy())
        np.add.at(lang_n, place, n)
        is_first = np.zeros(len(key), bool)
        is_first[first] = True
        kept = np.flatnonzero(lang_docs[place] >= least)
        for k in range(0, len(kept), 50_000):
            some = kept[k : k + 50_000]
            columns = [
                pa.array(langs[of_group[group[some]]], pa.string()), pa.array([sources[g] for g in group[some]], pa.string()), terms.take(pa.array(some)).dictionary_decode(),
                pa.array(n[some]), pa.array(lang_n[place[some]]), pa.array(is_first[some]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "lang_n", "first"])


def kept_counts(parts: DataFrame, n_parts: int, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of the kept terms; first: on one row of each (lang, term)."""
    most = SUMMED

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, Summed(most)
        for batch in batches:
            for at, groups, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != part and held.parts:
                    yield from held.kept(least_docs)
                    held = Summed(most)
                part = at
                held.add(groups, data)
        if held.parts:
            yield from held.kept(least_docs)

    return parts.repartitionById(n_parts, "part").sortWithinPartitions("part").mapInArrow(add, KEPT_SCHEMA)


def share(count: str, total: str, terms: str = "v") -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)), exactly."""
    return F.expr(f"1 + (CAST(1000000000 AS DECIMAL(10,0)) * CAST({count} + 5 AS DECIMAL(20,0))) DIV CAST({total} + 5 * {terms} AS DECIMAL(20,0))")


def group_sizes(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, size, own, lang_size, v, zero) of every group: occurrences and number of its kept terms, those of the lang, share of count 0."""
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_size"), F.count_if("first").alias("v"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("own"))
    both = groups.join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").fillna(0, ["lang_size", "v", "size", "own"])
    return both.withColumn("zero", F.when(F.col("v") > 0, share("0", "size")).otherwise(F.lit(0)))


def top_terms(kept: DataFrame, sizes: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the first terms of each group that it uses more than its lang does."""
    cells = kept.groupBy("lang", "source", "n", "lang_n").agg(F.count("*").alias("times")).join(sizes, ["lang", "source"])
    valued = cells.withColumn("value", share("n", "size") - share("lang_n", "lang_size")).where("value > 0").select("lang", "source", "n", "lang_n", "times", "value")
    merged = valued.groupBy("lang", "source", "value").agg(F.sum("times").alias("times"))
    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # Each value stands for a term at least, so the first TOP values hold the first TOP terms.
    first = merged.withColumn("at", F.row_number().over(falling)).where(F.col("at") <= top)
    before = F.coalesce(F.sum("times").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = first.withColumn("before", before).where(F.col("before") < top).select("lang", "source", "value", "before")
    chosen = valued.join(reached, ["lang", "source", "value"]).select("lang", "source", "n", "lang_n", "value", "before")
    within = Window.partitionBy("lang", "source", "value").orderBy("term")
    ranked = kept.join(chosen, ["lang", "source", "n", "lang_n"]).withColumn("at", F.row_number().over(within)).where(F.col("at") <= top)
    return ranked.withColumn("rank", F.col("before") + F.col("at")).where(F.col("rank") <= top).select("lang", "source", F.col("term").cast("string").alias("item"), "value", "rank")


def pair_divergence(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank) of every two groups of a lang: item is the other source.

    The sum over all kept terms is: each group's terms against the other's share of count 0, terms of neither, and for
    the terms of both a correction from the join on (lang, term).
    """
    shares = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("times")).join(sizes, ["lang", "source"]).select("lang", "source", "n", "times", "zero", share("n", "size").alias("p"))
    other = sizes.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"), F.col("own").alias("item_own"))
    single = shares.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("times") * F.abs(F.col("p") - F.col("item_zero"))).alias("alone"))
    terms = kept.join(shares.select("lang", "source", "n", "p", "zero"), ["lang", "source", "n"]).select("lang", "term", "source", "p", "zero")
    met = terms.alias("x").join(terms.alias("y"), ["lang", "term"]).where("x.source < y.source")
    fix = F.expr("abs(x.p - y.p) - abs(x.p - y.zero) - abs(y.p - x.zero) + abs(x.zero - y.zero)")
    half = met.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b")).agg(F.sum(fix).alias("both"))
    both = half.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "both").unionByName(half.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "both"))
    back = single.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col("alone").alias("back"))
    pairs = sizes.join(other, "lang").where("source <> item")
    for part in (single, back, both):
        pairs = pairs.join(part, ["lang", "source", "item"], "left")
    pairs = pairs.fillna(0, ["alone", "back", "both"])
    value = F.expr("alone + back + both + (v - own - item_own) * abs(zero - item_zero)")
    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.withColumn("value", value).withColumn("rank", F.row_number().over(falling)).select("lang", "source", "item", "value", "rank")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` against every other source of the lang, part `term` the first terms."""
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang_col), ("source", source_col)))).distinct()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = written(kept_counts(part_counts(docs, parts, lang_col, source_col, text_col), parts, least_docs), "divergence-kept")
    sizes = written(group_sizes(groups, kept), "divergence-sizes")
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("bigint").alias("value"), F.col("rank").cast("int").alias("rank"))
    return named(pair_divergence(kept, sizes), "pair").unionByName(named(top_terms(kept, sizes, top), "term"))
