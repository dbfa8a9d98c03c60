"""Self-join of documents on the Jaccard index of their word shingles, with adaptive multi-match prefixes.

Two documents link when 100 * |a & b| >= 80 * |a | b|. Let p = n - ceil(0.8 n) + 1 for a set of n shingles in one
global order. Linked sets share a shingle among their first p, and for any l at least l shingles when each side takes
its first p + l - 1. So a document may lengthen its prefix when candidates would cost much, and then asks for more
shared shingles before it is verified; of two documents the smaller l counts.

1. Equal sets are one class; its smallest id stands for it.
2. Screen: in hash order each class takes a prefix of its longest l. Classes with fewer than l shingles that occur in
   another prefix (l of the smallest set that may link with it) cannot link and go. It repeats on what is left, and ends when a round drops less than a tenth.
3. Only for the rest, whole sets are built. Order: rare shingles first, then those of at least HEAVY classes, by
   frequency.
   A class whose prefix would make many candidates gets a longer one (the estimate is the sum of list lengths).
   Shingles of no other class bound the overlap: classes and pairs that cannot reach the threshold with the rest go.
4. Pairs of short lists are counted, held against l and verified. Heavy lists are not paired out: the member with the
   fewest rare shingles is compared with the others, links join components, and lists of one component are done, as
   its members need no comparison among themselves. In each further round four times as many members, drawn by hash,
   meet those of other components and leave; a list ends when all its members have met or are joined.
5. Components by smallest label with pointer jumping, each round written to the shared folder.

Nothing is capped: the constants only choose between exact ways. Shingles are compared as 64-bit hashes.

Rows: every input row is a document and gives one row, also where ids repeat or lack (rows then get a key of their own);
a component's id is its smallest, null where none of its documents has one; a null text is empty: no shingles, linked
with nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veladura.llm.bytebpe import _Cache
from veladura.llm.common import fresh, id_and_text, portions, written

WORDS = 5
HEAVY = 24
COSTLY = 8
BROADCAST_IDS = 2_000_000
MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) | 1 for k in range(WORDS)], np.uint64)


def shingles(text: str, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; words are lower-cased in A-Z and cut at ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b"\0".join(words), 1)], np.uint64).view(np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(WORDS):
        mixed = mixed * MULTIPLIERS[k] + (h[k : k + n] ^ (h[k : k + n] >> np.uint64(29)))
        mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed.view(np.int64))


def word_hashes() -> dict:
    return _Cache(xxhash.xxh64_intdigest)


def least_overlap(n):
    """ceil(0.8 n) in whole numbers."""
    return (4 * n + 4) // 5


def screen_length(n):
    """l of the screening prefix."""
    return n // 16 + 1


def prefixes(docs: DataFrame) -> DataFrame:
    """(doc_id, n, digest, head): the set's size, a digest of it, and its first shingles in hash order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in portions(batches):
            sizes, digests, heads = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, hashes)
                n = len(s)
                sizes.append(n)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                heads.append(s[: n - least_overlap(n) + screen_length(n)])
            offsets = np.cumsum([0, *map(len, heads)], dtype=np.int32)
            values = pa.array(np.concatenate([*heads, np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "n", "digest", "head"])

    return docs.mapInArrow(rows, "doc_id bigint, n int, digest binary, head array<bigint>")


def _shared(tokens: DataFrame) -> DataFrame:
    """(doc_id, t, df) of the shingles that more than one of the (doc_id, t) have; their rows meet once, counts and rows are not shuffled apart."""
    return tokens.withColumn("df", F.count("*").over(Window.partitionBy("t"))).where("df > 1")


def screened(heads: DataFrame, classes: DataFrame) -> DataFrame:
    """Ids of the classes that may link at all. heads: (doc_id, head) of these documents and others, classes: (doc_id, n)."""
    kept, count, left = classes, None, classes.count()
    while True:
        tokens = heads.join(_small(kept.select("doc_id"), left), "doc_id", "left_semi").select("doc_id", F.explode("head").alias("t"))
        shared = _shared(tokens).groupBy("doc_id").agg(F.count("*").alias("shared"))
        kept = written(classes.select("doc_id", "n").join(shared, "doc_id").where(F.col("shared") >= F.expr("(4 * n + 4) div 5 div 16 + 1")).select("doc_id"), "jaccard-screen")
        left = kept.count()
        if count is not None and left > 0.9 * count or not left:
            return kept
        # The lists of the classes left are a part of the first ones; a second round is worth it where most go.
        count = left


def _small(ids: DataFrame, n: int) -> DataFrame:
    """Broadcast up to a stated number of ids of 8 bytes; beyond it the optimizer decides."""
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


def whole_sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(doc_id, n, tokens) of the given documents; tokens in hash order. ids: (doc_id, digest)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in portions(batches):
            wanted = batch.column(2).to_pylist()
            sets = [shingles(t, hashes) for t in batch.column(1).to_pylist()]
            same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d for s, d in zip(sets, wanted, strict=True)]
            batch, sets = batch.filter(pa.array(same, pa.bool_())), [s for s, ok in zip(sets, same, strict=True) if ok]
            offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            values = pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "n", "tokens"])

    return docs.join(_small(ids, n), "doc_id").select("doc_id", "text", "digest").mapInArrow(rows, "doc_id bigint, n int, tokens array<bigint>")


def postings(sets: DataFrame) -> DataFrame:
    """(t, doc_id, n, l, s, rare, heavy, left): each class under the shingles of its adaptive prefix, lists of one left out.

    s: the shingles that another class has too. No overlap exceeds it, so classes with s < 0.8 n are left out. left: those
    of them that do not stand before t.
    """
    tokens = sets.select("doc_id", F.explode("tokens").alias("t"))
    known = _shared(tokens).groupBy("doc_id").agg(F.collect_list(F.struct("t", "df")).alias("known"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ident, n, own, known in zip(*(batch.column(k) for k in range(4)), strict=True):
                own = own.values.to_numpy()
                at = np.searchsorted(own, known.values.field("t").to_numpy())
                df = np.ones(len(own), np.int64)
                df[at] = known.values.field("df").to_numpy()
                shared = int((df > 1).sum())
                if 5 * shared < 4 * len(own):
                    continue
                heavy = df >= HEAVY
                # Rare ones in hash order, then heavy ones, the most frequent last.
                order = np.argsort(np.where(heavy, df, 0), kind="stable")
                n = n.as_py()
                first = n - int(least_overlap(n)) + 1
                # Beyond the rare shingles a longer prefix would only add heavy lists.
                longest = max(1, int((~heavy).sum()) - first + 1)
                # Candidates by the list lengths: for each l, the cost of the longer prefix against what the higher
                # number of matches saves, taken as cost / l. The least wins; ties go to the shorter prefix.
                cost = np.cumsum((df - 1)[order])[first - 1 :]
                level = 1 if longest == 1 or cost[0] <= COSTLY else 1 + int(np.argmin(cost[:longest] / np.arange(1, longest + 1)))
                taken = order[: first + level - 1]
                taken = taken[df[taken] > 1]
                # Where a shingle is the first that two classes share, those before it are lost to the overlap.
                left = shared - np.arange(len(taken), dtype=np.int32)
                out.append((ident.as_py(), n, level, shared, int((~heavy).sum()), own[taken], heavy[taken], left))
            sizes = [len(x[5]) for x in out]
            repeat = lambda k, kind: pa.array(np.repeat(np.array([x[k] for x in out], kind), sizes))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([*(x[5] for x in out), np.zeros(0, np.int64)])), repeat(0, np.int64), *(repeat(k, np.int32) for k in (1, 2, 3, 4)),
                    pa.array(np.concatenate([*(x[6] for x in out), np.zeros(0, bool)])), pa.array(np.concatenate([*(x[7] for x in out), np.zeros(0, np.int32)]).astype(np.int32)),
                ],
                ["t", "doc_id", "n", "l", "s", "rare", "heavy", "left"],
            )

    return sets.join(known, "doc_id").select("doc_id", "n", "tokens", "known").mapInArrow(rows, "t bigint, doc_id bigint, n int, l int, s int, rare int, heavy boolean, left int")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose whole sets link."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(k) for k in range(4))
            keep = []
            for u, v in zip(x, y, strict=True):
                u, v = u.values.to_numpy(), v.values.to_numpy()
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= 80 * (len(u) + len(v) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    left = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(rows, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, label): the smallest id reachable, for every id in an edge."""
    both = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "jaccard-edges")
    labels = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "doc_id"), "jaccard-labels")
    while True:
        near = both.join(labels.withColumnRenamed("doc_id", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.doc_id == near.u).select("doc_id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("doc_id").alias("label"), F.col("label").alias("far"))
        after = written(step.join(jump, "label", "left").select("doc_id", "old", F.coalesce(F.least("label", "far"), "label").alias("label")), "jaccard-labels")
        if after.where("old <> label").isEmpty():
            return after.select("doc_id", "label")
        labels = after.select("doc_id", "label")


def _possible():
    """Sizes, and shingles shared with anyone, that allow a link of a and b: 0.8 (na + nb) / 1.8 at least in common."""
    return 9 * F.least("na", "nb", "sa", "sb") >= 4 * (F.col("na") + F.col("nb"))


def linked(sets: DataFrame) -> DataFrame | None:
    """(doc_id, label) of the classes that link with another; None without any."""
    lists = written(postings(sets), "jaccard-postings")
    light, heavy = lists.where("not heavy"), lists.where("heavy")
    one = light.select("t", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"), F.col("l").alias("la"))
    two = light.select("t", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"), F.col("l").alias("lb"))
    # Lists of fewer than HEAVY classes: at most HEAVY / 2 pairs per posting.
    paired = one.join(two, "t").where((F.col("a") < F.col("b")) & _possible()).groupBy("a", "b").agg(F.count("*").alias("c"), F.first("la").alias("la"), F.first("lb").alias("lb"))
    # A class with heavy shingles in its prefix may owe its matches to them, so only their number is left out of l.
    weight = heavy.groupBy("doc_id").agg(F.count("*").alias("h"))
    if heavy.isEmpty():
        candidates = paired.where(F.col("c") >= F.least("la", "lb")).select("a", "b")
    else:
        of = lambda c: weight.select(F.col("doc_id").alias(c), F.col("h").alias(f"h{c}"))
        candidates = paired.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.col("c") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))) >= F.least("la", "lb")).select("a", "b")
    edges = written(verified(candidates, sets), "jaccard-links")
    # In a heavy list only pairs whose first common shingle it is need to meet: the bound is what stands from there on.
    n_edges = edges.count()
    labels = components(edges) if n_edges else None
    members, drawn = written(heavy.select("t", "doc_id", "n", F.col("left").alias("s"), "rare"), "jaccard-heavy"), 0
    while True:
        at = members.withColumn("label", F.col("doc_id")) if labels is None else members.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        lists = at.groupBy("t").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m"), F.min(F.struct("rare", "doc_id"))["doc_id"].alias("centre")).where("low <> high")
        at = written(at.join(lists.select("t", "m", "centre"), "t").withColumn("met", (F.col("doc_id") == F.col("centre")) | (F.pmod(F.xxhash64("doc_id", F.lit(drawn)), F.col("m")) < drawn)), "jaccard-members")
        if at.isEmpty():
            return labels
        x = at.where("met").select("t", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"), F.col("label").alias("la"))
        y = at.select("t", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"), F.col("label").alias("lb"))
        pairs = x.join(y, "t").where((F.col("la") != F.col("lb")) & _possible()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = written(edges.unionByName(verified(pairs, sets)), "jaccard-links")
        if (now := edges.count()) > n_edges:
            n_edges, labels = now, components(edges)
        members, drawn = written(at.where("not met").select("t", "doc_id", "n", "s", "rare"), "jaccard-heavy"), 4 * max(drawn, 1)


def _near(texts: DataFrame) -> DataFrame:
    """(doc_id, n, component) of every row of (doc_id, text); the ids are unique and not null."""
    heads = written(prefixes(texts), "jaccard-heads")
    named = heads.where("n > 0")
    classes = written(named.groupBy("digest").agg(F.min("doc_id").alias("class")), "jaccard-classes")
    # Their heads are not written a second time.
    firsts = named.select("doc_id", "n", "digest").join(classes, (named.doc_id == classes["class"]) & (named.digest == classes.digest), "left_semi")
    firsts = written(firsts, "jaccard-firsts")
    ids = screened(named.select("doc_id", "head"), firsts).join(firsts.select("doc_id", "digest"), "doc_id")
    labels = linked(written(whole_sets(texts, ids, ids.count()), "jaccard-sets"))
    own = heads.select("doc_id", "n", "digest").join(classes, "digest", "left")
    if labels is None:
        found = own.withColumn("label", F.col("class"))
    else:
        found = own.join(labels.withColumnRenamed("doc_id", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    return found.select("doc_id", "n", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("label")).alias("component"))


def _unique(docs: DataFrame, id_col: str) -> bool:
    ids = docs.select(F.col(id_col).cast("bigint").alias("i"))
    return ids.groupBy("i").agg(F.count("*").alias("c")).where("c > 1 or i is null").isEmpty()


def _near_rows(keyed: DataFrame, key: str, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, n, component, first) of rows told apart by a key column: the key of their component, and of its first row by id (rows without one last)."""
    found = _near(id_and_text(keyed, key, text_col)).withColumnRenamed("doc_id", "near_key")
    own = keyed.select(F.col(key).alias("near_key"), F.col(id_col).cast("bigint").alias("doc_id"))
    joined = written(found.join(own, "near_key"), "jaccard-rows")
    firsts = joined.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "near_key")).alias("first"))
    return joined.join(firsts, "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row. Texts of one id, or without one, are documents of their own."""
    if _unique(docs, id_col):
        return _near(id_and_text(docs, id_col, text_col)).select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.col("component").alias("component_id"))
    texts = id_and_text(docs, id_col, text_col)
    keyed = written(texts.withColumn("near_key", F.monotonically_increasing_id()), "jaccard-keyed")
    found = _near_rows(keyed, "near_key", "doc_id", "text")
    return found.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that of the smallest id (one of equal rows; without any id one of the rows), all columns as they were."""
    if _unique(docs, id_col):
        copy = fresh("copy_id", docs.columns)
        found = written(near_duplicates(docs, id_col, text_col), "jaccard-components").where("component_id < doc_id").select(F.col("doc_id").alias(copy))
        return docs.join(found, docs[id_col] == found[copy], "left_anti")
    key, copy = fresh("near_key", docs.columns), fresh("copy_key", docs.columns)
    keyed = written(docs.withColumn(key, F.monotonically_increasing_id()), "jaccard-keyed")
    copies = _near_rows(keyed, key, id_col, text_col).where("near_key <> first.near_key").select(F.col("near_key").alias(copy))
    return keyed.join(copies, keyed[key] == copies[copy], "left_anti").select(*docs.columns)
