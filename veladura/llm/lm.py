"""Language-model scores of documents: a subword lattice summed over all segmentations, beside a word base line.

A text is words and one end. Each word, led by the space sign, is a lattice of vocabulary pieces and single bytes; the
probability of a word is the sum over its segmentations (forward recursion in log space), that of a text the product
over its words times that of the end. As only first pieces hold the space sign, the pieces of all words and the end
form one distribution over texts.

Weights: the vocabulary's own scores are the start (a merge-rank table, scores 0, -1, -2 ..., is read by Zipf's law as
1 / (rank + 1)); expectation-maximisation over the distinct training words with their counts then re-weights every
piece, so the model learns from all training texts. The counts of the expected pieces are bounded by the vocabulary.

Base line: sum over tokens of log10((c + 1) / (N + V + 1)) over training counts. Words that make at least one token in
FREQUENT (so at most FREQUENT words, a proven bound) are solved once and sent to the tasks with their counts; all others
go, as postings, to where their counts are, and are solved there.

Rows: every input row gives one row; a null text is empty and has its end only; repeated rows repeat; a null id counts
by the text 'null' for the split; without training rows every count is 0 and the vocabulary's weights stay; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veladura.llm.common import crc_of_id, gathered, id_and_text, tokenizer_path, weighed, written
from veladura.llm.lattice import SPACE, PieceTable, by_length, expected, marginal, table_of

SIGN = SPACE.encode()
FREQUENT = 100_000
PRIOR = 1_000.0
ROUNDS = 2


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, lower-cased in A-Z and cut at ASCII white space, and the place of each one's text."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, place = cut.flatten(), pc.list_parent_indices(cut).to_numpy()
    # White space at either end of a text leaves an empty string.
    some = pc.binary_length(words).to_numpy() > 0
    return (words, place) if some.all() else (words.filter(pa.array(some)), place[some])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in weighed(batches, 0):
            counts = pc.value_counts(words_of(batch.column(0))[0])
            yield pa.RecordBatch.from_arrays([counts.field("values").cast(pa.binary()), counts.field("counts").cast(pa.int64())], ["word", "c"])

    return texts.select("text").mapInArrow(rows, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Weights:
    """Log probabilities of pieces, bytes and the end."""

    def __init__(self, log_p: np.ndarray, log_byte: np.ndarray, log_end: float):
        self.log_p, self.log_byte, self.log_end = log_p, log_byte, log_end


def start_weights(table: PieceTable) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the vocabulary before learning: pieces, then bytes at the weight of the rarest piece."""
    scores = table.scores[table.normal]
    sane = np.maximum(scores, scores[scores > -1e8].min() - 1)
    ranks = sane <= 0
    # Log probabilities sum to about one; merge ranks do not.
    p = np.exp(sane) if abs(np.exp(np.clip(sane, -700, 0)).sum() - 1) < 0.05 else 1 / (1 - np.where(ranks, sane, 0))
    pieces = np.zeros(len(table.scores))
    pieces[table.normal] = p
    raw = np.full(256, p.min())
    return pieces / (pieces.sum() + raw.sum()), raw / (pieces.sum() + raw.sum())


def learn(counts: DataFrame, n_texts: int, model, rounds: int = ROUNDS, prior: float = PRIOR) -> Weights:
    """Expectation-maximisation over all words. model: the broadcast vocabulary file."""
    pieces, raw = start_weights(table_of(model.value))
    first = np.concatenate([pieces, raw])
    size, end = len(pieces), 0.05
    uses = first * (1 - end)
    for _ in range(rounds):
        log_p, log_byte = _logs(uses, size)

        def rows(batches: Iterator[pa.RecordBatch], log_p=log_p, log_byte=log_byte) -> Iterator[pa.RecordBatch]:
            own, total = table_of(model.value), np.zeros(size + 256)
            for batch in gathered(batches):
                words, c = [SIGN + w for w in batch.column(0).to_pylist()], batch.column(1).to_numpy()
                for places, matrix in by_length(words, own.longest):
                    total += np.concatenate(expected(own, matrix, c[places], log_p, log_byte))
            ids = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids])], ["id", "uses"])

        got = counts.mapInArrow(rows, "id bigint, uses double").groupBy("id").agg(F.sum("uses").alias("uses")).toPandas()
        uses = prior * first
        uses[got["id"]] += got["uses"]
        end = (n_texts + 1) / (uses.sum() + n_texts + 1)
        uses *= (1 - end) / uses.sum()
    return Weights(*_logs(uses, size), float(np.log(end)))


def _logs(p: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(divide="ignore"):
        x = np.maximum(np.log(p), -1e29)
    return x[:size], x[size:]


def word_scores(words: list[bytes], table: PieceTable, weights: Weights) -> np.ndarray:
    """Log10 probability of every word."""
    values = np.zeros(len(words))
    for places, matrix in by_length([SIGN + w for w in words], table.longest):
        values[places] = marginal(table, matrix, weights.log_p, weights.log_byte) / np.log(10)
    return values


def _frequent(counts: DataFrame, n: int, model, shared) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words that make one token in FREQUENT, at most so many, with the log10 of their count and one and their log10 probability."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(model.value)
        for batch in batches:
            yield batch.append_column("p", pa.array(word_scores(batch.column(0).to_pylist(), table, shared.value)))

    solved = counts.where(F.col("c") * FREQUENT >= n).mapInArrow(solve, "word binary, c bigint, p double")
    found = solved.collect()
    return [bytes(r.word).decode() for r in found], np.log10(np.array([r.c for r in found], float) + 1), np.array([r.p for r in found], float)


SCORED = "key bigint, doc_id bigint, held_out boolean, n bigint, known bigint, base double, score double, word binary, keys array<bigint>"


def _scan(texts: DataFrame, shared) -> DataFrame:
    """Two kinds of rows: documents with what frequent words give, and rare words with the keys of their documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_end, (frequent, x, p) = shared.value
        end, frequent = log_end / np.log(10), pa.array(frequent, pa.string())
        key = TaskContext.get().partitionId() << 36
        names = [x.split(" ")[0] for x in SCORED.split(", ")]
        none = lambda n, kind: pa.nulls(n, kind)
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for batch in weighed(batches, 1):
            words, place = words_of(batch.column(1))
            found = pc.index_in(words, value_set=frequent.cast(words.type))
            met = found.is_valid().to_numpy(zero_copy_only=False)
            at, of, m = found.drop_null().to_numpy(), place[met], batch.num_rows
            total = lambda v, of=of, m=m: pa.array(np.bincount(of, v[at] if len(at) else None, m).astype(float))  # noqa: E731, B023
            n, known = np.bincount(place, minlength=m) + 1, np.bincount(of, minlength=m)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(key, key + m)), batch.column(0), batch.column(2), pa.array(n), pa.array(known), total(x), pc.add(total(p), end), none(m, pa.binary()), none(m, pa.list_(pa.int64()))], names
            )
            rare = words.filter(pa.array(~met)).dictionary_encode()
            codes, r = rare.indices.to_numpy(), len(rare.dictionary)
            keys = key + place[~met][np.argsort(codes, kind="stable")]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *np.bincount(codes, minlength=r)], dtype=np.int32), pa.array(keys, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(none(r, t) for t in kinds), rare.dictionary.cast(pa.binary()), lists], names)
            key += m

    return texts.mapInArrow(rows, SCORED)


def _rare(postings: DataFrame, model, shared) -> DataFrame:
    """(key, x, m, p) summed over a document's rare words: logarithms of counts, words with one, log10 probabilities.

    postings: (word, keys, c) by word, so that the rows of a word are neighbours; each is solved once a batch.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(model.value)
        for batch in gathered(batches):
            words = batch.column(0).dictionary_encode()
            p = word_scores(words.dictionary.to_pylist(), table, shared.value)[words.indices.to_numpy()]
            lists, c = batch.column(1), batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            keys, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            counted = c.is_valid().to_numpy(zero_copy_only=False)
            x = np.log10(c.fill_null(0).to_numpy() + 1.0)
            total = lambda v: np.bincount(place, np.repeat(v, sizes), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total(x)), pa.array(total(counted).astype(np.int64)), pa.array(total(p))], ["key", "x", "m", "p"])

    return postings.mapInArrow(rows, "key bigint, x double, m bigint, p double").groupBy("key").agg(*(F.sum(k).alias(k) for k in ("x", "m", "p")))


def scores(docs: DataFrame, path: str | None = None, modulus: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); rows of the held-out remainder teach nothing."""
    spark = docs.sparkSession
    with open(path or tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    texts = id_and_text(docs, id_col, text_col).withColumn("held_out", crc_of_id(modulus) == held)
    train = texts.where("not held_out")
    counts = written(word_counts(train), "lm-counts")
    ends = train.count()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
    n, v = total + ends, distinct + (ends > 0)
    weights = learn(counts, ends, model)
    shared = spark.sparkContext.broadcast(weights)
    frequent = _frequent(counts, n, model, shared)
    scanned = written(_scan(texts, spark.sparkContext.broadcast((weights.log_end, frequent))), "lm-scanned")
    postings = scanned.where("word is not null").select("word", "keys").join(counts, "word", "left")
    rows = scanned.where("word is null").drop("word", "keys").join(_rare(postings, model, shared), "key", "left")
    end_base, end_known = float(np.log10(ends + 1)), int(ends > 0)
    return rows.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("m", F.lit(0)) + end_known).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("x", F.lit(0.0)) + end_base - F.col("n") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (F.col("score") + F.coalesce("p", F.lit(0.0))).alias("score"),
    )
