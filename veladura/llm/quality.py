"""Document quality by Bradley-Terry ranking: scores learned from preference pairs, cut at a quantile.

A document of label 1 is preferred to one of label 0. The score is linear in features of the whole text; its weights
minimise the logistic loss on feature differences of pairs. The cut is the quantile of the scores that equals the
share of label 0 among the labels; scores are mapped to 0..1 so that the cut falls on a given value.

Features come from the text alone. Labels are learned from a sample of at most max_labelled documents (half per
label, by hash of the id), a stated bound; the label share is counted over all labels.

Rows: every input row gets one score, an empty or null text too (its features are those of no words); repeated rows
repeat; without labels of both kinds every score is 1; null labels are left out; other columns are not read by score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veladura.llm.common import crc_of_id, id_and_text, portions, shipped

MAX_LABELLED = 20_000
PAIRS_PER_DOCUMENT = 8
UPPER, LOWER, DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
SIGNS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
PROSE_SIGNS = [ord(c) for c in ".,;:'\"()-"]


def features(text: str) -> list[float]:
    data = text.encode()
    n = max(len(data), 1)
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = text.split()
    m = max(len(words), 1)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    signs = int(byte[SIGNS].sum())
    prose = int(byte[PROSE_SIGNS].sum())
    upper, lower = int(byte[UPPER].sum()), int(byte[LOWER].sum())
    top = max(counts.values(), default=0)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        np.log1p(len(text)), signs / n, (signs - prose) / n, (signs - prose) / m, prose / m, byte[33] / m, byte[124] / m,
        upper / max(upper + lower, 1), byte[DIGIT].sum() / n, byte[128:].sum() / n, lengths.mean(), lengths.std(), lengths.max() / n,
        np.log(len(counts) + 1) / np.log(m + 1.5), len(counts) / m, top / m, pairs / m, sum(v == 1 for v in counts.values()) / m,
        len(set(lines)) / len(lines), np.log1p(m / len(lines)), (len(data) - sum(map(len, lines))) / n, float(np.mean(lengths <= 2)), float(np.mean(lengths >= 12)), float(not words), sum(map(str.__eq__, words, words[1:])) / m,
    ]


def _wide(x: np.ndarray) -> np.ndarray:
    """Features and their squares: a quality may be spoiled by too little as by too much."""
    return np.concatenate([x, x * x], axis=-1)


class Ranking:
    """Weights of the standardised features, and the line that maps a raw score to a logit."""

    def __init__(self, mean, spread, weights, slope: float, offset: float):
        self.mean, self.spread, self.weights, self.slope, self.offset = mean, spread, weights, slope, offset

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _wide(np.clip((x - self.mean) / self.spread, -6, 6)) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.offset, -40, 40)))


CONSTANT = Ranking(np.zeros(1), np.ones(1), np.zeros(2), 0.0, 40.0)


def fit_pairs(good: np.ndarray, bad: np.ndarray, bad_share: float, cut_at: float, penalty: float = 1e-3, steps: int = 60) -> Ranking:
    """Newton steps on the logistic loss of feature differences; good, bad: features of the two labels."""
    if not len(good) or not len(bad):
        return CONSTANT
    both = np.concatenate([good, bad])
    mean, spread = both.mean(axis=0), both.std(axis=0) + 1e-9
    a, b = (_wide(np.clip((x - mean) / spread, -6, 6)) for x in (good, bad))
    k = np.arange(max(len(a), len(b)) * PAIRS_PER_DOCUMENT)
    # Every document meets PAIRS_PER_DOCUMENT others, dealt by two coprime strides.
    rng = np.random.default_rng(7)
    d = a[rng.permutation(len(k)) % len(a)] - b[k % len(b)]
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        gradient = -(d * p[:, None]).mean(axis=0) + penalty * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    raw = np.concatenate([a @ w, b @ w])
    weight = np.concatenate([np.full(len(a), (1 - bad_share) / len(a)), np.full(len(b), bad_share / len(b))])
    order = np.argsort(raw, kind="stable")
    below = np.cumsum(weight[order])
    at = int(np.searchsorted(below, bad_share - 1e-12))
    cut = (raw[order[at]] + raw[order[min(at + 1, len(raw) - 1)]]) / 2
    slope = 4 / max(float(np.median(a @ w) - np.median(b @ w)), 1e-9)
    return Ranking(mean, spread, w, slope, float(np.log(cut_at / (1 - cut_at)) - slope * cut))


def _measured(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in portions(batches):
        x = np.array([features(t or "") for t in batch.column(column).to_pylist()], float)
        yield batch, x


def fit(docs: DataFrame, labels: DataFrame, train, label_col: str = "quality", cut_at: float = 0.3, max_labelled: int = MAX_LABELLED) -> Ranking:
    """Learns from labelled rows of docs for which the condition train holds."""
    spark = docs.sparkSession
    frame = id_and_text(docs).where(train)
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").where(train).groupBy("doc_id").agg(F.max("y").alias("y"))
    present = marked.join(frame.select("doc_id").distinct(), "doc_id", "left_semi")
    shares = {r.y: r["count"] for r in present.groupBy("y").count().collect()}
    if len(shares) < 2:
        return CONSTANT
    half = max_labelled // 2
    drawn = [present.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half) for y in (0, 1)]
    sample = drawn[0].unionByName(drawn[1])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _measured(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    # At most max_labelled rows of 12 bytes: a proven bound for the broadcast.
    taken = frame.join(F.broadcast(sample), "doc_id").mapInArrow(rows, "doc_id bigint, y int, x array<double>")
    got = sorted((r.doc_id, r.y, r.x) for r in taken.collect())
    x, y = np.array([r[2] for r in got]), np.array([r[1] for r in got])
    return fit_pairs(x[y == 1], x[y == 0], shares[0] / (shares[0] + shares[1]), cut_at)


def score(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _measured(batches, 1):
            s = model.scores(x) if model.slope else np.ones(len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(rows, "doc_id bigint, score double")


def keep_good(docs: DataFrame, model: Ranking, cut_at: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows whose score reaches the cut, all columns as they were."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _measured(batches, batches_column):
            if model.slope and len(x):
                batch = batch.filter(pa.array(model.scores(x) >= cut_at))
            yield batch

    shipped(docs.sparkSession)
    batches_column = docs.columns.index(text_col)
    return docs.mapInArrow(rows, docs.schema)


def held_out(modulus: int = 5):
    return crc_of_id(modulus) == 0
