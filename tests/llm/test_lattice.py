from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from veladura.llm import lattice, lm, spm
from veladura.llm.common import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
WORDS = ["the", "thorreou", "hetiha", "Élelle", "a", "nterti", "unbelievable", "ciónmente", "schaft", "x" * 70, "strings,", "2024", "don't"]


def model() -> bytes:
    with open(PATH, "rb") as f:
        return f.read()


def as_unigram(data: bytes) -> bytes:
    """The same file with the trainer's model type set to unigram: the library then takes best paths."""

    def number(b, i):
        value = shift = 0
        while True:
            c = b[i]
            i, value, shift = i + 1, value | (c & 127) << shift, shift + 7
            if c < 128:
                return value, i

    def put(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    def fields(b):
        i = 0
        while i < len(b):
            key, i = number(b, i)
            if key & 7 == 0:
                start = i
                _, i = number(b, i)
                yield key, b[start:i]
            elif key & 7 == 2:
                size, i = number(b, i)
                yield key, b[i : i + size]
                i += size
            else:
                size = 4 if key & 7 == 5 else 8
                yield key, b[i : i + size]
                i += size

    write = lambda parts: b"".join(put(k) + (put(len(v)) + v if k & 7 == 2 else v) for k, v in parts)
    return write((k, write((a, b"\1" if a >> 3 == 3 else b) for a, b in fields(v))) if k >> 3 == 2 else (k, v) for k, v in fields(data))


def test_best_paths_equal_the_library():
    library, codec = SentencePieceProcessor(model_proto=as_unigram(model())), spm.Codec(model())
    for word in WORDS:
        own = codec.words(word)
        codec.learn(set(own))
        ids, theirs = np.frombuffer(b"".join(codec.known[w] for w in own), np.uint32).tolist(), library.encode(word)
        total = lambda path: sum(library.get_score(i) for i in path)
        # The library takes a whole word's piece where two pieces score more, which its n-best list shows.
        assert ids == theirs or total(ids) > total(theirs) and ids in library.nbest_encode_as_ids(word, 5)


def test_relations_equal_the_codec(spark):
    codec = spm.Codec(model())
    words = [lattice.SPACE + w for w in WORDS if len(w) < 20]
    codec.learn({w.encode() for w in words})
    got = spm.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), spm.pieces(spark)).collect()
    assert {r.word: r.ids for r in got} == {w: np.frombuffer(codec.known[w.encode()], np.uint32).tolist() for w in words}


def test_round_trip(spark):
    texts = ["", " ", "  a  b ", "日本語 x😀y", "a\n\n b\t", "plain words here", "x y "]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    encoded = spm.encode(frame)
    assert all(r.round_trip for r in encoded.collect())
    assert {r.doc_id: r.text for r in spm.decode(encoded).collect()} == dict(enumerate(texts))
    assert [r.text for r in spm.decode(encoded.select("doc_id", F.lit(None).cast("array<int>").alias("ids")).limit(1)).collect()] == [""]


def segmentations(word: bytes, weight: dict) -> float:
    total = [1.0] + [0.0] * len(word)
    for stop in range(1, len(word) + 1):
        total[stop] = sum(total[start] * weight.get(word[start:stop], 0.0) for start in range(stop))
    return total[-1]


def test_marginals_and_expected_uses():
    table = lattice.PieceTable(model())
    pieces, raw = lm.start_weights(table)
    assert abs(pieces.sum() + raw.sum() - 1) < 1e-9
    weight = collections.defaultdict(float)
    for i in table.normal:
        weight[table.texts[i]] += pieces[i]
    for b in range(256):
        weight[bytes([b])] += raw[b]
    with np.errstate(divide="ignore"):
        log_p, log_byte = np.maximum(np.log(pieces), -1e29), np.log(raw)
    words = [(lattice.SPACE + w).lower().encode() for w in WORDS]
    for places, matrix in lattice.by_length(words, table.longest):
        value = lattice.marginal(table, matrix, log_p, log_byte)
        for i, v in zip(places, value, strict=True):
            assert v == pytest.approx(math.log(segmentations(words[i], weight)), rel=1e-9)
        counts = np.arange(1, len(places) + 1)
        uses, own = lattice.expected(table, matrix, counts, log_p, log_byte)
        # Every segmentation covers each byte of its word once.
        sizes = np.array([len(t) for t in table.texts])
        assert (uses * sizes).sum() + own.sum() == pytest.approx(counts.sum() * matrix.shape[1], rel=1e-9)


def test_scores(spark):
    texts = ["The cat sat on the mat", "the dog", "", None, "zebra zebra", "the cat", "A mat the"] * 6
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in lm.scores(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    tokens = {i: [*(t or "").lower().split(), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = collections.Counter(w for i, words in tokens.items() if not held[i] for w in words)
    n, v = sum(counts.values()), len(counts)
    for i, words in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(words), sum(counts[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert r.score < 0
    assert got[0].score < got[1].score < got[2].score and got[2].score == got[3].score
