from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from veladura.llm import tokencount, wavelet
from veladura.llm.bytebpe import ByteBpe, prove_whole_tokens
from veladura.llm.common import tokenizer_path

SIGNS = [" ", " ", "\n", "\t", "a", "b", "'s", "'", "É", "1", "²", "ⅷ", "x", "!", "<|endoftext|>", " ", "\x1c", "中", "е", "̀", "😀", "\x85", "​", "𞤀", " the", "ing"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def texts():
    draw = random.Random(4)
    return ["".join(draw.choice(SIGNS) for _ in range(draw.randint(0, 14))) for _ in range(3000)]


def test_equals_the_library(library):
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        source = f.read()
    bpe = ByteBpe(source, prove_whole_tokens(source))
    for text in texts():
        wanted = library.encode(text, add_special_tokens=False).ids
        assert bpe.count(text) == len(wanted) and bpe.id_bytes(text) == np.array(wanted, "<u4").tobytes()


def test_proof_holds_for_every_string(library):
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        proven = prove_whole_tokens(f.read())
    assert len(proven) > 49_000
    for text, ident in list(proven.items())[::97]:
        assert library.encode(text, add_special_tokens=False).ids == [ident]


def test_counts_and_files(spark, library):
    rows = [(10 * i, t) for i, t in enumerate(texts()[:200])]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in rows}
    assert {r.doc_id: r.n_tokens for r in tokencount.token_counts(frame).collect()} == {i: len(x) - 1 for i, x in ids.items()}
    got = sorted(wavelet.round_trip(frame, shards=3).collect())
    assert [tuple(r) for r in got] == [(i, sum(len(ids[j]) for j, _ in rows if j < i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids.items()]


def test_sentencepiece_counts(spark):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rows = list(enumerate(texts()[:100]))
    got = tokencount.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string"), tokenizer_path("piece_bpe_32k.model")).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(library.encode(t)) for i, t in rows}


@pytest.mark.parametrize("n", [1, 7, 511, 512, 513, 2000])
def test_wavelet_matrix(n):
    draw = random.Random(n)
    ids = np.array([draw.choice([0, 5, 5, 7, 50256, draw.randrange(65536)]) for _ in range(n)], np.uint16)
    names, lengths = np.array([-5]), np.array([n])
    a, b, matrix = wavelet.from_file(wavelet.to_file(names, lengths, wavelet.WaveletMatrix.build(ids, 16)))
    assert a.tolist() == [-5] and b.tolist() == [n] and (matrix.all_ids() == ids).all()
    assert [matrix.access(i) for i in range(0, n, 3)] == ids[::3].tolist()
    for value in (0, 5, 7, 9, 50256):
        assert matrix.occurrences(value) == np.flatnonzero(ids == value).tolist()
        assert matrix.rank(value, n // 2) == int((ids[: n // 2] == value).sum())


def test_many_texts_at_once(library, monkeypatch):
    """Ids of texts cut together, plain ones and others side by side, whatever the chunks; a slice of a longer array."""
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        source = f.read()
    bpe = ByteBpe(source, prove_whole_tokens(source))
    draw = random.Random(6)
    plain = ["a", "Ze", "é", "ŋ", "1", "23", " ", "  ", "\n", "\t", "\r", "'", "'s", "'re", "'ve", "'ll", "'d", "'l", ".", "...", "_", " word", "ion\n"]
    some = ["", *("".join(draw.choices(plain if draw.random() < 0.7 else plain + SIGNS + ["×", "ɐ", "\x00"], k=draw.randint(0, 25))) for _ in range(3000)), ""]
    wanted = [library.encode(t, add_special_tokens=False).ids for t in some]
    for size in (1, 60, 1000, 8 << 20):
        monkeypatch.setattr("veladura.llm.bytebpe.CHUNK_BYTES", size)
        assert [x.tolist() for x in bpe.ids_of(pa.array(["x", *some]).slice(1))] == wanted


def test_words_before_signs(library):
    """Words before signs and line ends are merged once, not once for each of what follows them."""
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        source = f.read()
    bpe = ByteBpe(source, prove_whole_tokens(source))
    texts = [f" onntshansh{sign} x{i}" for i, sign in enumerate([".", ",", "!", "\n", ".\n", "?", ";", ":"])]
    assert [x.tolist() for x in bpe.ids_of(pa.array(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert bpe.merged == 1
