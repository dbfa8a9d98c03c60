"""Words and sums of paths as arrays: the same as word by word, and no batch by itself."""

import numpy as np
import pyarrow as pa

from veladura.llm import lattice, lm
from veladura.llm.common import gathered, tokenizer_path, weighed

TEXTS = ["", " ", "  Ab\tÉa\x0b b\x0cc\r\n", "a\x1cb\x1fc\x85d E f", "x" * 50, "ÑandÚ ñ", "Z\x00z z"]


def table() -> lattice.PieceTable:
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        return lattice.table_of(f.read())


def test_words_are_those_of_the_library():
    words, place = lm.words_of(pa.array(TEXTS))
    expected = [(w.decode(), i) for i, t in enumerate(TEXTS) for w in t.encode().lower().split()]
    assert list(zip(words.to_pylist(), place.tolist(), strict=True)) == expected


def test_parts_lose_no_row():
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(TEXTS)], ["i", "text"])
    parts = list(weighed(iter([batch, batch.slice(0, 0), batch.slice(2, 3)]), 1, 20))
    assert [i for b in parts for i in b.column(0).to_pylist()] == [*range(7), 2, 3, 4]
    assert all(b.num_rows == 1 or sum(len(t.encode()) for t in b.column(1).to_pylist()) <= 20 for b in parts)
    held = list(gathered(iter([batch.slice(k, 1) for k in range(7)] + [batch.slice(0, 0)]), 3))
    assert [b.num_rows for b in held] == [3, 3, 1] and pa.Table.from_batches(held).equals(pa.Table.from_batches([batch]))


def test_pieces_are_found_as_by_search():
    own, rng = table(), np.random.default_rng(1)
    asked = np.concatenate([own.hashes, own.hashes + np.uint64(1), rng.integers(0, 1 << 63, 50_000).astype(np.uint64), [own.empty]])
    at = np.minimum(np.searchsorted(own.hashes, asked), len(own.hashes) - 1)
    expected = np.where(own.hashes[at] == asked, own.ids[at], -1)
    assert (own.find(asked) == expected).all() and (own.find(asked.reshape(-1, 1))[:, 0] == expected).all()


def test_products_equal_sums_of_logs():
    own = table()
    pieces, raw = lm.start_weights(own)
    log_p, log_byte = lm._logs(np.concatenate([pieces, raw]), len(pieces))
    ways = set()
    for rarer in (0, 15, 60):
        for size in (1, 3, 12, 40, 90):
            matrix = np.frombuffer(("el resultado de la universidad ñandú 2024 schaft" * 9)[: 4 * size].encode()[: 4 * size], np.uint8).reshape(4, size)
            counts, bytes_ = np.array([1, 2, 30, 4]), log_byte - rarer
            ways.add(lattice._lift(size, bytes_) is None)
            logs = lattice._forward(lattice._weights(lattice.edges(own, matrix), matrix, log_p, bytes_))[:, -1]
            np.testing.assert_allclose(lattice.marginal(own, matrix, log_p, bytes_), logs, rtol=1e-11)
            for got, known in zip(lattice.expected(own, matrix, counts, log_p, bytes_), lattice._expected_by_logs(own, matrix, counts, log_p, bytes_), strict=True):
                np.testing.assert_allclose(got, known, rtol=1e-9, atol=1e-200)
    assert ways == {True, False}


def test_a_batch_of_words_costs_few_calls(monkeypatch):
    """Rows of several batches are solved together; before, each batch of 10,000 was solved by itself."""
    calls = []
    monkeypatch.setattr(lattice, "_found", lambda t, text, real=lattice._found: calls.append(text.shape) or real(t, text))
    words = [bytes([97 + k % 26]) * 5 for k in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array([w], pa.binary())], ["word"]) for w in words]
    for batch in gathered(iter(batches)):
        lm.word_scores(batch.column(0).to_pylist(), table(), lm.Weights(*lm._logs(np.concatenate(lm.start_weights(table())), len(table().texts)), 0.0))
    assert calls == [(8, 40)]
