"""The pipeline's Python workers hold a few texts at a time, whatever the size of a batch, and lose no row."""

import numpy as np
import pyarrow as pa
import pytest

from veladura.llm import jaccard, quality, secrets, spm
from veladura.llm.common import ROWS_HELD, portions, tokenizer_path

N = 2 * ROWS_HELD + 7
TEXTS = [None if i % 50 == 0 else f"doc {i} password = abcdefghijkl{i} ñandú" for i in range(N)]
BATCH = pa.RecordBatch.from_arrays([pa.array(range(N), pa.int64()), pa.array(TEXTS)], ["doc_id", "text"])
FILLED = BATCH.set_column(1, "text", pa.array([t or "" for t in TEXTS]))


class Frame:
    """Stands for a DataFrame: gives the function that the tasks would run."""

    sparkSession, schema, columns = None, None, ["doc_id", "text"]

    def mapInArrow(self, rows, schema):  # noqa: N802
        return rows


def test_portions_hold_all_rows():
    empty = BATCH.slice(0, 0)
    assert [b.num_rows for b in portions(iter([BATCH, empty, BATCH.slice(3, 2)]))] == [ROWS_HELD, ROWS_HELD, 7, 2]
    assert pa.Table.from_batches(portions(iter([BATCH]))).equals(pa.Table.from_batches([BATCH]))


@pytest.mark.parametrize("stage", ["quality", "jaccard", "secrets", "spm"])
def test_stages_hold_a_few_texts(stage, monkeypatch):
    for module in (quality, secrets):
        monkeypatch.setattr(module, "shipped", lambda spark: None)
    if stage == "quality":
        model = quality.Ranking(0, 1, None, 1.0, 0.0)
        model.scores = lambda x: np.ones(len(x))
        rows, given = quality.keep_good(Frame(), model), BATCH
    elif stage == "jaccard":
        rows, given = jaccard.prefixes(Frame()), FILLED
    elif stage == "secrets":
        rows, given = secrets.redact(Frame()), BATCH
    else:
        with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
            model = f.read()
        rows, given = (lambda batches: spm._encoded(batches, model, True)), FILLED
    found = list(rows(iter([given])))
    assert max(b.num_rows for b in found) <= ROWS_HELD
    assert [i for b in found for i in b.column(0).to_pylist()] == list(range(N))
