"""Token counts by the whole-token shortcut (byte-level BPE files) or the piece library (.model files).

Rows: every input row gives one row; repeated rows repeat; a null text is empty and counts no token; an empty
table gives an empty result; other columns are not read. Texts of any length are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veladura.llm.bytebpe import loaded, prove_whole_tokens
from veladura.llm.common import id_and_text, tokenizer_path

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint"


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every text, as the file's library counts without added tokens.

    For a .json file the proof of whole tokens is made once, on the vocabulary alone, and is sent to the
    executors with the file: both are bounded by the vocabulary. Pre-tokens outside it are merged, once per
    word and task as far as the bounded caches reach.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")
    spark = docs.sparkSession
    frame = id_and_text(docs, id_col, text_col)
    if path.endswith(".model"):
        with open(path, "rb") as f:
            model = spark.sparkContext.broadcast(f.read())

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from sentencepiece import SentencePieceProcessor

            library = SentencePieceProcessor(model_proto=model.value)
            yield from _counted(batches, lambda text: len(library.encode(text)))

        return frame.mapInArrow(pieces, SCHEMA)
    with open(path, encoding="utf-8") as f:
        source = f.read()
    shared = spark.sparkContext.broadcast((source, prove_whole_tokens(source)))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted(batches, loaded(*shared.value).count)

    return frame.mapInArrow(counts, SCHEMA)


def _counted(batches: Iterator[pa.RecordBatch], count) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        columns = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(map(count, texts), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])


def with_limit(counts: DataFrame, limit: int = 1024) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
