"""SentencePiece encoding and decoding over the lattice of a piece file's scores.

Encoding takes the best path over the scores as the file has them, the unigram reading of a piece table, with byte
pieces for characters without a piece. No piece holds a space sign after another sign (checked when the file is
loaded), so paths part before every run of spaces and each distinct word is solved once: encode_words does that as
relations in Spark, encode in the tasks, on the words of a batch that the bounded cache lacks.

Rows: every input row gives one row; a null text is empty and has no ids; repeated rows repeat; an empty table gives
no rows; other columns are not read. A text that itself holds the space sign decodes with spaces there.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veladura.llm.common import id_and_text, portions, tokenizer_path
from veladura.llm.lattice import SPACE, PieceTable, by_length, viterbi

SIGN = SPACE.encode()
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
CACHE_LIMIT = 500_000


class Codec:
    def __init__(self, model: bytes):
        self.table, self.known, self.old = PieceTable(model), {}, {}

    @staticmethod
    def words(text: str) -> list[bytes]:
        """The normalised text, cut before each run of spaces; nothing for an empty text."""
        if not text:
            return []
        if "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            return [SIGN + w for w in text.encode().split(b" ")]
        return [w.encode() for w in WORD.findall(SPACE + text.replace(" ", SPACE))]

    def learn(self, words: set[bytes]) -> None:
        """Solves the words that the caches lack; two generations bound the memory."""
        if len(self.known) > CACHE_LIMIT:
            self.old, self.known = self.known, {}
        new = []
        for w in words:
            if w not in self.known:
                if (ids := self.old.get(w)) is None:
                    new.append(w)
                else:
                    self.known[w] = ids
        for places, matrix in by_length(new, self.table.longest):
            for i, ids in zip(places, viterbi(self.table, matrix), strict=True):
                self.known[new[i]] = ids.tobytes()

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.table.texts.__getitem__, ids.tolist())).replace(SIGN, b" ")
        return data[1:].decode("utf-8", "replace")


def _encoded(batches: Iterator[pa.RecordBatch], model: bytes, with_ids: bool) -> Iterator[pa.RecordBatch]:
    codec = Codec(model)
    for batch in portions(batches):
        texts = batch.column(1).to_pylist()
        cut = [codec.words(t) for t in texts]
        codec.learn(set().union(*cut))
        ids = [np.frombuffer(b"".join(map(codec.known.__getitem__, c)), np.uint32) for c in cut]
        same = [codec.decode(i) == t for i, t in zip(ids, texts, strict=True)]
        columns = [batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(same, pa.bool_())]
        names = ["doc_id", "n_pieces", "ids_crc32", "round_trip"]
        if with_ids:
            offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32))))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, round_trip[, ids]); round_trip: the ids decode to the text."""
    with open(path or tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, round_trip boolean" + ", ids array<int>" * with_ids
    return id_and_text(docs, id_col, text_col).mapInArrow(lambda batches: _encoded(batches, model.value, with_ids), schema)


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from ids; null ids are an empty text."""
    with open(path or tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(np.array(i or [], np.int64)) for i in batch.column(1).to_pylist()])], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(rows, "doc_id bigint, text string")


def pieces(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(piece, id, score) of the text pieces: the piece table as a relation, bounded by the vocabulary."""
    with open(path or tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        table = PieceTable(f.read())
    rows = [(table.texts[i].decode(), int(i), float(table.scores[i])) for i in table.normal]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def encode_words(words: DataFrame, table: DataFrame) -> DataFrame:
    """(word, ids) of a distinct column word, each starting with the space sign, as relations only.

    Substrings up to the longest piece are exploded, equi-joined to the piece table and grouped by word; a fold along
    the ends keeps, per end, the best score and its last piece. A character without a piece gives id -1.
    """
    bounds = table.agg(F.max(F.length("piece")).alias("longest"), F.min("score").alias("lowest")).head()
    starts = words.select("word", F.posexplode(F.sequence(F.lit(1), F.length("word"))).alias("p", "start"))
    subs = starts.select("word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(bounds.longest), F.length("word") - F.col("start") + 1))).alias("size"))
    subs = subs.select("word", "start", "size", F.substring("word", F.col("start"), F.col("size")).alias("piece"))
    hit = subs.join(table, "piece", "left").where("id is not null or size = 1")
    edge = F.struct((F.col("start") + F.col("size")).alias("stop"), "start", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(bounds.lowest - 10)).alias("score"))
    grouped = hit.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    fold = """aggregate(edges, map(1, named_struct('s', 0D, 'ids', cast(array() as array<int>))),
        (best, e) -> CASE WHEN best[e.stop] IS NULL OR best[e.start].s + e.score > best[e.stop].s
          THEN map_concat(map_filter(best, (k, v) -> k <> e.stop), map(e.stop, named_struct('s', best[e.start].s + e.score, 'ids', concat(best[e.start].ids, array(e.id)))))
          ELSE best END,
        best -> best[length(word) + 1].ids)"""
    return grouped.select("word", F.expr(fold).alias("ids"))
