"""Token ids of a corpus in wavelet-matrix shards: one compressed file per range of documents.

A shard holds its documents in ascending id order, ids of all texts one after another. Bit plane k of the matrix
holds bit (bits-1-k) of every id, in the order in which the planes above have sorted them stably, zeros first.
A rank directory (ones before every 512th bit) stands beside each plane, so access, rank, select and count need
a few look-ups per plane and no other structure.

File: magic, version, bits, numbers of documents and ids, then document ids (int64), lengths (uint32), and per
plane the zero count, the directory (uint32) and the packed bits; little-endian throughout. Spark writes each shard
as one row of a Parquet file, so a lost executor only costs its tasks, and any store Spark reaches will do.

Rows: every input row gives one document; equal ids keep all their rows, ordered by text; a null id sorts first; a
null text is empty and holds only the end id; an empty table gives no file and no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veladura.llm.bytebpe import loaded, prove_whole_tokens
from veladura.llm.common import id_and_text, shared_folder, tokenizer_path

MAGIC, BLOCK = b"VWM1", 512
SHARD_IDS = 4_000_000
NULL_ID = -(2**63)


class WaveletMatrix:
    """Succinct sequence of unsigned ids."""

    def __init__(self, n: int, bits: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.bits, self.zeros, self.planes, self.ranks = n, bits, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        zeros, planes, ranks, rest = [], [], [], ids
        for k in reversed(range(bits)):
            bit = (rest & rest.dtype.type(1 << k)) != 0
            packed = np.packbits(bit)
            counts = np.bitwise_count(np.pad(packed, (0, -len(packed) % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
            ranks.append(np.concatenate([np.zeros(1, np.uint32), np.cumsum(counts, dtype=np.uint32)]))
            planes.append(packed)
            ones, zero = np.flatnonzero(bit), np.flatnonzero(~bit)
            zeros.append(len(zero))
            rest = np.concatenate([rest.take(zero), rest.take(ones)])
        return cls(len(ids), bits, zeros, planes, ranks)

    def _ones(self, k: int, at: int) -> int:
        """Ones of plane k before a place."""
        block = at // BLOCK
        part = self.planes[k][block * (BLOCK // 8) : (at + 7) // 8]
        full = int(self.ranks[k][block])
        if len(part):
            full += int(np.bitwise_count(part).sum()) - (int(part[-1] & ((1 << (-at % 8)) - 1)).bit_count())
        return full

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for k in range(self.bits):
            bit = int(self.planes[k][at >> 3] >> (7 - (at & 7))) & 1
            ones = self._ones(k, at)
            at = self.zeros[k] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def rank(self, value: int, at: int) -> int:
        """How often a value occurs before a place."""
        if value >> self.bits:
            return 0
        low, high = 0, min(at, self.n)
        for k in range(self.bits):
            a, b = self._ones(k, low), self._ones(k, high)
            if value >> (self.bits - 1 - k) & 1:
                low, high = self.zeros[k] + a, self.zeros[k] + b
            else:
                low, high = low - a, high - b
        return high - low

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, nth: int) -> int:
        """Place of the nth occurrence, from 0; -1 if there are fewer. By bisection over rank."""
        if nth < 0 or nth >= self.count(value):
            return -1
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            if self.rank(value, mid + 1) > nth:
                high = mid
            else:
                low = mid + 1
        return low

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, i) for i in range(self.count(value))]

    def all_ids(self) -> np.ndarray:
        """Every id in order: the stable partitions undone from the last plane to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for k in reversed(range(self.bits)):
            bit = np.unpackbits(self.planes[k], count=self.n).view(bool)
            out = np.empty_like(values)
            out[~bit] = values[: self.zeros[k]]
            values[self.zeros[k] :] |= kind(1 << (self.bits - 1 - k))
            out[bit] = values[self.zeros[k] :]
            values = out
        return values


def to_file(doc_ids: np.ndarray, lengths: np.ndarray, matrix: WaveletMatrix) -> bytes:
    parts = [MAGIC, struct.pack("<HHQQ", 1, matrix.bits, len(doc_ids), matrix.n), doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes()]
    for zero, rank, plane in zip(matrix.zeros, matrix.ranks, matrix.planes, strict=True):
        parts += [struct.pack("<Q", zero), rank.astype("<u4").tobytes(), plane.tobytes()]
    return b"".join(parts)


def from_file(data: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    if data[:4] != MAGIC:
        raise ValueError("not a wavelet-matrix shard")
    _, bits, documents, n = struct.unpack_from("<HHQQ", data, 4)
    at = 24
    doc_ids = np.frombuffer(data, "<i8", documents, at)
    lengths = np.frombuffer(data, "<u4", documents, at := at + 8 * documents)
    at += 4 * documents
    zeros, ranks, planes, size = [], [], [], (n + 7) // 8
    blocks = -(-size // (BLOCK // 8)) + 1
    for _ in range(bits):
        zeros.append(struct.unpack_from("<Q", data, at)[0])
        ranks.append(np.frombuffer(data, "<u4", blocks, at + 8))
        planes.append(np.frombuffer(data, np.uint8, size, at := at + 8 + 4 * blocks))
        at += size
    return doc_ids, lengths, WaveletMatrix(n, bits, zeros, planes, ranks)


def write_shards(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes all texts and writes the shards in ascending document order.

    Ranges of ids make the partitions; a task writes a shard whenever SHARD_IDS ids have come together, so a task's
    memory is bounded by that and by its longest text.
    """
    spark = docs.sparkSession
    with open(path or tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        source = f.read()
    shared = spark.sparkContext.broadcast((source, prove_whole_tokens(source)))
    shard_ids = SHARD_IDS

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(*shared.value)
        bits = max(end_id, bpe.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length()
        kind = np.uint16 if bits <= 16 else np.uint32
        names, held, part, total = [], [], 0, 0

        def row() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in held], np.uint32)
            data = to_file(np.array(names, np.int64), lengths, WaveletMatrix.build(np.concatenate(held), bits))
            columns = [pa.array([names[0]], pa.int64()), pa.array([part], pa.int32()), pa.array([int(lengths.sum())], pa.int64()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["first_id", "part", "n_ids", "data"])

        for batch in batches:
            for name, found in zip(batch.column(0).to_pylist(), bpe.ids_of(batch.column(1)), strict=True):
                ids = np.append(found.astype(kind), kind(end_id))
                if held and total + len(ids) > shard_ids:
                    yield row()
                    names, held, part, total = [], [], part + 1, 0
                names.append(NULL_ID if name is None else name)
                held.append(ids)
                total += len(ids)
        if held:
            yield row()

    frame = id_and_text(docs, id_col, text_col)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = frame.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    # Ids of one value stay in one range, so first_id and part give the order of the shards.
    # The bit planes are as good as random: no codec makes them smaller.
    ordered.mapInArrow(shard, "first_id bigint, part int, n_ids bigint, data binary").write.option("compression", "none").option("parquet.block.size", str(16 << 20)).parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    Starts: the ids of earlier shards, a sum over one small row per shard, plus those before it in its own.
    """
    # One row per shard, some 10 MB of ids each: a single partition holds 10^5 short rows for 10^12 ids.
    order = Window.orderBy("first_id", "part").rowsBetween(Window.unboundedPreceding, -1)
    shards = spark.read.parquet(folder)
    starts = shards.select("first_id", "part", "n_ids").withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0).cast("bigint"))).drop("n_ids")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part, data in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                doc_ids, lengths, matrix = from_file(data.as_buffer())
                ids = matrix.all_ids().astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(ends - lengths, ends, strict=True)]
                columns = [
                    pa.array([first.as_py()] * len(doc_ids), pa.int64()), pa.array([part.as_py()] * len(doc_ids), pa.int32()), pa.array(doc_ids, mask=doc_ids == NULL_ID),
                    pa.array(ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["first_id", "part", "doc_id", "inner", "n_tokens", "ids_crc32"])

    found = shards.select("first_id", "part", "data").mapInArrow(rows, "first_id bigint, part int, doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(starts, ["first_id", "part"]).select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes the shards to the shared folder and reads every document back from them."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/wavelet-{uuid.uuid4().hex}"
    write_shards(docs, folder, **options)
    return read_shards(spark, folder)
