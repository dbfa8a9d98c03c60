"""What the operators of this package share: input columns, written tables, the two hash rules."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
# Rows whose texts a Python worker holds as objects at a time.
ROWS_HELD = 500
# Bytes of text whose words it holds as arrays at a time, and rows that it gathers.
BYTES_HELD, ROWS_GATHERED = 16_000_000, 60_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Sends this package's code to the executors, once per application: their Python need not have it installed."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        top = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="llm-code-")) / "veladura_llm_code.zip"
        with zipfile.ZipFile(path, "w") as code:
            for f in [top / "__init__.py", *sorted((top / "llm").glob("*.py"))]:
                code.write(f, f.relative_to(top.parent))
        context.addPyFile(str(path))
        _SHIPPED.add(context.applicationId)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of any frame; a null text is empty. Other columns, whatever their names, are left out."""
    shipped(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def portions(batches: Iterator[pa.RecordBatch], rows: int = ROWS_HELD) -> Iterator[pa.RecordBatch]:
    """All rows of the batches, a few at a time. A batch has up to 10,000 texts; each worker of an executor would hold them, and what
    it makes of them, as Python objects. Rows without one, as an empty batch has, give none."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def weighed(batches: Iterator[pa.RecordBatch], column: int, size: int = BYTES_HELD) -> Iterator[pa.RecordBatch]:
    """All rows of the batches, in parts of so many bytes in a column of texts, or of one row that has more."""
    for batch in batches:
        ends, start = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def gathered(batches: Iterator[pa.RecordBatch], rows: int = ROWS_GATHERED, size: int = BYTES_HELD) -> Iterator[pa.RecordBatch]:
    """All rows of the batches, as batches of about so many rows or bytes: work on arrays has a cost for each batch as well."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach. Where the session names none, a new one of this machine in local mode, an error on a cluster."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors reach")
        folder = _LOCAL.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="llm-shared-"))
    return folder.rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: the lineage ends there, and nothing is computed twice."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, columns: list[str]) -> str:
    """A column name that a frame does not have, in any case of its letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_of_id(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % modulus


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; VELADURA_TOKENIZERS names another folder."""
    folder = os.environ.get("VELADURA_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
