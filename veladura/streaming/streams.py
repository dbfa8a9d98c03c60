"""Streams: the batch expressions on readStream, and hit counts per event-time window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veladura.functions.draws import DEFAULT_SEED
from veladura.functions.families import Provider
from veladura.functions.rules import RULES, Rule
from veladura.operators.catalogue import BASE
from veladura.operators.detect import with_hits
from veladura.operators.generate import generate_over
from veladura.operators.mask import MaskConfig, mask_text
from veladura.sinks.folders import names, remove


def read_table_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType, max_files: int = 1000) -> DataFrame:
    """Parquet files of one table in a folder, as they arrive; what is named for the table may be a file or a folder of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{folder}/{name}*.parquet")


def rate_rows(spark: SparkSession, rows_per_second: int) -> DataFrame:
    """Endless row ids with their time."""
    return (
        spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
        .select(F.col("value").alias("row_id"), "timestamp")
    )


def stream_generate(
    rows: DataFrame, row_id: str, columns: Sequence[str], keep: Sequence[str] = (),
    catalogue: Mapping[str, Provider] = BASE, seed: int = DEFAULT_SEED,
) -> DataFrame:
    """A synthetic row per incoming row id; replays give the same values."""
    return generate_over(rows, row_id, columns, catalogue, seed, keep=keep)


def stream_mask(texts: DataFrame, column: str, config: MaskConfig = MaskConfig()) -> DataFrame:
    """Masks a text column; stateless."""
    return mask_text(texts, column, config)


def stream_pii_counts(
    texts: DataFrame, column: str, time: str, window: str = "1 hour", delay: str = "1 hour", rules: Sequence[Rule] = RULES
) -> DataFrame:
    """Hits per type and window. State is one counter per open window and type; rows later than the
    delay are dropped. The time column must be a timestamp with zone, so cast TIMESTAMP_NTZ first."""
    kinds = F.transform("__hits", lambda h: h["type"])
    rows = (
        with_hits(texts.select(time, column), {column: "__hits"}, rules)
        .withWatermark(time, delay)
        .select(time, F.explode(kinds).alias("type"))
    )
    return rows.groupBy(F.window(time, window).alias("window"), "type").agg(F.count("*").alias("n"))


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs an append stream over what is there now and stops."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


# A state is rewritten after so many micro-batches.
COMPACT_EVERY = 10


def _tables(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """Micro-batches of the finished states (s) and updates (b) in a folder."""
    found = names(spark, path, written=True)
    return [int(n[1:]) for n in found if n[0] == "s"], [int(n[1:]) for n in found if n[0] == "b"]


def _latest(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of the last micro-batch of every key; partial aggregation, one row per key and task."""
    others = [c for c in updates.columns if c not in keys]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("__last"))
    return last.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in others])


def _current(spark: SparkSession, path: str) -> DataFrame | None:
    states, updates = _tables(spark, path)
    base = states[-1] if states else -1
    parts = [f"{path}/s{base:010d}"] * bool(states) + [f"{path}/b{b:010d}" for b in updates if b > base]
    return spark.read.parquet(*parts) if parts else None


def upsert(batch: DataFrame, batch_id: int, path: str, keys: Sequence[str], every: int = COMPACT_EVERY) -> None:
    """Adds a micro-batch of changed keys to a keyed state in a folder.

    A batch is a table of its own; every so many batches the state of all keys is written anew, and what the state before
    it covers is removed. So the folder holds two states and at most twice ``every`` batches, whatever has been
    processed, and a reader that listed it keeps its files for ``every`` batches. A repeated batch writes the same table again, or
    is passed over when a state holds it already.
    """
    spark = batch.sparkSession
    states, _ = _tables(spark, path)
    if states and states[-1] >= batch_id:
        return
    batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{path}/b{batch_id:010d}")
    if (batch_id + 1) % every:
        return
    _latest(_current(spark, path), keys).write.mode("overwrite").parquet(f"{path}/s{batch_id:010d}")
    if states:
        for name in names(spark, path):
            if int(name[1:]) <= states[-1] and name != f"s{states[-1]:010d}":
                remove(spark, f"{path}/{name}")


def run_keyed(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], every: int = COMPACT_EVERY) -> None:
    """Runs an aggregate stream in update mode over what is there now, into a keyed state that ``keyed_state`` reads."""
    query = (
        stream.writeStream.foreachBatch(lambda batch, batch_id: upsert(batch, batch_id, path, keys, every))
        .option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def keyed_state(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Last row of every key of a state; an error where nothing was written yet."""
    current = _current(spark, path)
    if current is None:
        raise ValueError(f"no state in {path}")
    return _latest(current, keys).drop("batch_id")
