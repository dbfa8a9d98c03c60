"""Row numbers over a whole table without a window over the whole table, and measures taken while a frame is written.

A frame is written to the scratch folder once, each row with its place (partition, place in the partition). Numbers by
place need the rows of each partition and their running sum only. Numbers by an id cut the ids into ranges of about
RANGE_ROWS rows at quantiles, count each range, and number inside the ranges: the windows are bounded, no row is counted
by one task for all, and a recomputed task finds the same numbers, as the rows stand in files.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veladura.session import scratch_path

RANGE_ROWS = 1_000_000
PLACE = "__place"


@dataclass(frozen=True)
class Staged:
    """A frame in the scratch folder with ``__place``, what was measured while it was written, and the seconds."""

    frame: DataFrame
    measures: dict[str, object]
    seconds: float

    @property
    def rows(self) -> int:
        return int(self.measures["__rows"])


def measured(df: DataFrame, measures: Sequence[Column] = ()) -> tuple[DataFrame, Observation]:
    """The frame with an observation of its row count and the given aggregates; get it after the action that writes the frame."""
    observation = Observation()
    return df.observe(observation, F.count(F.lit(1)).alias("__rows"), *measures), observation


def staged(df: DataFrame, measures: Sequence[Column] = ()) -> Staged:
    """Writes a frame to the scratch folder in one pass over its sources."""
    began = time.monotonic()
    path = scratch_path(df.sparkSession, "staged")
    seen, observation = measured(df, measures)
    placed = seen.withColumn(PLACE, F.monotonically_increasing_id())
    placed.write.parquet(path)
    return Staged(df.sparkSession.read.schema(placed.schema).parquet(path), observation.get, time.monotonic() - began)


def _running(counts: Sequence[tuple[int, int]]) -> dict[int, int]:
    """Key -> rows of all smaller keys."""
    offsets, total = {}, 0
    for key, n in sorted(counts):
        offsets[key] = total
        total += n
    return offsets


def _below(bounds: Sequence[object], value: Column, kind: T.DataType) -> Column:
    """How many of the sorted bounds are below a value, by bisection: as many steps as the number has bits."""
    if not bounds:
        return F.lit(0)
    listed = F.array(*(F.lit(b).cast(kind) for b in bounds))
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    step = lambda low, s: F.when(F.get(listed, low + s - 1) < value, low + s).otherwise(low)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def numbered(rows: Staged, row_id: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``row_ix``, 0 to rows - 1 without gaps: in the order of an id (nulls first, repeated ids by place), or by place."""
    frame = rows.frame
    spark = frame.sparkSession
    place = F.col(PLACE)
    if row_id is None:
        part = F.shiftright(place, 33)
        # One short row per partition of the scratch table.
        counts = frame.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
        offsets = spark.createDataFrame(list(_running([(r.part, r.n) for r in counts]).items()), "__part bigint, __offset bigint")
        joined = frame.join(F.broadcast(offsets), part == F.col("__part"))
        return joined.withColumn("row_ix", F.col("__offset") + place.bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__offset")
    value, kind = F.col(f"`{row_id}`"), frame.schema[row_id].dataType
    ranges = -(-rows.rows // range_rows)
    bounds = []
    if ranges > 1:
        shares = [k / ranges for k in range(1, ranges)]
        bounds = sorted({b for b in frame.agg(F.percentile_approx(value, shares, 10_000)).first()[0] or [] if b is not None})
    ranged = frame.withColumn("__range", _below(bounds, value, kind))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("n")).collect()
    offsets = _running([(r["__range"], r.n) for r in counts])
    before = F.get(F.array(*(F.lit(offsets.get(k, 0)).cast("bigint") for k in range(len(bounds) + 1))), F.col("__range"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(value.asc_nulls_first(), PLACE))
    return ranged.withColumn("row_ix", before + inside - 1).drop("__range")
