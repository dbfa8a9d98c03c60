"""File sinks. Every sink writes one file per task; nothing is gathered on one task."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veladura.functions.sqltext import plain_number, time_text
from veladura.operators.numbering import measured, staged
from veladura.sinks.sqltext import batches, write_script
from veladura.sources.files import METRIC, schema_of

BOM = "\ufeff"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
# For reading: with or without microseconds. Writers make the text themselves, see time_text.
TIME_OPTIONS = {"timestampFormat": f"{TIME_FORMAT}[.SSSSSS]", "timestampNTZFormat": f"{TIME_FORMAT}[.SSSSSS]"}
TIMES = (T.TimestampType, T.TimestampNTZType)
BATCH = 10_000


def _text_form(df: DataFrame) -> DataFrame:
    """Cells as the text formats show them: True/False, numbers without exponents."""
    def cell(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            return F.when(c, "True").when(~c, "False").alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return plain_number(c).alias(f.name)
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(c).alias(f.name)
        return time_text(c).alias(f.name) if isinstance(f.dataType, TIMES) else c

    return df.select(*[cell(f) for f in df.schema.fields])


def _with_times_of(df: DataFrame) -> list[Column]:
    """Columns with timestamps as text, to the microsecond where there are any."""
    return [(time_text(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, TIMES) else F.col(f"`{f.name}`")) for f in df.schema.fields]


def _with_times(df: DataFrame) -> DataFrame:
    return df.select(*_with_times_of(df))


def write_csv(df: DataFrame, path: str, sep: str = ",", bom: bool = True, mode: str = "error") -> None:
    """CSV with header; the byte order mark, when wanted, is part of the first header name."""
    shown = _text_form(df)
    if bom:
        shown = shown.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    shown.write.mode(mode).options(**TIME_OPTIONS).csv(
        path, header=True, sep=sep, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",") -> DataFrame:
    """Reads back what ``write_csv`` wrote (the header is skipped, so a byte order mark does not matter)."""
    return spark.read.schema(schema).options(**TIME_OPTIONS).csv(
        path, header=True, sep=sep, escape='"', multiLine=True, enforceSchema=True
    )


def write_csv_semicolon(df: DataFrame, path: str, mode: str = "error") -> None:
    write_csv(df, path, sep=";", mode=mode)


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """One object per line with every field, nulls included."""
    _with_times(df).write.mode(mode).options(**TIME_OPTIONS).json(path, ignoreNullFields=False)


def json_record(columns: list[str] | None = None) -> Column:
    """Row as a JSON object with every field."""
    return F.to_json(F.struct(*(columns or ["*"])), {"ignoreNullFields": "false", **TIME_OPTIONS})


def json_arrays(df: DataFrame, row_id: str | None = None, size: int = BATCH) -> DataFrame:
    """JSON arrays of ``size`` records each (the last one: the rest), in id order or as the rows come: (batch, records).

    One array of a whole table could only be written by one task, so a table is a
    sequence of arrays.
    """
    rows = staged(df)
    record = F.to_json(F.struct(*_with_times_of(df)), {"ignoreNullFields": "false", **TIME_OPTIONS})
    listed = batches(rows, [record.alias("text")], row_id, size)
    records = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("  "), r["text"])), ",\n")
    return listed.select("batch", F.concat(F.lit("[\n"), records, F.lit("\n]")).alias("records"))


def write_json_arrays(df: DataFrame, path: str, row_id: str | None = None, size: int = BATCH, mode: str = "error") -> None:
    json_arrays(df, row_id, size).select("records").write.mode(mode).text(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "error") -> None:
    df.write.mode(mode).partitionBy(*(partition_by or [])).parquet(path)


def write_xml(df: DataFrame, path: str, row_tag: str = "row", mode: str = "error") -> None:
    _with_times(df).write.mode(mode).xml(path, rowTag=row_tag)


@dataclass(frozen=True)
class Run:
    """What an export wrote, measured while it wrote it."""

    rows: int
    columns: int
    seconds: float
    engine: str = "spark"


def metadata_frame(spark: SparkSession, run: Run, at: dt.datetime | None = None) -> DataFrame:
    """Key/value sheet that goes next to exported data."""
    at = at or dt.datetime.now()
    rows = [
        ("written_at", at.strftime("%Y-%m-%d %H:%M:%S")),
        ("rows", str(run.rows)),
        ("columns", str(run.columns)),
        ("engine", run.engine),
        ("seconds", f"{run.seconds:.2f}"),
    ]
    return spark.createDataFrame(rows, "property string, value string")


def write_metadata(spark: SparkSession, path: str, run: Run, mode: str = "overwrite") -> None:
    metadata_frame(spark, run).coalesce(1).write.mode(mode).csv(path, header=True)


def write_metrics(spark: SparkSession, path: str, volume: int, engine: str, seconds: float, config: Mapping[str, object]) -> None:
    """Appends one run to a folder of metrics."""
    row = {
        "timestamp": dt.datetime.now(), "volumen": volume, "motor": engine, "tiempo_segundos": round(seconds, 2),
        "config": {
            "volumen": config.get("volumen"), "columnas": list(config.get("columnas") or []), "formato": config.get("formato"),
            "_motor": config.get("_motor"), "_metadata": dict(config.get("_metadata") or {}) or None,
        },
    }
    spark.createDataFrame([row], schema_of(METRIC)).coalesce(1).write.mode("append").json(path)


def write_specs(jobs: DataFrame, path: str, mode: str = "error") -> None:
    """Job configs as JSON, ready for the job reader."""
    jobs.write.mode(mode).json(path)


def write(df: DataFrame, format: str, path: str, metadata: str | None = None, metrics: str | None = None, config: Mapping[str, object] | None = None, **options) -> Run:
    """Exports a frame by format name; formats that need a row id or table take it as an option.

    The rows are counted while they are written. ``metadata`` and ``metrics`` name folders for the sheet of this run and
    for the run's line among others.
    """
    if not df.columns:
        raise ValueError("nothing to export: the frame has no columns")
    writers = {
        "csv": write_csv, "excel": write_csv_semicolon, "json": write_jsonl, "jsonl": write_jsonl, "json_array": write_json_arrays,
        "parquet": write_parquet, "xml": write_xml, "sql": write_script,
    }
    if format not in writers:
        raise ValueError(f"unknown format {format!r}; known: {', '.join(writers)}")
    began = time.monotonic()
    if format == "sql":
        rows = write_script(df, path, **options)
    else:
        seen, observation = measured(df)
        writers[format](seen, path, **options)
        rows = int(observation.get["__rows"])
    run = Run(rows, len(df.columns), time.monotonic() - began)
    if metadata:
        write_metadata(df.sparkSession, metadata, run)
    if metrics:
        write_metrics(df.sparkSession, metrics, run.rows, run.engine, run.seconds, {"volumen": run.rows, "columnas": df.columns, "formato": format, **(config or {})})
    return run
