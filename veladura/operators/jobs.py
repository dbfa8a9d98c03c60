"""Generation jobs as rows: column lists, defaults and repairs, run totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Defaults of a job and the formats it may ask for.
DEFAULT_VOLUME = 1000
REPAIR_VOLUME = 100
DEFAULT_COLUMNS = ["nombre", "email"]
DEFAULT_FORMAT, REPAIR_FORMAT = "excel", "csv"
DEFAULT_ENGINE = "python"
FORMATS = ["excel", "csv", "json", "parquet"]
WARN_LARGE, WARN_VERY_LARGE, WARN_MASSIVE = 50_000, 100_000, 10_000_000

# Every line break Python's splitlines knows.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"

JOB = "struct<volumen:bigint,columnas:array<string>,formato:string,motor:string>"
SQL_JOB = (
    "struct<volumen:bigint,columnas:array<string>,formato:string,motor:string,"
    "database:struct<type:string,host:string,port:int,database:string,schema:string,use_env_vars:boolean>,"
    "query:struct<table:string,sql:string>>"
)


def clean_names(names: Column) -> Column:
    """Trimmed, lower-cased names without the blank ones."""
    return F.filter(F.transform(names, lambda n: F.lower(_strip(n))), lambda n: n != "")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def names_from_lines(content: Column) -> Column:
    return clean_names(F.split(content, LINE_BREAK, -1))


def names_from_content(content: Column) -> Column:
    """A comma list on one line, or one name per line."""
    one_line = F.contains(content, F.lit(",")) & ~F.contains(content, F.lit("\n"))
    return F.when(one_line, clean_names(F.split(content, ",", -1))).otherwise(names_from_lines(content))


def column_list(files: DataFrame, names: Column, keys: Sequence[str] = ("path",)) -> DataFrame:
    """One row per name, in order."""
    rows = files.select(*keys, F.posexplode_outer(names).alias("ordinal", "name"))
    return rows.where(F.col("ordinal").isNotNull())


def parse_jobs(jobs: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Job configs from JSON text with the loader's defaults."""
    return with_defaults(jobs.select(*keys, F.from_json(F.col(text), JOB).alias("__job")).select(*keys, "__job.*"), keys)


def with_defaults(jobs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return jobs.select(
        *keys,
        F.coalesce("volumen", F.lit(DEFAULT_VOLUME).cast("bigint")).alias("volumen"),
        F.coalesce("columnas", F.array().cast("array<string>")).alias("columnas"),
        F.coalesce("formato", F.lit(DEFAULT_FORMAT)).alias("formato"),
        F.coalesce("motor", F.lit(DEFAULT_ENGINE)).alias("motor"),
    )


def repair_jobs(jobs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jobs given in code: a missing or non-positive volume, no columns or an unknown format are replaced."""
    none = F.coalesce(F.size("columnas"), F.lit(0)) <= 0
    return jobs.select(
        *keys,
        F.when(F.col("volumen") > 0, F.col("volumen")).otherwise(F.lit(REPAIR_VOLUME)).cast("bigint").alias("volumen"),
        F.when(none, F.array(*[F.lit(c) for c in DEFAULT_COLUMNS])).otherwise(F.col("columnas")).alias("columnas"),
        F.when(F.col("formato").isin(FORMATS), F.col("formato")).otherwise(F.lit(REPAIR_FORMAT)).alias("formato"),
    )


def valid_volume(volume: Column) -> Column:
    return F.when(volume > 0, volume).otherwise(F.lit(DEFAULT_VOLUME))


def volume_class(volume: Column) -> Column:
    return (
        F.when(volume > WARN_MASSIVE, "massive")
        .when(volume > WARN_VERY_LARGE, "very large")
        .when(volume > WARN_LARGE, "large")
        .otherwise("normal")
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """First row per key by an order. An aggregate, so repeated keys shrink before the shuffle
    and a hot key costs no more than its distinct partitions."""
    order = [order] if isinstance(order, str) else list(order)
    others = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*others), F.struct(*order)) if others else None
    return df.groupBy(*keys).agg(first.alias("__row")).select(
        *[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns]
    )


def duplicate_names(names: DataFrame, keys: Sequence[str] = (), name: str = "name") -> DataFrame:
    return names.groupBy(*keys, name).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def session_totals(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Runs, rows, seconds and rows per second."""
    rate = F.when(F.sum("tiempo_segundos") > 0, F.sum("volumen") / F.sum("tiempo_segundos"))
    return metrics.groupBy(*by).agg(
        F.count("*").alias("runs"), F.sum("volumen").alias("total_rows"),
        F.sum("tiempo_segundos").alias("seconds"), rate.alias("rows_per_second"),
    )
