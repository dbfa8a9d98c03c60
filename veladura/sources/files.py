"""File sources: HTML pages, API documents, column lists, job configs, run metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veladura.functions.jsontext import is_object
from veladura.operators.jobs import SQL_JOB, column_list, names_from_content, names_from_lines, parse_jobs, with_defaults

METRIC = (
    "struct<timestamp:timestamp_ntz,volumen:bigint,motor:string,tiempo_segundos:double,"
    "config:struct<volumen:bigint,columnas:array<string>,formato:string,_motor:string,"
    "_metadata:struct<fuente:string,archivo_original:string,timestamp:string>>>"
)


def schema_of(struct: str) -> T.StructType:
    return T.DataType.fromDDL(struct)


NOT_TEXT, NO_NAMES, NO_OBJECT = "not UTF-8", "no names", "not a JSON object"


def read_files(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One row per file: path, whole text with line feeds as line breaks, and ``problem`` (the text is null then)."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("content").cast("string").alias("text"))
    good = F.is_valid_utf8("text")
    return files.select(
        "path", F.when(good, F.regexp_replace("text", r"\r\n?", "\n")).alias(column), F.when(~good, NOT_TEXT).alias("problem")
    )


def read_texts(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One row per readable file: path and whole text."""
    return read_files(spark, path, column).where("problem IS NULL").drop("problem")


def rejected_files(spark: SparkSession, path: str, test: Callable[[Column], Column] | None = None, problem: str = NO_OBJECT) -> DataFrame:
    """(path, problem) of the files that are no text, or whose text fails a test."""
    files = read_files(spark, path, "text")
    failed = F.when(~test(F.col("text")), problem) if test else F.lit(None).cast("string")
    return files.select("path", F.coalesce("problem", failed).alias("problem")).where("problem IS NOT NULL")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return read_texts(spark, path, "html")


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    return read_texts(spark, path, "spec")


def read_column_lines(spark: SparkSession, path: str) -> DataFrame:
    """Column lists with one name per line: path, ordinal, name."""
    files = read_texts(spark, path, "content")
    return column_list(files, names_from_lines(F.col("content")))


def read_column_files(spark: SparkSession, path: str) -> DataFrame:
    """Column lists with one name per line or commas on one line: path, ordinal, name."""
    files = read_texts(spark, path, "content")
    return column_list(files, names_from_content(F.col("content")))


def rejected_column_files(spark: SparkSession, path: str) -> DataFrame:
    """Column files that are no text or hold no name: an error for the job that wanted them."""
    return rejected_files(spark, path, lambda text: F.size(names_from_content(text)) > 0, NO_NAMES)


def read_job_files(spark: SparkSession, path: str) -> DataFrame:
    """JSON job configs, one per file, with defaults filled in; see ``rejected_files`` for the others."""
    return parse_jobs(read_texts(spark, path, "job").where(is_object(F.col("job"))), "job", ["path"])


def read_job_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON job configs, one per line, with defaults filled in, and ``problem`` of the lines that are none."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").where(F.trim("value") != "")
    bad = F.when(~is_object(F.col("value")), NO_OBJECT).alias("problem")
    return parse_jobs(lines.select("path", bad, "value"), "value", ["path", "problem"])


def read_sql_job_files(spark: SparkSession, path: str) -> DataFrame:
    """JSON job configs with a database and a table or query part, one per file."""
    texts = read_texts(spark, path, "job").where(is_object(F.col("job")))
    jobs = texts.select("path", F.from_json("job", SQL_JOB).alias("j")).select("path", "j.*")
    return sql_job_defaults(jobs, ["path"])


def sql_job_defaults(jobs: DataFrame, keys: list[str]) -> DataFrame:
    base = with_defaults(jobs, [*keys, "database", "query"])
    return base.select(
        *keys, "volumen", "columnas", "formato", "motor",
        F.coalesce("database.type", F.lit("postgresql")).alias("connection_type"),
        F.coalesce("database.database", F.lit("")).alias("database"),
        F.coalesce("database.schema", F.lit("public")).alias("schema"),
        F.coalesce("query.table", F.lit("")).alias("table"),
        F.coalesce(F.col("query.sql") != "", F.lit(False)).alias("query_provided"),
    )


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Run metrics, one JSON document or one JSON line per run."""
    return spark.read.schema(schema_of(METRIC)).json(path, multiLine=True)


def read_metric_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema_of(METRIC)).json(path)
