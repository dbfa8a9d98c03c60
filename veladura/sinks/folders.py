"""Names in a folder of any store that Spark reaches, and their removal."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str, written: bool = False) -> list[str]:
    """Names directly below a folder, in order; ``written``: only of tables whose writer has finished."""
    store, where = _at(spark, path)
    if not store.exists(where):
        return []
    found = sorted(s.getPath().getName() for s in store.listStatus(where))
    return [n for n in found if store.exists(_at(spark, f"{path}/{n}/_SUCCESS")[1])] if written else found


def remove(spark: SparkSession, path: str) -> None:
    store, where = _at(spark, path)
    store.delete(where, True)
