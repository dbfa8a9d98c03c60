"""Session defaults and the few decisions that depend on where a job runs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
READ_PARTITIONS = "veladura.read.partitions"


def local_session(cores: str = "*", app: str = "veladura") -> SparkSession:
    """Session for tests and the bench; on a cluster the submitter brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        # The JVM does not compile methods above 8000 bytes; wide generated projections then run as
        # smaller methods instead of one interpreted loop.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """New folder name in the shared folder of the session; where it names none, as in tests, it is set to a new local one."""
    shared = spark.conf.get(CHECKPOINT_DIR, None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="veladura-")
        spark.conf.set(CHECKPOINT_DIR, shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, per_task: int | None = None) -> DataFrame:
    """Deals the rows into as many partitions as the caller asks for by READ_PARTITIONS; unset, the splits stay.

    Small files of one row group are one task each, which a bench on one machine may want otherwise. ``per_task`` is for slim
    tables whose rows become much work or text: more rows are counted and dealt evenly, about so many to a task, however
    they lie in files.
    """
    asked = df.sparkSession.conf.get(READ_PARTITIONS, None)
    wanted = int(asked) if asked else -(-df.count() // per_task) if per_task else 0
    return df.repartition(wanted) if asked or wanted > 1 else df
