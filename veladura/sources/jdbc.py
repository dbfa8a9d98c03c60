"""JDBC: connection options by engine, tables and queries as relations. Drivers are the user's jars."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Supported engines and their default ports.
PORTS = {"postgresql": 5432, "mysql": 3306, "sqlserver": 1433, "sqlite": None}
DEFAULT_SQLITE = "datos.db"
DEFAULT_CHUNK = 10_000

# Where each engine lists its tables.
TABLE_LISTS = {
    "postgresql": "SELECT table_name FROM information_schema.tables WHERE table_schema = '{schema}'",
    "mysql": "SELECT table_name FROM information_schema.tables WHERE table_schema = '{schema}'",
    "sqlserver": "SELECT table_name FROM information_schema.tables WHERE table_schema = '{schema}'",
    "sqlite": "SELECT name AS table_name FROM sqlite_master WHERE type = 'table'",
}


def with_environment(config: Mapping[str, object], use_env: bool = True) -> dict[str, object]:
    """Missing connection parts from ``<ENGINE>_HOST`` and so on, then the default host and port."""
    engine = str(config.get("db_type") or "postgresql")
    if engine not in PORTS:
        raise ValueError(f"unsupported engine {engine!r}; known: {', '.join(PORTS)}")
    filled = {**config, "db_type": engine}
    names = {"host": "HOST", "port": "PORT", "database": "DATABASE", "username": "USER", "password": "PASSWORD"}
    for part, suffix in names.items():
        if not filled.get(part) and use_env:
            filled[part] = os.environ.get(f"{engine.upper()}_{suffix}")
    filled["host"] = filled.get("host") or "localhost"
    filled["port"] = filled.get("port") or PORTS[engine]
    return filled


def jdbc_url(config: Mapping[str, object]) -> str:
    engine, host, port, database = (config.get(k) for k in ("db_type", "host", "port", "database"))
    if engine == "sqlite":
        return f"jdbc:sqlite:{config.get('sqlite_path') or DEFAULT_SQLITE}"
    if not database:
        raise ValueError("a database name is needed")
    if engine == "sqlserver":
        return f"jdbc:sqlserver://{host}:{port};databaseName={database}"
    return f"jdbc:{engine}://{host}:{port}/{database}"


def url_column(engine: Column, host: Column, port: Column, database: Column, path: Column) -> Column:
    """Connection URL of every row of a connection table; null where the engine or the database is missing."""
    default = F.when(engine == "postgresql", 5432).when(engine == "mysql", 3306).when(engine == "sqlserver", 1433)
    place = F.concat(F.coalesce(host, F.lit("localhost")), F.lit(":"), F.coalesce(port, default).cast("string"))
    named = F.nullif(database, F.lit(""))
    return (
        F.when(engine == "sqlite", F.concat(F.lit("jdbc:sqlite:"), F.coalesce(path, F.lit(DEFAULT_SQLITE))))
        .when(engine == "sqlserver", F.concat(F.lit("jdbc:sqlserver://"), place, F.lit(";databaseName="), named))
        .when(engine.isin("postgresql", "mysql"), F.concat(F.lit("jdbc:"), engine, F.lit("://"), place, F.lit("/"), named))
    )


def options(config: Mapping[str, object]) -> dict[str, str]:
    filled = with_environment(config, bool(config.get("use_env_vars", True)))
    found = {"url": jdbc_url(filled)}
    if filled.get("username"):
        found["user"] = str(filled["username"])
    if filled.get("password"):
        found["password"] = str(filled["password"])
    if filled.get("driver"):
        found["driver"] = str(filled["driver"])
    return found


def read_table(spark: SparkSession, config: Mapping[str, object], **reader: str) -> DataFrame:
    """A table with its full schema. Pass partitionColumn, lowerBound, upperBound and numPartitions
    to read a large one in parallel."""
    schema, table = config.get("schema"), config["table"]
    name = f"{schema}.{table}" if schema and config.get("db_type") != "sqlite" else str(table)
    return spark.read.format("jdbc").options(**options(config), dbtable=name, **reader).load()


def query_options(config: Mapping[str, object], **reader: str) -> dict[str, str]:
    """The query as a derived table, which unlike the query option may be read in partitions; rows come in batches."""
    query = str(config["query"]).strip().rstrip(";")
    return {**options(config), "dbtable": f"({query}) AS q", "fetchsize": str(DEFAULT_CHUNK), **reader}


def read_query(spark: SparkSession, config: Mapping[str, object], **reader: str) -> DataFrame:
    """Result of a query. Pass partitionColumn, lowerBound, upperBound and numPartitions to read a large one in parallel."""
    return spark.read.format("jdbc").options(**query_options(config, **reader)).load()


def table_list_query(config: Mapping[str, object]) -> str:
    engine = str(config.get("db_type") or "postgresql")
    # A MySQL schema is a database.
    default = {"mysql": config.get("database") or "", "sqlserver": "dbo"}.get(engine, "public")
    schema = str(config.get("schema") or default).replace("'", "''")
    return TABLE_LISTS[engine].format(schema=schema)


def list_tables(spark: SparkSession, config: Mapping[str, object], k: int | None = None) -> DataFrame:
    """Table names of the database in order, or the first k."""
    listed = spark.read.format("jdbc").options(**options(config), query=table_list_query(config)).load()
    ordered = listed.toDF("table_name").orderBy("table_name")
    return ordered if k is None else ordered.limit(k)


def write_table(df: DataFrame, config: Mapping[str, object], table: str, if_exists: str = "append", chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Loads a table and returns the frame that counts what it now holds.

    Every partition opens one connection; ``numPartitions`` in the config bounds them.
    """
    modes = {"fail": "error", "replace": "overwrite", "append": "append"}
    if if_exists not in modes:
        raise ValueError(f"if_exists must be one of {', '.join(modes)}")
    writer = df.write.format("jdbc").options(**options(config), dbtable=table, batchsize=str(chunk))
    if config.get("numPartitions"):
        writer = writer.option("numPartitions", str(config["numPartitions"]))
    writer.mode(modes[if_exists]).save()
    return df.sparkSession.read.format("jdbc").options(**options(config), query=f"SELECT COUNT(*) AS n FROM {table}").load()
