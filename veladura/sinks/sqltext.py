"""SQL scripts as distributed text: DDL next to INSERT batches, valid file by file."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veladura.functions.sqltext import create_statement, insert_head, measures_of, profile_frame, row_literal
from veladura.operators.numbering import PLACE, Staged, numbered, staged
from veladura.sources import jdbc

# Fixed value: rows per INSERT of a script.
BATCH = 500


def batches(rows: Staged, columns: list[Column], row_id: str | None, size: int) -> DataFrame:
    """(batch, first, rows): the columns of ``size`` rows each (the last batch: the rest), in order; first is the first row's number."""
    listed = numbered(rows, row_id).select(F.expr(f"row_ix div {int(size)}").alias("batch"), F.struct("row_ix", *columns).alias("__row"))
    grouped = listed.groupBy("batch").agg(F.array_sort(F.collect_list("__row")).alias("rows"))
    return grouped.select("batch", F.col("rows")[0]["row_ix"].alias("first"), "rows")


def insert_batches(df: DataFrame | Staged, table: str, dialect: str = "mysql", row_id: str | None = None, size: int = BATCH) -> DataFrame:
    """One multi-row INSERT per ``size`` rows, whatever gaps the ids have: (batch, statement). Rows in id order, or as they come."""
    rows = df if isinstance(df, Staged) else staged(df)
    plain = rows.frame.drop(PLACE)
    listed = batches(rows, [row_literal(plain, dialect=dialect).alias("text")], row_id, size)
    values = F.array_join(F.transform("rows", lambda r: r["text"]), ",\n")
    return listed.select("batch", F.concat(F.lit(insert_head(plain, table, dialect) + "\n"), values, F.lit(";")).alias("statement"))


def single_inserts(df: DataFrame, table: str, dialect: str = "mysql") -> DataFrame:
    """One INSERT per row, booleans as digits."""
    head = insert_head(df, table, dialect)
    return df.select(F.concat(F.lit(head + " "), row_literal(df, "digits", dialect), F.lit(";")).alias("statement"))


def script_header(rows: Staged, table: str, dialect: str) -> DataFrame:
    """Comment lines and DDL, from what was measured while the rows were staged."""
    rule = "-- " + "=" * 44
    plain = rows.frame.drop(PLACE)
    lines = [
        F.lit(rule), F.lit(f"-- table {table} for {dialect}"), F.concat(F.lit("-- rows "), F.col("__rows").cast("string")),
        F.lit(rule), create_statement(plain, table, dialect),
    ]
    return profile_frame(plain, rows.measures).select(F.concat_ws("\n", *lines).alias("statement"))


def write_script(
    df: DataFrame | Staged, path: str, table: str = "datos", dialect: str = "mysql", row_id: str | None = None,
    size: int = BATCH, mode: str = "error",
) -> int:
    """Script folder: ``ddl`` with header and CREATE TABLE, ``inserts`` with the batches; the frame is computed once. Returns the rows."""
    rows = df if isinstance(df, Staged) else staged(df, measures_of(df))
    script_header(rows, table, dialect).coalesce(1).write.mode(mode).text(f"{path}/ddl")
    insert_batches(rows, table, dialect, row_id, size).select("statement").write.mode(mode).text(f"{path}/inserts")
    return rows.rows


def write_sql(
    df: DataFrame, mode: str = "script", path: str | None = None, table: str = "datos",
    connection: Mapping[str, object] | None = None, if_exists: str = "append", **script,
) -> None:
    """Script, live load, or both from one computation of the frame; a live load without a connection is an error, not a half success."""
    if mode not in ("script", "live", "both"):
        raise ValueError(f"unknown SQL mode {mode!r}")
    if mode != "script" and not connection:
        raise ValueError("a live load needs a connection")
    if mode != "live" and not path:
        raise ValueError("a script needs a path")
    if mode == "live":
        jdbc.write_table(df, connection, table, if_exists)
        return
    rows = staged(df, measures_of(df))
    write_script(rows, path, table, **script)
    if mode == "both":
        jdbc.write_table(rows.frame.drop(PLACE), connection, table, if_exists)
