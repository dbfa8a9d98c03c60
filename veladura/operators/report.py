"""Reports over hits and tables: each is one partial and one final aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXTRA_WIDTH, MAX_WIDTH = 3, 50


def pii_totals(marked: DataFrame, hits: str = "hits") -> DataFrame:
    """Hits, texts with hits and texts read, from a frame with a hit array."""
    return marked.agg(
        F.sum(F.size(hits)).cast("bigint").alias("total_hits"),
        F.count_if(F.size(hits) > 0).alias("texts_with_hits"),
        F.count("*").alias("texts"),
    )


def pii_by_type(marked: DataFrame, hits: str = "hits", by: Sequence[str] = ()) -> DataFrame:
    """Hits per type; only the type leaves the hit array, so the exploded rows stay narrow."""
    kinds = F.transform(hits, lambda h: h["type"])
    rows = marked.select(*by, F.explode(kinds).alias("type"))
    return rows.groupBy(*by, "type").agg(F.count("*").alias("n"))


def by_count(counts: DataFrame, name: str = "type", n: str = "n") -> DataFrame:
    """Most frequent first, ties by name."""
    return counts.orderBy(F.desc(n), F.asc(name))


def pii_values(hits: Column) -> Column:
    """Distinct values per type of one text, both in order of first appearance."""
    kinds = F.array_distinct(F.transform(hits, lambda h: h["type"]))
    return F.transform(
        kinds,
        lambda k: F.struct(
            k.alias("type"),
            F.array_distinct(F.transform(F.filter(hits, lambda h: h["type"] == k), lambda h: h["value"])).alias("values"),
        ),
    )


def distinct_values(marked: DataFrame, hits: str, key: str) -> DataFrame:
    """Distinct values per type over the whole table, with their first place and count."""
    pairs = F.transform(hits, lambda h: F.struct(h["type"].alias("type"), h["value"].alias("value"), h["start"].alias("start")))
    rows = marked.select(key, F.explode(pairs).alias("__p"))
    return rows.groupBy(F.col("__p.type").alias("type"), F.col("__p.value").alias("value")).agg(
        F.min(F.struct(F.col(key), F.col("__p.start").alias("start"))).alias("__first"), F.count("*").alias("n")
    ).select("type", "value", F.col(f"__first.{key}").alias("first_id"), F.col("__first.start").alias("first_start"), "n")


def max_lengths(df: DataFrame) -> DataFrame:
    """Longest text form of every column, in one pass over the table."""
    longest = df.agg(*[F.max(F.length(F.col(f"`{c}`").cast("string"))).alias(c) for c in df.columns])
    return longest.unpivot([], df.columns, "column", "max_len")


def column_widths(df: DataFrame) -> DataFrame:
    """Display width of a column: longest value or header plus a margin, at most fifty."""
    longest = max_lengths(df)
    need = F.greatest(F.coalesce("max_len", F.lit(0)), F.length("column")) + EXTRA_WIDTH
    return longest.select("column", F.least(need, F.lit(MAX_WIDTH)).alias("width"))


def preview(df: DataFrame, k: int, order: Sequence[str | Column]) -> DataFrame:
    """First k rows; the limit is part of the sort, so each task keeps k rows."""
    return df.orderBy(*order).limit(k)


def preview_groups(df: DataFrame, by: Sequence[str], k: int, order: Sequence[str | Column]) -> DataFrame:
    """First k rows of every group with their ``place`` and how many ``more`` the group has.

    The limit on the place reaches below the shuffle, so a task hands on k rows of a group at most, and a group of any
    size is one count per task.
    """
    first = df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)
    counts = df.groupBy(*by).agg(F.count("*").alias("__n"))
    same = [F.col(f"__f.{c}").eqNullSafe(F.col(f"__c.{c}")) for c in by]
    joined = first.alias("__f").join(counts.alias("__c"), same)
    return joined.select(*[F.col(f"__f.{c}") for c in by], F.col("place"), *[F.col(f"__f.{c}") for c in df.columns if c not in by], F.greatest(F.col("__n") - k, F.lit(0)).alias("more"))
