"""Synthetic tables: named columns drawn for every row id."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veladura.functions.draws import DEFAULT_SEED, MASK32, MULTIPLIER_A, MULTIPLIER_B, DrawPlan, key32, scramble
from veladura.functions.families import AS_OF, EPOCH, Provider, build
from veladura.operators.catalogue import BASE, FALLBACK, FUZZY_KEYS, MAX_BROADCAST_ENTRIES, args_text, resolve, resolve_frame

ROWS_PER_PARTITION = 1_000_000


def _scramble_number(x: int) -> int:
    x ^= x >> 16
    x = (x * MULTIPLIER_A) & MASK32
    x ^= x >> 15
    x = (x * MULTIPLIER_B) & MASK32
    return x ^ (x >> 16)


def _column_draw(seed: int, column: str):
    """Draws for a value that is fixed for the whole column."""
    return lambda k: F.lit(_scramble_number(_scramble_number(key32(seed, column, k)))).cast("bigint")


def generate_over(
    rows: DataFrame,
    row_id: str,
    columns: Sequence[str],
    catalogue: Mapping[str, Provider] = BASE,
    seed: int = DEFAULT_SEED,
    keep: Iterable[str] = (),
    fixed: Iterable[str] = (),
    on_error: str = "raise",
    as_of: dt.date = AS_OF,
) -> DataFrame:
    """One synthetic row per input row; values depend on (seed, column, row id) only.

    A narrow projection: no shuffle, and unused columns are pruned with their
    draws. Dates are counted from ``as_of``. ``fixed`` columns get one value for the whole column. With
    ``on_error="mark"`` a column whose provider cannot be built holds
    ``ERROR_<column>`` instead of failing the plan.
    """
    if not columns:
        raise ValueError("at least one column is needed")
    plan, made = DrawPlan(seed), {}
    for name in dict.fromkeys(columns):
        provider = resolve(name, catalogue)
        draw = _column_draw(seed, name) if name in set(fixed) else lambda k, n=name: plan.draw(n, k)
        try:
            made[name] = build(provider, draw, (as_of - EPOCH).days)
        except (TypeError, ValueError):
            if on_error != "mark":
                raise
            made[name] = F.lit(f"ERROR_{name}")
    drawn = plan.apply(rows, row_id)
    return drawn.select(*keep, *[value.alias(name) for name, value in made.items()])


# Different providers that can be drawn by name: branches of one expression.
MAX_PROVIDERS = 1000


def generate_named(
    rows: DataFrame, row_id: str, name: str = "name", catalogue: Mapping[str, Provider] = BASE, seed: int = DEFAULT_SEED, out: str = "value", as_of: dt.date = AS_OF
) -> DataFrame:
    """Adds one value, as text, for the column name that a row holds: the same that ``generate_over`` draws for that column and row id.

    So rows may ask for columns of their own, such as the properties of each document's schema. Names are resolved by a
    join with the catalogue, then a CASE over its distinct providers draws; both have a checked size.
    """
    if len(catalogue) > MAX_BROADCAST_ENTRIES:
        raise ValueError(f"a catalogue may have at most {MAX_BROADCAST_ENTRIES} entries")
    if lacking := {FALLBACK, *(target for _, target in FUZZY_KEYS)} - set(catalogue):
        raise ValueError(f"the catalogue lacks names that others resolve to: {', '.join(sorted(lacking))}")
    by_text = {(p.family, args_text(p)): p for p in catalogue.values()}
    distinct, place = list(by_text.values()), {k: i for i, k in enumerate(by_text)}
    if len(distinct) > MAX_PROVIDERS:
        raise ValueError(f"at most {MAX_PROVIDERS} different providers can be drawn by name")
    day, needed = (as_of - EPOCH).days, {}
    for i, provider in enumerate(distinct):
        build(provider, lambda k, i=i: needed.setdefault(k, set()).add(i) or F.lit(0).cast("bigint"), day)
    kinds = rows.sparkSession.createDataFrame([(n, place[p.family, args_text(p)]) for n, p in catalogue.items()], "__entry string, __kind int")
    resolved = resolve_frame(rows.withColumn("__asked", F.col(name)), catalogue, "__asked").withColumnsRenamed({"provider": "__provider"})
    kept = [F.col(f"`{c}`") for c in rows.columns]
    joined = resolved.join(F.broadcast(kinds), F.col("__provider") == F.col("__entry")).drop("__provider", "how", "__entry")
    number = lambda k: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("__asked"), F.lit(f"|{k}"))), 1, 8), 16, 10).cast("bigint")
    keyed = joined.withColumns(
        {"__low": F.col(row_id).cast("bigint").bitwiseAND(F.lit(MASK32)), "__high": F.shiftrightunsigned(F.col(row_id).cast("bigint"), 32)}
        | {f"__key{k}": F.when(F.col("__kind").isin(sorted(ix)), number(k)) for k, ix in needed.items()}
    )
    others = [f"`{c}`" for c in (*rows.columns, "__kind")]
    first = keyed.selectExpr(*others, "__high", *[f"{scramble(f'(__low ^ __key{k})')} AS __first{k}" for k in needed])
    drawn = first.selectExpr(*others, *[f"{scramble(f'(__first{k} ^ __high)')} AS __draw{k}" for k in needed])

    def value(d: Column) -> Column:
        branches = F
        for i, provider in enumerate(distinct):
            branches = branches.when(d["kind"] == i, build(provider, lambda k: d[f"d{k}"], day).cast("string"))
        return branches

    # In a lambda the branches are no generated code: of all providers together that would be too long for the JVM.
    bound = F.array(F.struct(F.col("__kind").alias("kind"), *(F.col(f"__draw{k}").alias(f"d{k}") for k in needed)))
    return drawn.select(*kept, F.transform(bound, value)[0].alias(out))


def generate(
    spark: SparkSession,
    volume: int,
    columns: Sequence[str],
    catalogue: Mapping[str, Provider] = BASE,
    seed: int = DEFAULT_SEED,
    with_id: bool = False,
    rows_per_partition: int = ROWS_PER_PARTITION,
    **options,
) -> DataFrame:
    """``volume`` synthetic rows, the same for any partitioning; give more rows per partition for very large volumes."""
    if volume < 0:
        raise ValueError("volume must not be negative")
    parts = max(spark.sparkContext.defaultParallelism if volume > 10_000 else 1, -(-volume // rows_per_partition))
    ids = spark.range(0, volume, 1, parts).withColumnRenamed("id", "row_id")
    return generate_over(ids, "row_id", columns, catalogue, seed, keep=["row_id"] if with_id else [], **options)


def with_offset_date(df: DataFrame, start: str, out: str, low: int, high: int, row_id: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """Date that follows another column by ``low`` to ``high`` days, e.g. end after start."""
    plan = DrawPlan(seed)
    days = build(Provider("int_uniform", (low, high)), lambda k: plan.draw(out, k))
    kept = df.columns
    return plan.apply(df, row_id).select(*kept, F.date_add(F.col(start), days).alias(out))


def stress_volume(volume: Column) -> Column:
    """Larger volume for load tests: ten times, at most a million."""
    return F.least(volume * 10, F.lit(1_000_000))
