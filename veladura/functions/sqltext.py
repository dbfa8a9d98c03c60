"""SQL text: identifiers, literals, types and statements by dialect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Identifier quotes and column types.
QUOTES = {"mysql": "`", "postgresql": '"', "sqlserver": '"'}
TEXT_LIMIT, VARCHAR_LIMIT, SHORT_VARCHAR, MARGIN, LONGEST_VARCHAR = 1000, 255, 255, 10, 4000


def quote_ident(name: str, dialect: str = "mysql") -> str:
    quote = QUOTES.get(dialect, "")
    return f"{quote}{name.replace(quote, quote * 2) if quote else name}{quote}"


def quoted_ident(name: Column, dialect: str = "mysql") -> Column:
    """The same for names that stand in a column, such as those of a table list."""
    quote = QUOTES.get(dialect, "")
    return F.concat(F.lit(quote), F.replace(name, F.lit(quote), F.lit(quote * 2)), F.lit(quote)) if quote else name


def escape(text: Column, dialect: str = "") -> Column:
    """Quotes doubled; for MySQL, whose strings read backslashes as escapes, those too."""
    if dialect == "mysql":
        text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(text, F.lit("'"), F.lit("''"))


def time_text(column: Column) -> Column:
    """Timestamp as text, to the second or, where there are any, with microseconds."""
    seconds, micros = F.date_format(column, "yyyy-MM-dd HH:mm:ss"), F.date_format(column, "SSSSSS")
    return F.when(micros == "000000", seconds).otherwise(F.concat(seconds, F.lit("."), micros))


def plain_number(value: Column) -> Column:
    """Double as text, without an exponent where a decimal holds exactly the same double."""
    text = value.cast("string")
    exact = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", ".0")
    return F.when(F.contains(text, F.lit("E")) & (exact.try_cast("double") == text.try_cast("double")), exact).otherwise(text)


def literal(column: Column, kind: T.DataType, bool_style: str = "words", dialect: str = "") -> Column:
    """SQL literal of a cell; ``bool_style`` is words (TRUE, FALSE) or digits (1, 0)."""
    if isinstance(kind, T.BooleanType):
        yes, no = ("TRUE", "FALSE") if bool_style == "words" else ("1", "0")
        text = F.when(column, yes).otherwise(no)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        finite = ~F.isnan(column) & (F.abs(column) < F.lit(float("inf")))
        return F.when(column.isNotNull() & finite, plain_number(column)).otherwise(F.lit("NULL"))
    elif isinstance(kind, T.NumericType):
        text = column.cast("string")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.concat(F.lit("'"), time_text(column), F.lit("'"))
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        text = F.concat(F.lit("'"), escape(F.to_json(column), dialect), F.lit("'"))
    else:
        text = F.concat(F.lit("'"), escape(column.cast("string"), dialect), F.lit("'"))
    return F.when(column.isNull(), F.lit("NULL")).otherwise(text)


def row_literal(df: DataFrame, bool_style: str = "words", dialect: str = "") -> Column:
    """``(v1, v2, ...)`` for a row."""
    cells = [literal(F.col(f"`{f.name}`"), f.dataType, bool_style, dialect) for f in df.schema.fields]
    return F.concat(F.lit("("), F.concat_ws(", ", *cells), F.lit(")"))


def insert_head(df: DataFrame, table: str, dialect: str) -> str:
    columns = ", ".join(quote_ident(c, dialect) for c in df.columns)
    return f"INSERT INTO {quote_ident(table, dialect)} ({columns}) VALUES"


DECIMAL_DIGITS, AMOUNT_DIGITS, AMOUNT_SCALE = 38, 15, 2
# The type of a binary floating-point number.
DOUBLES = {"mysql": "DOUBLE", "postgresql": "DOUBLE PRECISION", "sqlserver": "FLOAT(53)"}


def sql_type(kind: T.DataType, stats: Column, dialect: str = "mysql") -> Column:
    """Column type that holds every value of a Spark type.

    stats: for texts the longest value's length; for doubles (whole digits, decimals, all plain) of the values, see
    ``measures_of``: a decimal if one holds them all, else the dialect's floating-point type.
    """
    if isinstance(kind, T.LongType):
        return F.lit("BIGINT")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return F.lit("INT")
    if isinstance(kind, T.DecimalType):
        return F.lit(f"DECIMAL({kind.precision},{kind.scale})")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        scale = F.greatest(F.coalesce(stats["scale"], F.lit(0)), F.lit(AMOUNT_SCALE))
        digits = F.greatest(F.coalesce(stats["whole"], F.lit(0)) + scale, F.lit(AMOUNT_DIGITS))
        fits = F.coalesce(stats["plain"], F.lit(True)) & (digits <= DECIMAL_DIGITS)
        decimal = F.concat(F.lit("DECIMAL("), digits.cast("string"), F.lit(","), scale.cast("string"), F.lit(")"))
        return F.when(fits, decimal).otherwise(DOUBLES.get(dialect, "DOUBLE"))
    if isinstance(kind, T.BooleanType):
        return F.lit("BOOLEAN")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.lit("TIMESTAMP")
    n = F.coalesce(stats, F.lit(0))
    size = F.when(n > VARCHAR_LIMIT, F.least(n, F.lit(LONGEST_VARCHAR))).otherwise(F.greatest(F.lit(SHORT_VARCHAR), n + MARGIN))
    return F.when(n > TEXT_LIMIT, "TEXT").otherwise(F.concat(F.lit("VARCHAR("), size.cast("string"), F.lit(")")))


def _is_double(f: T.StructField) -> bool:
    return isinstance(f.dataType, (T.DoubleType, T.FloatType))


def _is_text(f: T.StructField) -> bool:
    return not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.TimestampType, T.TimestampNTZType))


def measures_of(df: DataFrame) -> list[Column]:
    """Aggregates that column types need, by the column's place: the longest text, digits and decimals of doubles.

    A double's digits are those of the text that is exported; what that text has no plain form of (an exponent) fits no decimal.
    """
    found = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        if _is_double(f):
            shown = plain_number(c)
            finite = ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
            fraction = F.regexp_replace(F.substring_index(shown, ".", -1), "0+$", "")
            found += [
                F.max(F.when(finite, F.length(F.regexp_replace(F.substring_index(shown, ".", 1), "^-|^-?0$", "")))).alias(f"__{i}_whole"),
                F.max(F.when(finite, F.length(fraction))).alias(f"__{i}_scale"),
                F.min(F.when(finite, ~F.contains(shown, F.lit("E")))).alias(f"__{i}_plain"),
            ]
        elif _is_text(f):
            shown = F.to_json(c) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else c.cast("string")
            found.append(F.max(F.length(shown)).alias(f"__{i}_length"))
    return found


def table_profile(df: DataFrame) -> DataFrame:
    """Row count and the measures that column types need, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("__rows"), *measures_of(df))


def profile_frame(df: DataFrame, measures: dict[str, object]) -> DataFrame:
    """The same one row from measures that were observed while the frame was written."""
    kinds = {"rows": "bigint", "length": "int", "whole": "int", "scale": "int", "plain": "boolean"}
    schema = ", ".join(f"`{k}` {kinds[k.rsplit('_', 1)[1]]}" for k in measures)
    return df.sparkSession.createDataFrame([tuple(measures.values())], schema)


def create_statement(df: DataFrame, table: str, dialect: str) -> Column:
    """CREATE TABLE text over the one-row profile of a frame."""
    def stats(i: int, f: T.StructField) -> Column:
        if _is_double(f):
            return F.struct(*(F.col(f"__{i}_{k}").alias(k) for k in ("whole", "scale", "plain")))
        return F.col(f"__{i}_length") if _is_text(f) else F.lit(None).cast("int")

    lines = [F.concat(F.lit(f"    {quote_ident(f.name, dialect)} "), sql_type(f.dataType, stats(i, f), dialect)) for i, f in enumerate(df.schema.fields)]
    return F.concat(F.lit(f"CREATE TABLE {quote_ident(table, dialect)} (\n"), F.concat_ws(",\n", *lines), F.lit("\n);"))


def create_table(df: DataFrame, table: str, dialect: str = "mysql") -> DataFrame:
    """One-row frame with the CREATE TABLE statement."""
    return table_profile(df).select(create_statement(df, table, dialect).alias("statement"))
