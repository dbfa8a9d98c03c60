"""Merkle fingerprints over sections, paragraphs and the pieces of a paragraph, in SQL functions only.

A section ends after an empty line, a paragraph after a line break, a piece (the leaf) after a sign of punctuation or
a word end in r or s, so that texts without sentences have leaves too. All cuts are zero-width, so the leaves hold
every character and the root tells any two texts apart. The fingerprint is text:

    root;S<section>;P<paragraph>;<leaf>;<leaf>;P...;S...

root: 64 hexadecimal digits over the section hashes, the others 8 digits, each over the level below. Equal roots mean
equal texts; a differing branch locates an edit; the likeness of two fingerprints is the Dice index of their leaves.

Rows: every input row gives one row; a null text is empty (one empty leaf); equal ids are ordered by text; null ids
come first; of a single row, the next row is itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from veladura.llm.common import id_and_text

SECTION, PARAGRAPH, PIECE = r"(?<=\n\n)(?!\n)", r"(?<=\n)(?!\n)", r"(?<=[rs\p{P}\p{S}] )"


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column that holds no null."""
    node = lambda kids: F.lpad(F.lower(F.hex(F.xxhash64(F.array_join(kids, ";")))), 16, "0")
    short = lambda kids: F.array_join(F.transform(kids, lambda h: F.left(h, F.lit(8))), ";")

    def paragraph(p: Column) -> Column:
        leaves = F.transform(F.split(p, PIECE), lambda s: F.lpad(F.lower(F.hex(F.xxhash64(s))), 16, "0"))
        return F.transform(F.array(leaves), lambda kids: F.struct(node(kids).alias("h"), short(kids).alias("below")))[0]

    def section(s: Column) -> Column:
        inner = F.transform(F.split(s, PARAGRAPH), paragraph)
        listed = lambda ps: F.array_join(F.transform(ps, lambda p: F.concat(F.lit("P"), F.left(p["h"], F.lit(8)), F.lit(";"), p["below"])), ";")
        return F.transform(F.array(inner), lambda ps: F.struct(node(F.transform(ps, lambda p: p["h"])).alias("h"), listed(ps).alias("below")))[0]

    sections = F.transform(F.split(text, SECTION), section)
    listed = lambda ss: F.array_join(F.transform(ss, lambda s: F.concat(F.lit("S"), F.left(s["h"], F.lit(8)), F.lit(";"), s["below"])), ";")
    root = lambda ss: F.sha2(F.array_join(F.transform(ss, lambda s: s["h"]), ";"), 256)
    return F.transform(F.array(sections), lambda ss: F.concat_ws(";", root(ss), listed(ss)))[0]


def leaves(print_: Column) -> Column:
    """Distinct leaf hashes of a fingerprint."""
    return F.array_distinct(F.filter(F.split(print_, ";"), lambda x: F.length(x) == 8))


def likeness(a: Column, b: Column) -> Column:
    """Twice the shared leaves over the leaves of both, 0 to 1; 1 for equal roots."""
    shared = F.transform(F.array(F.struct(leaves(a).alias("x"), leaves(b).alias("y"))), lambda p: 2 * F.size(F.array_intersect(p["x"], p["y"])) / (F.size(p["x"]) + F.size(p["y"])))[0]
    return F.when(a == b, 1.0).otherwise(shared)


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the paragraphs of b whose branch does not occur in a; sections alike are not entered."""
    paragraphs = lambda f: F.filter(F.split(f, ";"), lambda x: x.startswith("P"))
    kept = F.transform(F.array(F.struct(paragraphs(a).alias("x"), paragraphs(b).alias("y"))), lambda p: F.filter(F.transform(p["y"], lambda h, i: F.when(~F.array_contains(p["x"], h), i)), lambda i: i.isNotNull()))[0]
    return F.when(a == b, F.array().cast("array<int>")).otherwise(kept)


def dealt_with_next(frame: DataFrame, columns: list[str], ranges: int | None = None) -> tuple[DataFrame, WindowSpec]:
    """The rows dealt so that a lead over the returned window sees the next id (after the last: the first). Rows with __e = 1 are copies.

    Ids are dealt into ranges by their quantiles (one number per range reaches the driver). The first rows of a range
    are also dealt to the range before it, so no row needs a look beyond its own range and text moves once.
    """
    spark = frame.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or 4 * tasks
    marks = [k / ranges for k in range(1, ranges)]
    cuts = sorted(set(frame.select(F.percentile_approx("doc_id", marks, 10 * ranges)).head()[0] or []))
    if cuts:
        steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
        held = F.array(*map(F.lit, cuts))
        # Bisection: how many cuts are not above the id.
        place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when((at + s <= len(cuts)) & (F.get(held, at + s - 1) <= F.col("doc_id")), at + s).otherwise(at))
    else:
        place = F.lit(0)
    placed = frame.withColumn("__range", place)
    first = placed.groupBy("__range").agg(F.when(F.max(F.col("doc_id").isNull()), None).otherwise(F.min("doc_id")).alias("first")).collect()
    first.sort(key=lambda r: r["__range"])
    rows = [(r["first"], first[k - 1]["__range"], True) for k, r in enumerate(first)]  # the first of all goes to the last range
    copied = spark.createDataFrame(rows, "first bigint, __before int, __copied boolean")
    # One row per range: the bound of the broadcast.
    both = placed.join(F.broadcast(copied), F.col("doc_id").eqNullSafe(F.col("first")), "left")
    own = F.struct(F.col("__range").alias("r"), F.lit(0).alias("e"))
    dealt = F.explode(F.when(F.col("__copied"), F.array(own, F.struct(F.col("__before").alias("r"), F.lit(1).alias("e")))).otherwise(F.array(own)))
    spread = both.withColumn("__d", dealt).select(*frame.columns, F.col("__d.r").alias("__r"), F.col("__d.e").alias("__e")).repartition(tasks, "__r")
    return spread, Window.partitionBy("__r").orderBy("__e", "doc_id", *columns)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    return id_and_text(docs, id_col, text_col).select("doc_id", fingerprint(F.col("text")).alias("fingerprint"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text beside the text whose second half is the begin of the next document's, and both likenesses."""
    spread, order = dealt_with_next(id_and_text(docs, id_col, text_col), ["text"])
    own = spread.withColumn("fingerprint", fingerprint(F.col("text")))
    ahead = own.select("*", F.lead("text").over(order).alias("next_text"), F.lead("fingerprint").over(order).alias("next_fingerprint")).where("__e = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = ahead.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return edited.select(
        "doc_id", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
