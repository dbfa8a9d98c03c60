"""Benchmark decontamination over templates, in DataFrame functions only.

A text becomes template words: numbers, units after a number, and names (capitalised words inside a sentence) turn into
typed placeholders, the rest is lower-cased; signs are dropped. Windows of WINDOW template words are hashed and joined
with those of the benchmark, so a question with other numbers, names or units is met too. Then the slots are checked
per occurrence (the hits of one document and item at one distance of their places): a value of the item stands for one
value of the document, which may stand for several; a window whose slots break the prevailing mapping does not count,
one with the item's own values always does. A document is contaminated by an item if the distinct windows left, of all
its occurrences, are at least SHARE of the item's, or if RUN words of one occurrence in a row are covered by them, so that
a passage of a long item is met whatever its share; same_values tells that each of them is met with the item's values.

What stands before a window must not decide whether it matches, nor the case of its letters. So a window is hashed in
several forms, in documents and items alike: its first word as its template word, as literal and, if capitalised, as
name; all of it also with names as literals; and as plain lower-cased words where numbers and units leave fewer than
LITERALS others. A copy of the same words, in any case, always meets a form of every window.

Rows: windows of texts shorter than WINDOW words do not exist, except that a benchmark item with fewer words is one
window of its own, sought among windows of its length; forms with fewer than LITERALS words outside placeholders
(or half of a short item) tell nothing and are left out; windows without a telling template form count in the share only
if the item has no others; null and empty texts match nothing; equal rows are one document, texts of one id, or without an
id, are judged apart; items of one text are all reported; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veladura.llm.common import fresh, id_and_text, written

WINDOW = 8
SHARE = 0.3
RUN = 13
LITERALS = 4
BROADCAST_ROWS = 1_000_000
# The table of an item's grams is part of the plan, whose text the driver keeps several times: at most 64 KB, of seven slots to
# a byte, so that each byte is a character.
BYTES_LEAST, BYTES_MOST, SLOTS = 1 << 14, 1 << 16, 7
# Stands for a null id in joins, so -2^63 itself is shown as null.
NULL_ID = -(2**63)
# Measure words that are units after a number.
UNITS = (
    "kg g mg lb lbs oz ton tons km m cm mm mi mile miles yard yards ft foot feet inch inches meter meters metre metres kilometer kilometers kilometre kilometres "
    "l ml liter liters litre litres gallon gallons hour hours minute minutes second seconds day days week weeks month months year years percent dollar dollars "
    "euro euros pound pounds cent cents usd eur gbp kmh mph celsius fahrenheit degrees watt watts volt volts joule joules gb mb kb"
).split()
MARK = "\u0001"


SPACES = " \t\n\x0b\x0c\r"


def marked(text: Column) -> Column:
    """The text with spaces for signs, and MARK before each word that follows the end of a sentence or line."""
    signs = F.regexp_replace(text, r"[^\p{L}\p{N}\s.!?,]+|,(?![0-9])", " ")
    return F.btrim(F.regexp_replace(signs, r"(?:(?:[.!?]+(?![\p{L}\p{N}])|\n)\s*)+", f" {MARK}"), F.lit(SPACES + MARK))


def cut(text: Column) -> Column:
    """Words of a text; none of an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, r"\s+"))


def bare(mark: Column) -> Column:
    return F.replace(mark, F.lit(MARK), F.lit(""))


def capitalised(w: Column, low: Column) -> Column:
    """Like a name: a capital first, but not all of them."""
    return (F.left(w, F.lit(1)) != F.left(low, F.lit(1))) & ((F.length(w) == 1) | (w != F.upper(w)))


def template_word(b: Column, j: Column) -> Column:
    """struct<t, v, n, c> of word j, from 0: template word, lower-cased word, template word with names as literals, capitalised like a name.

    b: struct of the words with their marks (mark)."""
    number = lambda w: F.when(F.left(w, F.lit(1)).between("0", "9"), w.rlike(r"^[0-9][0-9.,]*$")).otherwise(False)
    before = F.coalesce(F.get(b["mark"], j - 1), F.lit(""))
    told = F.transform(F.array(F.get(b["mark"], j)), lambda m: F.struct(bare(m).alias("w"), F.lower(bare(m)).alias("low"), ((j == 0) | F.startswith(m, F.lit(MARK))).alias("first")))

    def of_word(x: Column) -> Column:
        w, low, first = x["w"], x["low"], x["first"]
        capital = capitalised(w, low)
        kind = F.when(number(w), "#num").when(low.isin(UNITS) & ~first & number(bare(before)), "#unit")
        return F.struct(kind.when(capital & ~first, "#name").otherwise(low).alias("t"), low.alias("v"), kind.otherwise(low).alias("n"), capital.alias("c"))

    return F.transform(told, of_word)[0]


def templates(text: Column) -> Column:
    """array<struct<t, v, n, c>>: the template words of a text."""
    # Arrays of one element bind what several parts of a lambda use, so it is computed once a row.
    bound = F.transform(F.array(marked(text)), lambda m: F.struct(cut(m).alias("mark")))
    return F.transform(bound, lambda b: F.transform(b["mark"], lambda w, j: template_word(b, j)))[0]


def windows(words: Column, size: Column, telling: bool = False) -> Column:
    """array<array<hash>>: the distinct forms of all windows of a size, by place; telling: only forms with enough literals."""
    least = F.least(F.lit(LITERALS), F.ceil(size / 2))
    other = lambda w: (~w.startswith("#")).cast("int")
    hashed = F.transform(words, lambda x: F.struct(F.xxhash64(x["t"]).alias("t"), F.xxhash64(x["v"]).alias("v"), F.xxhash64(x["n"]).alias("n"), x["c"].alias("c"), other(x["t"]).alias("lt"), other(x["n"]).alias("ln")))
    columns = F.transform(F.array(hashed), lambda x: F.struct(*[x[k].alias(k) for k in ("t", "v", "n", "c", "lt", "ln")]))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def forms(b: Column, i: Column) -> Column:
        """i: place of the first word, from 1."""
        at = lambda k: F.get(b[k], i - 1)
        part = lambda k: F.slice(b[k], i + 1, size - 1)
        # Fewer than LITERALS - 1 literals in a row of WINDOW - 1 words leave a placeholder among any LITERALS - 1 of them.
        some = lambda i: F.get(b["ln"], i) + F.get(b["ln"], i + 1) + F.get(b["ln"], i + 2) < LITERALS - 1
        few = lambda i: (size == WINDOW) & some(i) & (total(part("ln")) + 1 < LITERALS)
        bound = F.array(F.struct(F.xxhash64(part("t")).alias("t"), F.xxhash64(part("n")).alias("n"), few(i).alias("plain"), (F.lit(0) if not telling else total(part("ln"))).alias("ln"), (F.lit(0) if not telling else total(part("lt"))).alias("lt")))

        def of(r: Column) -> Column:
            told = lambda count, h, also=F.lit(True): F.when(also & (count >= least), h) if telling else F.when(also, h)
            every = F.array_compact(
                F.array(
                    told(r["lt"] + at("lt"), F.xxhash64(at("t"), r["t"])), told(r["lt"] + 1, F.xxhash64(at("v"), r["t"])), told(r["lt"], F.xxhash64(F.xxhash64(F.lit("#name")), r["t"]), at("c")),
                    told(r["ln"] + at("ln"), F.xxhash64(at("n"), r["n"])), told(r["ln"] + 1, F.xxhash64(at("v"), r["n"])), F.when(r["plain"], F.xxhash64(F.slice(b["v"], i, size))),
                )
            )
            if telling:
                return F.array_distinct(every)
            # Most windows have one form only: no name, number or unit first, the rest equal with names as literals.
            return F.when((at("t") == at("v")) & ~at("c") & (r["t"] == r["n"]) & ~r["plain"], F.array(F.xxhash64(at("t"), r["t"]))).otherwise(F.array_distinct(every))

        return F.transform(bound, of)[0]

    every = lambda b: F.when(F.size(b["t"]) >= size, F.transform(F.sequence(F.lit(1), F.size(b["t"]) - size + 1), lambda i: forms(b, i)))
    return F.transform(columns, every)[0]


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(size, h, item_id, place, key, counts, slots, v, all): the forms of every item's windows.

    key: the window as the item has it; counts: it counts in the share; all: how many do; slots: places of its
    placeholders; v: its words."""
    items = benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), templates(F.coalesce(F.col(text_col), F.lit(""))).alias("words")).where("size(words) > 0").dropDuplicates()
    sized = items.withColumn("size", F.least(F.lit(WINDOW), F.size("words")))
    cut = sized.select("item_id", "size", "words", F.posexplode(windows(F.col("words"), F.col("size"), telling=True)).alias("place", "h")).withColumn("w", F.slice("words", F.col("place") + 1, F.col("size")))
    literal = F.size(F.filter("w", lambda x: ~x["t"].startswith("#")))
    told = cut.withColumn("told", literal >= F.least(F.lit(LITERALS), F.ceil(F.col("size") / 2))).withColumn("key", F.xxhash64(F.transform("w", lambda x: x["t"])))
    places = F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.get("w", i)["t"].startswith("#") | ((i == 0) & F.get("w", i)["c"]))
    rows = told.select("size", F.explode("h").alias("h"), "item_id", "place", "key", "told", places.alias("slots"), F.transform("w", lambda x: x["v"]).alias("v"))
    count = rows.groupBy("item_id").agg(F.countDistinct(F.when(F.col("told"), F.col("key"))).alias("n_told"), F.countDistinct("key").alias("n_any"))
    counted = rows.join(count, "item_id").withColumn("counts", F.col("told") | (F.col("n_told") == 0))
    return counted.select("size", "h", "item_id", "place", "key", "counts", "slots", "v", F.when(F.col("n_told") > 0, F.col("n_told")).otherwise(F.col("n_any")).alias("all"))


ANY, GRAM = "*", 3


def item_grams(items: DataFrame, size: int) -> bytes:
    """A table of slots, SLOTS bits of every byte, one set for each that the hash of GRAM neighbouring words of an item falls in, any of which may also be ANY.

    Words whose slot is not set stand together in no item of windows of that size.
    """
    gram = min(GRAM, size)
    told = lambda j: [F.array(F.get("v", j + k), F.lit(ANY)) for k in range(gram)]
    grams = items.where(F.col("size") == size).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(size - gram)), lambda j: F.struct(*(x.alias(f"w{k}") for k, x in enumerate(told(j)))))).alias("g")).select("g.*").distinct()
    for k in range(gram):
        grams = grams.withColumn(f"w{k}", F.explode(f"w{k}"))
    grams = grams.distinct()
    size_of_table = min(BYTES_MOST, max(BYTES_LEAST, 1 << (4 * grams.count()).bit_length()))
    byte, bit = slot(F.xxhash64(*grams.columns), size_of_table)
    table = bytearray(size_of_table)
    for row in grams.select(byte.alias("byte"), bit.alias("bit")).groupBy("byte").agg(F.expr("bit_or(shiftleft(1, bit))").alias("bits")).collect():
        table[row.byte] = row.bits
    return bytes(table)


def slot(h: Column, size_of_table: int) -> tuple[Column, Column]:
    """Byte and bit of a hash in a table."""
    return F.pmod(h, F.lit(size_of_table)).cast("int"), F.pmod(F.shiftrightunsigned(h, 32), F.lit(SLOTS)).cast("int")


def candidates(mark: Column, size: int, table: bytes) -> Column:
    """array<struct<at, forms>>: the windows of a marked text whose neighbouring words may all stand together in an item, and their forms.

    In every form of a window a word is a number, a unit, capitalised (ANY here), or itself one of an item's words, beside
    its neighbours there. Each window holds a gram whose place is a multiple of its number of grams, so those are looked at
    first, and the windows around them only where they are set. No window that meets an item is left out, while of common
    text few stay; only for those template words are formed.
    """
    gram = min(GRAM, size)
    step = size - gram + 1

    def word(b: Column, j: Column) -> Column:
        def told(w: Column) -> Column:
            low, first = F.lower(w), F.left(w, F.lit(1))
            return F.when(capitalised(w, low) | first.between("0", "9") | low.isin(UNITS), ANY).otherwise(low)

        return F.transform(F.array(bare(F.get(b["mark"], j))), told)[0]

    def hit(b: Column, j: Column) -> Column:
        def is_set(h: Column) -> Column:
            byte, bit = slot(h, len(table))
            return F.getbit(F.ascii(F.substring(F.lit(table), byte + 1, F.lit(1)).cast("string")), bit) == 1

        return F.transform(F.array(F.xxhash64(*(word(b, j + k) for k in range(gram)))), is_set)[0]

    def near(b: Column, j: Column) -> Column:
        """Starts of the windows that hold the gram at j and have only set grams."""
        low, high = F.greatest(j - (step - 1), F.lit(0)), F.least(j, F.size(b["mark"]) - size)
        return F.when(low <= high, F.filter(F.sequence(low, high), lambda i: F.forall(F.sequence(i, i + (step - 1)), lambda k: hit(b, k)))).otherwise(F.array().cast("array<int>"))

    def of_text(b: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(b["mark"]) - gram, F.lit(step))
        starts = F.flatten(F.transform(F.filter(places, lambda j: hit(b, j)), lambda j: near(b, j)))
        window = lambda i: F.transform(F.sequence(i, i + (size - 1)), lambda j: template_word(b, j))
        return F.when(F.size(b["mark"]) >= size, F.transform(starts, lambda i: F.struct(i.alias("at"), windows(window(i), F.lit(size))[0].alias("forms"))))

    return F.transform(F.transform(F.array(mark), lambda m: F.struct(cut(m).alias("mark"))), of_text)[0]


def _leaks(docs: DataFrame, benchmark: DataFrame, share: float, id_col: str, text_col: str) -> DataFrame:
    """The same as leaks, by text: digest tells texts of one id apart."""
    none = F.lit(NULL_ID)
    texts = id_and_text(docs, id_col, text_col).withColumns({"doc_id": F.coalesce("doc_id", none), "digest": F.xxhash64("text")})
    items = written(item_windows(benchmark), "decontam-items")
    n, sizes = items.count(), [r["size"] for r in items.select("size").distinct().collect()]
    keys = items.select("size", "h").distinct()
    # The benchmark's windows are broadcast up to a stated number of rows of 16 bytes; beyond it the optimizer decides.
    small = (lambda x: F.broadcast(x)) if n <= BROADCAST_ROWS else (lambda x: x)
    texts_marked = texts.select("doc_id", "digest", marked(F.col("text")).alias("mark"))
    found = None
    for size in sorted(sizes):
        table = item_grams(items, size)
        places = texts_marked.select("doc_id", "digest", F.explode(candidates(F.col("mark"), size, table)).alias("x")).select("doc_id", "digest", "x.at", F.explode("x.forms").alias("h"), F.lit(size).alias("size"))
        hits = places.join(small(keys.where(F.col("size") == size)), ["size", "h"]).select("doc_id", "digest", "size", "h", "at")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, digest bigint, item_id bigint, n_matched bigint, n_windows bigint, share double, same_values boolean")
    hits = written(found.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("size", "h", "at")).alias("hits")), "decontam-hits")
    # Only documents with hits are read again, for the values in their slots.
    few = hits.count()
    side = F.broadcast(hits) if few <= BROADCAST_ROWS // 50 else hits
    values = texts.dropDuplicates(["doc_id", "digest"]).join(side, ["doc_id", "digest"]).select("doc_id", "digest", "hits", templates(F.col("text")).alias("words"))
    own = F.transform("hits", lambda x: F.struct(x["size"].alias("size"), x["h"].alias("h"), x["at"].alias("at"), F.transform(F.slice("words", x["at"] + 1, x["size"]), lambda y: y["v"]).alias("own")))
    met = values.select("doc_id", "digest", F.explode(own).alias("x")).select("doc_id", "digest", "x.*")
    # One row per window of an occurrence, whatever forms it was met in.
    few_items = F.broadcast(items) if n <= BROADCAST_ROWS // 10 else items
    aligned = met.join(few_items, ["size", "h"]).withColumn("lag", F.col("at") - F.col("place")).drop("h").distinct()
    joined = written(aligned.withColumn("same", F.col("v") == F.col("own")), "decontam-met")
    occurrence = ["doc_id", "digest", "item_id", "lag"]
    both = F.transform("slots", lambda i: F.struct(F.get("v", i).alias("theirs"), F.get("own", i).alias("ours")))
    pairs = joined.select(*occurrence, "place", F.explode(both).alias("s")).select(*occurrence, "place", "s.theirs", "s.ours")
    counted = pairs.groupBy(*occurrence, "theirs", "ours").agg(F.struct(F.count("*").alias("c"), (-F.min("place")).alias("first")).alias("rank"))
    # Among equals the values that come first in the item prevail, so ties keep one stretch of it whole.
    best = counted.groupBy(*occurrence, "theirs").agg(F.max_by("ours", "rank").alias("ours"))
    holding = best.groupBy(*occurrence).agg(F.map_from_entries(F.collect_list(F.struct("theirs", "ours"))).alias("holding"))
    checked = joined.join(holding, occurrence, "left")
    consistent = checked.where(F.col("same") | F.forall("slots", lambda i: F.col("holding")[F.get("v", i)] == F.get("own", i)))
    kept = F.when(F.col("counts"), F.col("key"))
    total = consistent.groupBy("doc_id", "digest", "item_id").agg(F.countDistinct(kept).cast("bigint").alias("n_matched"), F.max("all").cast("bigint").alias("n_windows"), F.countDistinct(F.when(F.col("same"), kept)).alias("n_same"))
    # Sorted distinct places are consecutive where the one `more` further on is `more` larger.
    more = RUN - WINDOW
    in_a_row = F.exists(F.transform("places", lambda x, i: F.get("places", i + more) - x), lambda d: d == more)
    covered = consistent.where(F.col("size") == WINDOW).groupBy(*occurrence).agg(F.array_sort(F.collect_set("place")).alias("places")).where(in_a_row).select(*occurrence[:3], F.lit(True).alias("run")).distinct()
    reported = total.join(covered, occurrence[:3], "left").withColumn("share", F.col("n_matched") / F.col("n_windows")).where((F.col("share") >= share) | F.col("run"))
    return reported.select(F.nullif("doc_id", none).alias("doc_id"), "digest", "item_id", "n_matched", "n_windows", "share", (F.col("n_same") == F.col("n_matched")).alias("same_values"))


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, share, same_values) of every contaminated document and item."""
    return _leaks(docs, benchmark, share, id_col, text_col).drop("digest")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text no item contaminates, all columns as they were; texts of one id, or without one, are judged apart."""
    ident, digest = fresh("leak_id", docs.columns), fresh("leak_digest", docs.columns)
    found = _leaks(docs, benchmark, SHARE, id_col, text_col).select(F.col("doc_id").alias(ident), F.col("digest").alias(digest)).distinct()
    bad = written(found, "decontam-bad")
    same = docs[id_col].cast("bigint").eqNullSafe(bad[ident]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == bad[digest])
    return docs.join(bad, same, "left_anti")
