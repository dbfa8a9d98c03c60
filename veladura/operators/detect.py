"""Personal-data detection: an array of hits per text, computed row by row in one stage.

The work is split over projections because each step mentions its input several
times: shared gates, marked text per rule, parts per rule, hits. Columns of a table are
done one after the other, which keeps the generated code small. No shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veladura.functions.rules import (
    CONTEXT_CHARS,
    DIGIT_SHAPE,
    GATES,
    HAS_DIGIT,
    MIN_CONFIDENCE,
    OTHER_DIGIT,
    RULES,
    SHAPE_GATES,
    Rule,
    confidence,
    java_pattern,
)

# A code point that is not a character.
MARKER = "\uffff"
# Elements folded at once, characters of a piece of a long text.
BLOCK, PIECE = 32, 512

HIT = "struct<type:string,value:string,start:int,`end`:int,context:string,confidence:double>"
SPAN = "struct<rank:int,type:string,base:double,start:int,value:string>"
RANKED = "struct<start:int,minus:double,rank:int,type:string,value:string,`end`:int,context:string,confidence:double>"


def _parts(text: Column, marked: Column, rule: Rule) -> Column:
    """Text cut at the matches of a rule: gap, match, gap, match, ..., gap; null without a match.

    One pass of the pattern puts a marker on both sides of every match, and the text is cut at the
    markers. Texts that hold the marker themselves are cut by the pattern, gaps and matches apart.
    """
    pattern = java_pattern(rule)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    apart = F.flatten(F.transform(F.split(text, pattern, -1), lambda g, i: F.array(g, F.get(matches, i))))
    cut = F.split(marked, MARKER, -1)
    return F.when(
        F.contains(marked, F.lit(MARKER)),
        F.when(F.contains(text, F.lit(MARKER)), F.slice(apart, F.lit(1), F.size(matches) * 2 + 1)).otherwise(cut),
    )


def running(values: str, kind: str, start: str, join: str) -> str:
    """For every element of an array what the elements before it come to: sums or maxima, in linear time.

    No accumulator grows: totals of blocks, of blocks of blocks, and per element a fold over at most BLOCK neighbours
    on each level. An array of one block, as most texts give, is folded at once. ``join`` combines ``x`` and ``y``.
    """
    fold = lambda part: f"aggregate({part}, {start}, (x, y) -> cast({join} AS {kind}))"
    blocks = lambda v: f"CASE WHEN size({v}) = 0 THEN cast(array() AS array<{kind}>) ELSE transform(sequence(0, (size({v}) - 1) div {BLOCK}), b -> {fold(f'slice({v}, b * {BLOCK} + 1, {BLOCK})')}) END"
    before = lambda v, upper: f"transform({v}, (e, i) -> {fold(f'concat(array({upper}), slice({v}, i div {BLOCK} * {BLOCK} + 1, i % {BLOCK}))')})"
    top = f"transform(l.s2, (e, i) -> {fold('slice(l.s2, 1, i)')})"
    s1 = f"transform(array(v), v -> named_struct('v', v, 's1', {blocks('v')}))"
    s2 = f"transform({s1}, l -> named_struct('v', l.v, 's1', l.s1, 's2', {blocks('l.s1')}))"
    o2 = f"transform({s2}, l -> named_struct('v', l.v, 's1', l.s1, 'o2', {top}))"
    o1 = f"transform({o2}, l -> named_struct('v', l.v, 'o1', {before('l.s1', f'get(l.o2, i div {BLOCK})')}))"
    short = f"transform(v, (e, i) -> {fold('slice(v, 1, i)')})"
    long = f"transform({o1}, l -> {before('l.v', f'get(l.o1, i div {BLOCK})')})[0]"
    return f"transform(array({values}), v -> CASE WHEN size(v) <= {BLOCK} THEN {short} ELSE {long} END)[0]"


def stretch(text: str, pieces: str, start: str, size: str) -> str:
    """``size`` characters of a text from ``start`` (from 0), found in its pieces of PIECE characters.

    ``substr`` of a long text counts characters from its begin, for every hit anew.
    """
    first = f"({start}) div {PIECE}"
    joined = f"array_join(slice({pieces}, {first} + 1, (({start}) + ({size})) div {PIECE} - {first} + 1), '')"
    return f"CASE WHEN size({pieces}) = 0 THEN substr({text}, ({start}) + 1, {size}) ELSE substr({joined}, ({start}) % {PIECE} + 1, {size}) END"


def pieces_of(text: str) -> str:
    """Pieces of PIECE characters of a long text; none for a short one, where counting is cheaper."""
    return f"CASE WHEN octet_length({text}) > {4 * PIECE} THEN regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0) ELSE cast(array() AS array<string>) END"


def _spans(rules: Sequence[Rule]) -> str:
    """Start and value of every match of every rule: the odd parts, placed by the lengths before them.

    One lambda body serves all rules, so the plan does not grow with them.
    """
    listed = ", ".join(f"named_struct('type', '{r.type}', 'base', {r.confidence}D)" for r in rules)
    per_rule = f"""filter(transform(array({listed}), (r, j) -> named_struct(
      'rank', j, 'type', r.type, 'base', r.base, 'parts', get(__parts, j))), r -> size(r.parts) > 1)"""
    starts = running("transform(r.parts, p -> length(p))", "int", "0", "x + y")
    placed = f"zip_with(r.parts, {starts}, (p, at) -> named_struct('value', p, 'start', at))"
    hits = f"filter({placed}, (s, i) -> i % 2 = 1)"
    return f"""flatten(transform({per_rule}, r -> transform({hits}, s -> named_struct(
      'rank', r.rank, 'type', r.type, 'base', r.base, 'start', s.start, 'value', s.value))))"""


def _ranked_hits(text: str, spans: str) -> str:
    """Hits with context and confidence; the leading fields are the sort order of the overlap rule."""
    first = f"greatest(s.start - {CONTEXT_CHARS}, 0)"
    stop = "s.start + length(s.value)"
    contexts = f"""transform({spans}, s -> named_struct('s', s, 'stop', {stop},
      'context', {stretch(text, "__pieces", first, f"{stop} + {CONTEXT_CHARS} - {first}")}))"""
    scored = f"""transform({contexts}, c -> named_struct('c', c,
      'confidence', {confidence("c.s.type", "c.s.base", "c.s.value", "c.context")}))"""
    return f"""transform({scored}, h -> named_struct(
      'start', h.c.s.start, 'minus', -h.confidence, 'rank', h.c.s.rank, 'type', h.c.s.type, 'value', h.c.s.value,
      'end', h.c.stop, 'context', h.c.context, 'confidence', h.confidence))"""


def _without_overlaps(hits: str) -> str:
    """Hits in (start, -confidence, rule) order; a later one replaces the hit it overlaps only if more confident.

    Kept hits are disjoint and arrive by start, so only the last kept one can overlap the next. A hit that starts
    where all before it have ended begins a cluster of its own, so the fold runs cluster by cluster.
    """
    apart = "(acc.last IS NULL OR h.start >= acc.last.`end`)"
    fold = f"""aggregate(g, named_struct('kept', cast(array() AS array<{RANKED}>), 'last', cast(null AS {RANKED})),
      (acc, h) -> named_struct(
        'kept', CASE WHEN {apart} AND acc.last IS NOT NULL THEN concat(acc.kept, array(acc.last)) ELSE acc.kept END,
        'last', CASE WHEN {apart} OR h.confidence > acc.last.confidence THEN h ELSE acc.last END),
      acc -> CASE WHEN acc.last IS NULL THEN acc.kept ELSE concat(acc.kept, array(acc.last)) END)"""
    ends = running("transform(a, h -> h.`end`)", "int", "0", "greatest(x, y)")
    heads = f"filter(zip_with(transform(a, (h, i) -> named_struct('at', i + 1, 'start', h.start)), {ends}, (h, e) -> named_struct('at', h.at, 'new', h.start >= e)), x -> x.new)"
    groups = "transform(c.heads, (x, i) -> slice(c.a, x.at, coalesce(get(c.heads, i + 1).at, size(c.a) + 1) - x.at))"
    return f"""transform(transform(array({hits}), a -> named_struct('a', a, 'heads', {heads})),
      c -> flatten(transform({groups}, g -> CASE WHEN size(g) = 1 THEN g ELSE {fold} END)))[0]"""


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class HitSet:
    """What one array of hits holds: hits of some rules above a threshold, without overlaps unless asked for."""

    rules: Sequence[Rule] = tuple(RULES)
    min_confidence: float = MIN_CONFIDENCE
    overlaps: bool = False


def _every(text: str, rules: Sequence[Rule], min_confidence: float) -> str:
    return f"array_sort(filter({_ranked_hits(text, _spans(rules))}, h -> h.confidence >= {float(min_confidence)}D))"


def _hits_of(every: str, wanted: HitSet, guarded: bool) -> Column:
    # SQL text rather than column calls: one parse instead of thousands of gateway calls.
    final = f"""transform({every if wanted.overlaps else _without_overlaps(every)}, h -> named_struct(
      'type', h.type, 'value', h.value, 'start', h.start, 'end', h.`end`, 'context', h.context, 'confidence', h.confidence))"""
    # The partition id makes the column non-deterministic for the optimizer, so a filter on it or an
    # explode of it is not copied below the detection, where it would run a second time. It also keeps filters of
    # other columns above, so frames that only mask go without.
    some = "exists(__parts, p -> size(p) > 1)" + " AND spark_partition_id() >= 0" * guarded
    return F.expr(f"CASE WHEN {some} THEN {final} ELSE cast(array() AS array<{HIT}>) END")


def _union(sets: Sequence[HitSet]) -> list[Rule]:
    """All rules of the sets, in an order that agrees with that of every set."""
    union = list(max((w.rules for w in sets), key=len))
    for wanted in sets:
        places = [union.index(r) if r in union else -1 for r in wanted.rules]
        if -1 in places or places != sorted(places):
            raise ValueError("rule sets that are found together must be parts of the largest, in its order")
    return union


def with_hit_sets(df: DataFrame, column: str, sets: Mapping[str, HitSet], guarded: bool = True) -> DataFrame:
    """Adds several arrays of hits of one text column from one detection: every pattern passes over a text once.

    Each set's rules must be among those of the largest set and in its order (the order decides between equals).
    """
    rules = _union(list(sets.values()))
    name = quoted(column)
    text, shape, other = F.col(name), F.col("__shape"), F.col("__other")
    kept = [F.col(quoted(c)) for c in df.columns]
    if SHAPE_GATES & {r.gate for r in rules}:
        digit = text.rlike(HAS_DIGIT)
        df = df.withColumn("__shape", F.when(digit, F.translate(text, *DIGIT_SHAPE)))
        df = df.withColumn("__other", F.when(shape.isNotNull(), text.rlike(OTHER_DIGIT)).otherwise(F.lit(False)))
    marked, parts = [], []
    for j, rule in enumerate(rules):
        mark = F.regexp_replace(text, java_pattern(rule), f"{MARKER}$0{MARKER}")
        marked.append(mark if rule.gate == "any" else F.when(GATES[rule.gate](text, shape, other), mark))
        parts.append(_parts(text, F.get("__marked", F.lit(j)), rule))
    staged = df.withColumn("__marked", F.array(*marked)).withColumn("__parts", F.array(*parts))
    # The marked copies of the text end here: only the parts go on.
    staged = staged.select(*kept, "__parts", F.expr(f"CASE WHEN exists(__parts, p -> size(p) > 1) THEN {pieces_of(name)} ELSE cast(array() AS array<string>) END").alias("__pieces"))
    lowest = min(w.min_confidence for w in sets.values())
    every = _every(name, rules, lowest)
    if len(sets) == 1:
        return staged.select(*kept, *(_hits_of(every, w, guarded).alias(out) for out, w in sets.items()))
    staged = staged.withColumn("__every", F.expr(f"CASE WHEN exists(__parts, p -> size(p) > 1) THEN {every} ELSE cast(array() AS array<{RANKED}>) END"))

    def part(wanted: HitSet) -> str:
        tests = [f"h.rank IN ({', '.join(str(rules.index(r)) for r in wanted.rules)})"] * (len(wanted.rules) < len(rules))
        tests += [f"h.confidence >= {float(wanted.min_confidence)}D"] * (wanted.min_confidence > lowest)
        return f"filter(__every, h -> {' AND '.join(tests)})" if tests else "__every"

    return staged.select(*kept, *(_hits_of(part(w), w, guarded).alias(out) for out, w in sets.items()))


def with_hits(
    df: DataFrame,
    columns: str | Sequence[str] | dict[str, str],
    rules: Sequence[Rule] = RULES,
    min_confidence: float = MIN_CONFIDENCE,
    overlaps: bool = False,
    guarded: bool = True,
) -> DataFrame:
    """Adds an array of hits per text column (``hits``, or ``{column: output}``); no hit or null text gives an empty array.

    ``overlaps=True`` keeps every hit above the threshold instead of resolving overlaps. Filter rows and
    choose columns before detection: filters after it stay above it, unless ``guarded=False``, which lets them
    through and suits frames that do not filter or explode the hits.
    """
    if isinstance(columns, str):
        columns = {columns: "hits"}
    elif not isinstance(columns, dict):
        columns = {c: f"{c}_hits" for c in columns}
    for column, out in columns.items():
        df = with_hit_sets(df, column, {out: HitSet(rules, min_confidence, overlaps)}, guarded)
    return df


def explode_hits(df: DataFrame, hits: str, keys: Sequence[str]) -> DataFrame:
    """One row per hit: keys, position in the hit list, hit fields."""
    return df.select(*keys, F.posexplode(hits).alias("hit_ix", "__hit")).select(*keys, "hit_ix", "__hit.*")


def detect(df: DataFrame, column: str, keys: Sequence[str] = (), rules: Sequence[Rule] = RULES, **options) -> DataFrame:
    """One row per hit: keys, position in the text's hit list and the hit fields."""
    marked = with_hits(df.select(*[quoted(c) for c in dict.fromkeys([*keys, column])]), {column: "__hits"}, rules, **options)
    return explode_hits(marked, "__hits", keys)


def text_columns(df: DataFrame, excluded: Sequence[str] = ()) -> list[str]:
    """String columns whose name contains none of the excluded tokens."""
    tokens = [t.lower() for t in excluded]
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and not any(t in f.name.lower() for t in tokens)
    ]


def detect_table(
    df: DataFrame, keys: Sequence[str] = (), excluded: Sequence[str] = (), rules: Sequence[Rule] = RULES
) -> DataFrame:
    """Hits of every string column in long form: keys, column name, hit fields. One scan, one stage."""
    columns = text_columns(df, excluded)
    if not columns:
        raise ValueError("no text column to scan")
    marked = with_hits(df.select(*[quoted(c) for c in dict.fromkeys([*keys, *columns])]), {c: f"__hits_{c}" for c in columns}, rules)
    per_column = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(quoted(f"__hits_{c}")).alias("hits")) for c in columns]
    )
    listed = marked.select(*keys, F.explode(per_column).alias("__c"))
    listed = listed.select(*keys, F.col("__c.column").alias("column"), F.col("__c.hits").alias("__hits"))
    return explode_hits(listed, "__hits", [*keys, "column"])
