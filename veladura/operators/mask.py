"""Masking: replace hits in a text, by mode, as expressions over the hit array."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veladura.functions import pools
from veladura.functions.draws import digest_byte, value_digest
from veladura.functions.families import ALPHANUMERIC, DIGITS, RFC_LETTERS, UPPER, pool_array
from veladura.functions.rules import LEVELS, RULES, Rule, select_rules
from veladura.operators.detect import HitSet, pieces_of, quoted, stretch, text_columns, with_hit_sets, with_hits

MODES = ("partial", "full", "hash", "fake", "preserve")


@dataclass(frozen=True)
class MaskConfig:
    """How hits are replaced. ``modes`` overrides the default mode per type; fake and preserve need a secret ``salt``."""

    mode: str = "partial"
    modes: Mapping[str, str] = field(default_factory=dict)
    mask_char: str = "*"
    visible_percent: int = 30
    excluded: Sequence[str] = ()
    rules: Sequence[Rule] = tuple(RULES)
    salt: str = ""

    def __post_init__(self):
        for mode in [self.mode, *self.modes.values()]:
            if mode not in MODES:
                raise ValueError(f"unknown mask mode {mode!r}; known: {', '.join(MODES)}")
        if needs_digest(self) and not self.salt:
            raise ValueError("the modes fake and preserve need a secret salt")


def full_mask(kind: Column) -> Column:
    return F.concat(F.lit("["), F.upper(kind), F.lit("]"))


def partial_mask(value: Column, kind: Column, mask_char: str = "*", visible_percent: int = 30) -> Column:
    """Shows a share of the characters at both ends; an e-mail keeps its domain and outer letters."""
    n = F.length(value)
    visible = F.greatest(F.floor(n * F.lit(visible_percent) / F.lit(100.0)).cast("int"), F.lit(1))
    front = F.floor(visible / F.lit(2.0)).cast("int")
    back = visible - front
    ends = F.concat(
        F.substring(value, F.lit(1), front), F.repeat(F.lit(mask_char), n - front - back), value.substr(n - back + 1, back)
    )
    local = F.substring_index(value, "@", 1)
    size = F.length(local)
    hidden = F.when(
        size > 2, F.concat(F.substring(local, 1, 1), F.repeat(F.lit(mask_char), size - 2), F.right(local, F.lit(1)))
    ).otherwise(F.repeat(F.lit(mask_char), size))
    mail = F.concat(hidden, F.lit("@"), F.substring_index(value, "@", -1))
    return (
        F.when((kind == "email") & F.contains(value, F.lit("@")), mail)
        .when(visible >= n, value)
        .otherwise(ends)
    )


def hash_mask(value: Column) -> Column:
    return F.concat(F.lit("HASH_"), F.substring(F.sha2(value, 256), 1, 8))


def _char(alphabet: str, byte: Column) -> Column:
    return F.lit(alphabet).substr(byte % F.lit(len(alphabet)) + 1, F.lit(1))


def _chars(alphabet: str, digest: Column, first: int, n: int) -> Column:
    return F.concat(*[_char(alphabet, digest_byte(digest, first + i)) for i in range(n)])


def fake_value(kind: Column, digest: Column) -> Column:
    """Invented value of the same type, fixed by the digest of the original: equal values get equal pseudonyms.

    Mail addresses hold 64 bits of the digest. Phones (10^8) and IPv4 addresses (2^32) are too few to keep all values apart.
    """
    def item(pool: Sequence[str], i: int) -> Column:
        return F.element_at(pool_array(pool), digest_byte(digest, i) % F.lit(len(pool)) + 1)

    rfc = F.concat(
        _chars(RFC_LETTERS, digest, 0, 4), _chars(DIGITS, digest, 4, 6), _chars(ALPHANUMERIC, digest, 10, 3)
    )
    curp = F.concat(
        _chars(UPPER, digest, 0, 4), _chars(DIGITS, digest, 4, 6), _chars(UPPER, digest, 10, 6),
        _chars(DIGITS, digest, 16, 2),
    )
    mail = F.concat(
        item(pools.MAIL_FIRST, 0), F.lit("."), item(pools.MAIL_LAST, 1), F.substring(digest, 33, 16), F.lit("@"),
        item(pools.MAIL_DOMAINS, 5),
    )
    phone = F.concat(F.lit("55"), _chars(DIGITS, digest, 0, 8))
    ipv4 = F.concat_ws(".", *[digest_byte(digest, i).cast("string") for i in range(4)])
    uuid = F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-4"), F.substring(digest, 14, 3),
        F.lit("-"), _char("89ab", digest_byte(digest, 20)), F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )
    return (
        F.when(kind == "rfc", rfc)
        .when(kind == "curp", curp)
        .when(kind == "email", mail)
        .when(kind == "telefono", phone)
        .when(kind == "ip_address", ipv4)
        .when(kind == "uuid", uuid)
        .otherwise(F.concat(F.lit("[FAKE_"), kind, F.lit("]")))
    )


def preserve_mask(value: Column, kind: Column, digest: Column, mask_char: str, visible_percent: int) -> Column:
    """New characters in the layout of the old ones: RFC is letters, six digits, three alphanumerics
    (letters are all but the last nine, so 12-character codes keep their shape); CURP is 4-6-6-2."""
    n = F.length(value)

    def redraw(layout) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: layout(i, digest_byte(digest, i))), "")

    rfc = redraw(
        lambda i, b: F.when(i < n - 9, _char(RFC_LETTERS, b)).when(i < n - 3, _char(DIGITS, b)).otherwise(_char(ALPHANUMERIC, b))
    )
    curp = redraw(
        lambda i, b: F.when((i < 4) | ((i >= 10) & (i < 16)), _char(UPPER, b)).otherwise(_char(DIGITS, b))
    )
    return (
        F.when(kind == "rfc", rfc)
        .when(kind == "curp", curp)
        .otherwise(partial_mask(value, kind, mask_char, visible_percent))
    )


def mask_value(value: Column, kind: Column, mode: str, config: MaskConfig, digest: Column) -> Column:
    if mode == "full":
        return full_mask(kind)
    if mode == "hash":
        return hash_mask(value)
    if mode == "fake":
        return fake_value(kind, digest)
    if mode == "preserve":
        return preserve_mask(value, kind, digest, config.mask_char, config.visible_percent)
    return partial_mask(value, kind, config.mask_char, config.visible_percent)


def mask_by_type(value: Column, kind: Column, config: MaskConfig, digest: Column) -> Column:
    """Mode per type as one CASE; types that share a mode share a branch."""
    default = mask_value(value, kind, config.mode, config, digest)
    branches = None
    for mode in MODES:
        types = sorted(t for t, m in config.modes.items() if m == mode and m != config.mode)
        if types:
            masked = mask_value(value, kind, mode, config, digest)
            branches = (F if branches is None else branches).when(kind.isin(types), masked)
    return default if branches is None else branches.otherwise(default)


def not_excluded(hits: Column, excluded: Iterable[str]) -> Column:
    """Drops hits whose context mentions an excluded token."""
    tokens = [t.lower() for t in excluded]
    if not tokens:
        return hits

    def mentions(h: Column) -> Column:
        low = F.lower(h["context"])
        found = F.contains(low, F.lit(tokens[0]))
        for t in tokens[1:]:
            found = found | F.contains(low, F.lit(t))
        return found

    return F.filter(hits, lambda h: ~mentions(h))


def needs_digest(config: MaskConfig) -> bool:
    return bool({"fake", "preserve"} & {config.mode, *config.modes.values()})


def masked_hits(hits: Column, config: MaskConfig) -> Column:
    """Array of (start, end, mask) for the hits to replace."""
    digest = (lambda h: value_digest(F.concat(h["type"], F.lit("|"), h["value"]), config.salt)) if needs_digest(config) else (
        lambda h: F.lit("")
    )
    keyed = F.transform(
        not_excluded(hits, config.excluded),
        lambda h: F.struct(*[h[f].alias(f) for f in ("start", "end", "type", "value")], digest(h).alias("digest")),
    )
    return F.transform(
        keyed,
        lambda h: F.struct(
            h["start"].alias("start"), h["end"].alias("end"),
            mask_by_type(h["value"], h["type"], config, h["digest"]).alias("mask"),
        ),
    )


def splice(text: str, masks: str) -> Column:
    """Text column with every (start, end, mask) of a column applied: gap and mask per hit, then the tail."""
    before = "coalesce(get(c.m, i - 1).`end`, 0)"
    gaps = f"transform(c.m, (m, i) -> concat({stretch('c.t', 'c.p', before, f'm.start - {before}')}, m.mask))"
    last = "element_at(c.m, -1).`end`"
    tail = stretch("c.t", "c.p", last, f"length(c.t) - {last}")
    # An array of one element binds the text and its pieces, so both are made once a row.
    bound = f"array(named_struct('t', {text}, 'm', {masks}, 'p', {pieces_of(text)}))"
    return F.expr(f"CASE WHEN size({masks}) > 0 THEN transform({bound}, c -> concat(array_join({gaps}, ''), {tail}))[0] ELSE {text} END")


def mask_columns(df: DataFrame, hits: Mapping[str, str], config: MaskConfig = MaskConfig()) -> DataFrame:
    """Replaces text columns using hit columns computed before (``{column: hits column}``)."""
    masks = {f"__masks{i}": masked_hits(F.col(quoted(h)), config) for i, h in enumerate(hits.values())}
    prepared = df.withColumns(masks)
    place = {c: f"__masks{i}" for i, c in enumerate(hits)}
    return prepared.select(
        *[splice(quoted(c), quoted(place[c])).alias(c) if c in place else F.col(quoted(c)) for c in df.columns]
    )


def mask_text(df: DataFrame, column: str, config: MaskConfig = MaskConfig(), hits: str | None = None) -> DataFrame:
    """Masks one text column; adds the hit array as ``hits`` when a name is given."""
    marked = with_hits(df, {column: hits or "__hits"}, config.rules, guarded=bool(hits))
    masked = mask_columns(marked, {column: hits or "__hits"}, config)
    return masked if hits else masked.drop("__hits")


def mask_table(df: DataFrame, config: MaskConfig = MaskConfig()) -> DataFrame:
    """Masks every string column whose name is not excluded; one stage, no shuffle."""
    columns = text_columns(df, config.excluded)
    if not columns:
        return df
    hits = {c: f"__hits_{c}" for c in columns}
    return mask_columns(with_hits(df, hits, config.rules, guarded=False), hits, config).select(*[F.col(quoted(c)) for c in df.columns])


def censor(df: DataFrame, column: str, level: str = "alto") -> DataFrame:
    """Partial masking by level: bajo, medio or, for anything else, every rule."""
    return mask_text(df, column, MaskConfig(rules=tuple(select_rules(LEVELS.get(level)))))


def censor_levels(df: DataFrame, column: str, keys: Sequence[str], levels: Sequence[str] = tuple(LEVELS)) -> DataFrame:
    """(level, keys, column): the text partially masked at several levels, from one detection."""
    hits = {f"__hits_{i}": HitSet(tuple(select_rules(LEVELS.get(level)))) for i, level in enumerate(levels)}
    marked = with_hit_sets(df.select(*[quoted(c) for c in dict.fromkeys([*keys, column])]), column, hits)
    masks = marked.withColumns({f"__masks_{i}": masked_hits(F.col(f"__hits_{i}"), MaskConfig()) for i in range(len(levels))})
    each = [F.struct(F.lit(level).alias("level"), splice(quoted(column), f"__masks_{i}").alias(column)) for i, level in enumerate(levels)]
    listed = masks.select(*[quoted(k) for k in keys], F.explode(F.array(*each)).alias("__level"))
    return listed.select(F.col("__level.level").alias("level"), *[quoted(k) for k in keys], F.col(f"__level.{quoted(column)}").alias(column))
