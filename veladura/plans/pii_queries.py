"""Registered queries of detection, masking and their reports, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veladura.functions import pools
from veladura.functions.families import ALPHANUMERIC, DIGITS, RFC_LETTERS, UPPER
from veladura.functions.rules import LEVELS, OPTIONAL_RULES, RULES, Rule, select_rules
from veladura.operators import report
from veladura.operators.detect import HitSet, detect, detect_table, text_columns, with_hit_sets, with_hits
from veladura.operators.mask import MaskConfig, censor_levels, mask_table, mask_text
from veladura.plans.inputs import CORPUS_SQL, NOTE, NOTES_PER_TASK, corpus, table
from veladura.plans.oracle import kept, scored, text

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

HIT_OUT = "kind, id, type, value, start AS hit_start, stop AS hit_end"


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir)


def hits_out(df: DataFrame, *more: str) -> DataFrame:
    return df.select("kind", "id", "type", "value", F.col("start").alias("hit_start"), F.col("end").alias("hit_end"), *more)


# --- one query per rule: every hit of the rule with its place and confidence ---------------

RULE_IDS = {
    "rfc": "pii_rfc", "curp": "pii_curp", "email": "pii_email", "telefono": "pii_phone", "telefono_movil": "pii_mobile",
    "ip_address": "pii_ipv4", "mac_address": "pii_mac", "uuid": "pii_uuid", "credit_card": "pii_card", "nss": "pii_nss",
    "placa_auto": "pii_plate", "codigo_postal": "pii_postcode", "fecha_nacimiento": "pii_birthdate",
    "numero_exterior": "pii_house_no", "edad": "pii_age", "coordenada": "pii_coord",
}


def _rule_query(rule: Rule):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return hits_out(detect(texts(spark, sf_dir), "text", ["kind", "id"], [rule], overlaps=True), "confidence")

    return run


for _rule in RULES + OPTIONAL_RULES:
    QUERIES[RULE_IDS[_rule.type]] = _rule_query(_rule)
    ORACLE[RULE_IDS[_rule.type]] = f"WITH {scored(rules=[_rule])} SELECT {HIT_OUT}, confidence FROM scored"

CUSTOM = {r"Pedido \d-[A-Z]+": "pedido", r"folio [0-9a-f]{4}": "folio"}
CUSTOM_RULES = select_rules(["email", "pedido", "folio"], CUSTOM)


@register("pii_custom", f"WITH {kept(rules=CUSTOM_RULES)} SELECT {HIT_OUT}, confidence FROM hits")
def pii_custom(spark, sf_dir):
    return hits_out(detect(texts(spark, sf_dir), "text", ["kind", "id"], CUSTOM_RULES), "confidence")


EXTENSION_RULES = select_rules(["prioridad"], {r"\b[1-5]-(?:LOW|HIGH|MEDIUM|URGENT)\b": "prioridad"})


@register("ext_pattern", f"WITH {kept(rules=EXTENSION_RULES)} SELECT type, value, count(*) AS n FROM hits GROUP BY ALL")
def ext_pattern(spark, sf_dir):
    found = detect(texts(spark, sf_dir), "text", ["kind", "id"], EXTENSION_RULES)
    return found.groupBy("type", "value").agg(F.count("*").alias("n"))


KEYWORD_RULES = select_rules(["rfc", "curp", "email", "telefono"])


@register("pii_context", f"WITH {scored(rules=KEYWORD_RULES)} SELECT kind, id, type, start AS hit_start, context FROM scored")
def pii_context(spark, sf_dir):
    found = detect(texts(spark, sf_dir), "text", ["kind", "id"], KEYWORD_RULES, overlaps=True)
    return found.select("kind", "id", "type", F.col("start").alias("hit_start"), "context")


@register("pii_confidence", f"WITH {scored(rules=KEYWORD_RULES)} SELECT type, confidence, count(*) AS n FROM scored GROUP BY ALL")
def pii_confidence(spark, sf_dir):
    found = detect(texts(spark, sf_dir), "text", ["kind", "id"], KEYWORD_RULES, overlaps=True)
    return found.groupBy("type", "confidence").agg(F.count("*").alias("n"))


@register("pii_detect", f"WITH {kept()} SELECT {HIT_OUT}, hit_ix, context, confidence FROM hits")
def pii_detect(spark, sf_dir):
    return hits_out(detect(texts(spark, sf_dir), "text", ["kind", "id"]), "hit_ix", "context", "confidence")


@register(
    "pii_overlap",
    f"""WITH {kept()} SELECT s.kind, s.id, s.n AS candidates, h.n AS kept
    FROM (SELECT kind, id, count(*) AS n FROM scored GROUP BY ALL) s JOIN (SELECT kind, id, count(*) AS n FROM hits GROUP BY ALL) h
    USING (kind, id) WHERE s.n > h.n""",
)
def pii_overlap(spark, sf_dir):
    marked = with_hit_sets(texts(spark, sf_dir), "text", {"candidates": HitSet(overlaps=True), "kept": HitSet()})
    counts = marked.select(
        "kind", "id", F.size("candidates").cast("bigint").alias("candidates"), F.size("kept").cast("bigint").alias("kept")
    )
    return counts.where("candidates > kept")


# --- filters ------------------------------------------------------------------------------


@register("filter_min_confidence", f"WITH {kept(min_confidence=0.9)} SELECT {HIT_OUT}, confidence FROM hits")
def filter_min_confidence(spark, sf_dir):
    return hits_out(detect(texts(spark, sf_dir), "text", ["kind", "id"], min_confidence=0.9), "confidence")


MEDIUM = select_rules(LEVELS["medio"])


@register("filter_pii_types", f"WITH {kept(rules=MEDIUM)} SELECT {HIT_OUT} FROM hits")
def filter_pii_types(spark, sf_dir):
    return hits_out(detect(texts(spark, sf_dir), "text", ["kind", "id"], MEDIUM))


# Orders as a table with several text columns, built from the notes.
CARD_SQL = f"o_orderkey, {NOTE} AS note, concat('o', cast(o_custkey as string), '@mail.example.com') AS email, o_orderstatus AS estado, o_totalprice AS total"
TABLE_SQL = f"SELECT {CARD_SQL} FROM orders"


def cards(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders", NOTES_PER_TASK).selectExpr(
        "o_orderkey", f"{NOTE} AS note", "concat('o', cast(o_custkey as string), '@mail.example.com') AS email",
        "o_orderstatus AS estado", "o_totalprice AS total",
    )


def _columns_source(*columns: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS kind, o_orderkey AS id, {c} AS text FROM ({TABLE_SQL})" for c in columns)


@register(
    "pii_detect_table",
    f'WITH {kept(_columns_source("note", "email", "estado"))} SELECT kind AS "column", id, hit_ix, type, value, start AS hit_start FROM hits',
)
def pii_detect_table(spark, sf_dir):
    found = detect_table(cards(spark, sf_dir), ["o_orderkey"])
    return found.select(
        "column", F.col("o_orderkey").alias("id"), "hit_ix", "type", "value", F.col("start").alias("hit_start")
    )


@register(
    "filter_columns_excluded",
    f'WITH {kept(_columns_source("note", "estado"))} SELECT kind AS "column", id, type, value FROM hits',
)
def filter_columns_excluded(spark, sf_dir):
    found = detect_table(cards(spark, sf_dir), ["o_orderkey"], excluded=["MAIL"])
    return found.select("column", F.col("o_orderkey").alias("id"), "type", "value")


@register(
    "filter_string_cells",
    f"""SELECT 'note' AS "column", count(note) AS cells FROM ({TABLE_SQL}) UNION ALL SELECT 'email', count(email) FROM ({TABLE_SQL})
    UNION ALL SELECT 'estado', count(estado) FROM ({TABLE_SQL})""",
)
def filter_string_cells(spark, sf_dir):
    df = cards(spark, sf_dir)
    names = text_columns(df)
    return df.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "column", "cells")


# --- masking ------------------------------------------------------------------------------

VISIBLE = "greatest(1, floor(length(value) * {p} / 100.0)::INT)"


def partial_sql(percent: int = 30, char: str = "*") -> str:
    visible = VISIBLE.format(p=percent)
    local, front = "split_part(value, '@', 1)", f"({visible} // 2)"
    back = f"({visible} - {front})"
    return f"""CASE WHEN type = 'email' AND contains(value, '@') THEN
      CASE WHEN length({local}) > 2 THEN substr({local}, 1, 1) || repeat('{char}', length({local}) - 2) || right({local}, 1)
           ELSE repeat('{char}', length({local})) END || '@' || split_part(value, '@', -1)
      WHEN {visible} >= length(value) THEN value
      ELSE substr(value, 1, {front}) || repeat('{char}', length(value) - {visible}) || right(value, {back}) END"""


FULL_SQL = "'[' || upper(type) || ']'"
HASH_SQL = "'HASH_' || substr(sha256(value), 1, 8)"
SALT = "veladura"
DIGEST = f"sha256('{SALT}|' || type || '|' || value)"


def byte(i) -> str:
    return f"('0x' || substr({DIGEST}, {2 * i + 1}, 2))::INT"


def chars(alphabet: str, first: int, n: int) -> str:
    return " || ".join(f"substr({text(alphabet)}, {byte(first + i)} % {len(alphabet)} + 1, 1)" for i in range(n))


def item(pool, i: int) -> str:
    return f"list_extract([{', '.join(text(p) for p in pool)}], {byte(i)} % {len(pool)} + 1)"


RFC_SQL = " || ".join([chars(RFC_LETTERS, 0, 4), chars(DIGITS, 4, 6), chars(ALPHANUMERIC, 10, 3)])
CURP_SQL = " || ".join([chars(UPPER, 0, 4), chars(DIGITS, 4, 6), chars(UPPER, 10, 6), chars(DIGITS, 16, 2)])
FAKE_SQL = f"""CASE type WHEN 'rfc' THEN {RFC_SQL} WHEN 'curp' THEN {CURP_SQL}
  WHEN 'email' THEN {item(pools.MAIL_FIRST, 0)} || '.' || {item(pools.MAIL_LAST, 1)} || substr({DIGEST}, 33, 16) || '@' || {item(pools.MAIL_DOMAINS, 5)}
  WHEN 'telefono' THEN '55' || {chars(DIGITS, 0, 8)}
  WHEN 'ip_address' THEN concat_ws('.', {byte(0)}, {byte(1)}, {byte(2)}, {byte(3)})
  WHEN 'uuid' THEN substr({DIGEST}, 1, 8) || '-' || substr({DIGEST}, 9, 4) || '-4' || substr({DIGEST}, 14, 3) || '-' ||
    substr('89ab', {byte(20)} % 4 + 1, 1) || substr({DIGEST}, 18, 3) || '-' || substr({DIGEST}, 21, 12)
  ELSE '[FAKE_' || type || ']' END"""


def _redraw(size: int, layout) -> str:
    return " || ".join(chars(layout(i), i, 1) for i in range(size))


PRESERVE_SQL = f"""CASE WHEN type = 'rfc' AND length(value) = 13 THEN {_redraw(13, lambda i: RFC_LETTERS if i < 4 else DIGITS if i < 10 else ALPHANUMERIC)}
  WHEN type = 'rfc' THEN {_redraw(12, lambda i: RFC_LETTERS if i < 3 else DIGITS if i < 9 else ALPHANUMERIC)}
  WHEN type = 'curp' THEN {_redraw(18, lambda i: UPPER if i < 4 or 10 <= i < 16 else DIGITS)}
  ELSE {partial_sql()} END"""


def masked_sql(mask: str, source: str = CORPUS_SQL, rules=RULES, where: str = "true") -> str:
    """Texts with every hit replaced: gaps and masks in order, then the tail."""
    return f"""WITH {kept(source, rules)},
    masks AS (SELECT *, {mask} AS mask FROM hits WHERE {where}),
    pieces AS (SELECT kind, id, text, hit_ix, stop, substr(text, prev + 1, start - prev) || mask AS piece
      FROM (SELECT *, coalesce(lag(stop) OVER (PARTITION BY kind, id ORDER BY hit_ix), 0) AS prev FROM masks)),
    spliced AS (SELECT kind, id, string_agg(piece, '' ORDER BY hit_ix) || substr(any_value(text), max(stop) + 1) AS masked FROM pieces GROUP BY kind, id)
    SELECT t.kind, t.id, coalesce(s.masked, t.text) AS masked FROM texts t LEFT JOIN spliced s USING (kind, id)"""


def masked_out(df: DataFrame) -> DataFrame:
    return df.select("kind", "id", F.col("text").alias("masked"))


def _mask_query(config: MaskConfig):
    return lambda spark, sf_dir: masked_out(mask_text(texts(spark, sf_dir), "text", config))


for _mode, _sql in (("full", FULL_SQL), ("partial", partial_sql()), ("hash", HASH_SQL), ("fake", FAKE_SQL), ("preserve", PRESERVE_SQL)):
    QUERIES[f"mask_{_mode}"] = _mask_query(MaskConfig(mode=_mode, salt=SALT))
    ORACLE[f"mask_{_mode}"] = masked_sql(_sql)

for _kind, _sql in (("rfc", RFC_SQL), ("curp", CURP_SQL)):
    _rules = select_rules([_kind])
    QUERIES[f"mask_fake_{_kind}"] = _mask_query(MaskConfig(mode="fake", rules=tuple(_rules), salt=SALT))
    ORACLE[f"mask_fake_{_kind}"] = masked_sql(_sql, rules=_rules)

BY_TYPE = MaskConfig(mode="partial", modes={"rfc": "preserve", "email": "fake", "telefono": "full", "uuid": "hash"}, salt=SALT)
QUERIES["mask_mode_by_type"] = _mask_query(BY_TYPE)
ORACLE["mask_mode_by_type"] = masked_sql(
    f"CASE type WHEN 'rfc' THEN {PRESERVE_SQL} WHEN 'email' THEN {FAKE_SQL} WHEN 'telefono' THEN {FULL_SQL} WHEN 'uuid' THEN {HASH_SQL} ELSE {partial_sql()} END"
)
QUERIES["mask_text"] = _mask_query(MaskConfig(mask_char="#", visible_percent=40))
ORACLE["mask_text"] = masked_sql(partial_sql(40, "#"))
QUERIES["filter_context_excluded"] = _mask_query(MaskConfig(mode="full", excluded=["Folio", "edad"]))
ORACLE["filter_context_excluded"] = masked_sql(
    FULL_SQL, where="NOT contains(lower(context), 'folio') AND NOT contains(lower(context), 'edad')"
)


@register(
    "mask_table",
    f"""SELECT id AS o_orderkey, max(masked) FILTER (kind = 'note') AS note, any_value(email) AS email, max(masked) FILTER (kind = 'estado') AS estado,
    any_value(total) AS total FROM ({masked_sql(partial_sql(40), _columns_source("note", "estado"), where="NOT contains(lower(context), 'email')")})
    JOIN ({TABLE_SQL}) ON o_orderkey = id GROUP BY id""",
)
def query_mask_table(spark, sf_dir):
    return mask_table(cards(spark, sf_dir), MaskConfig(visible_percent=40, excluded=["email"]))


@register(
    "mask_censor_level",
    " UNION ALL ".join(
        f"SELECT '{level}' AS level, * FROM ({masked_sql(partial_sql(), rules=select_rules(types))})" for level, types in LEVELS.items()
    ),
)
def mask_censor_level(spark, sf_dir):
    return censor_levels(texts(spark, sf_dir), "text", ["kind", "id"]).withColumnRenamed("text", "masked")


# --- reports ------------------------------------------------------------------------------


def marked(spark, sf_dir) -> DataFrame:
    return with_hits(texts(spark, sf_dir), "text").select("kind", "id", "hits")


@register(
    "agg_pii_total",
    f"""WITH {kept()} SELECT (SELECT count(*) FROM hits) AS total_hits, (SELECT count(*) FROM (SELECT DISTINCT kind, id FROM hits)) AS texts_with_hits,
    (SELECT count(*) FROM texts) AS texts""",
)
def agg_pii_total(spark, sf_dir):
    return report.pii_totals(marked(spark, sf_dir))


@register("agg_pii_by_type", f"WITH {kept()} SELECT type, count(*) AS n FROM hits GROUP BY type")
def agg_pii_by_type(spark, sf_dir):
    return report.pii_by_type(marked(spark, sf_dir))


@register(
    "agg_pii_by_column",
    f'WITH {kept(_columns_source("note", "email", "estado"))} SELECT kind AS "column", type, count(*) AS n FROM hits GROUP BY ALL',
)
def agg_pii_by_column(spark, sf_dir):
    return detect_table(cards(spark, sf_dir)).groupBy("column", "type").agg(F.count("*").alias("n"))


@register(
    "agg_pii_values",
    f"""WITH {kept()}, firsts AS (SELECT kind, id, type, value, min(hit_ix) AS ix FROM hits GROUP BY ALL)
    SELECT kind, id, type, string_agg(value, ' | ' ORDER BY ix) AS found FROM firsts GROUP BY kind, id, type""",
)
def agg_pii_values(spark, sf_dir):
    found = marked(spark, sf_dir).select("kind", "id", F.explode(report.pii_values(F.col("hits"))).alias("v"))
    return found.select(
        "kind", "id", F.col("v.type").alias("type"), F.array_join("v.values", " | ").alias("found")
    )


@register(
    "agg_pii_distinct_values",
    f"""WITH {kept(source="SELECT 'note' AS kind, o_orderkey AS id, " + NOTE + " AS text FROM orders")}
    SELECT type, value, min(id) AS first_id, arg_min(start, id * 1000000 + start) AS first_start, count(*) AS n FROM hits GROUP BY type, value""",
)
def agg_pii_distinct_values(spark, sf_dir):
    source = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{NOTE} AS text")
    return report.distinct_values(with_hits(source, "text"), "hits", "id")


@register("sort_types_desc", f"WITH {kept()} SELECT type, count(*) AS n FROM hits GROUP BY type ORDER BY n DESC, type")
def sort_types_desc(spark, sf_dir):
    return report.by_count(report.pii_by_type(marked(spark, sf_dir)))


@register(
    "sort_hits",
    f"""WITH {scored()} SELECT kind, id, string_agg(type || '@' || start, ' ' ORDER BY start, -confidence, rank) AS ordered FROM scored GROUP BY kind, id""",
)
def sort_hits(spark, sf_dir):
    every = with_hits(texts(spark, sf_dir), "text", overlaps=True).where(F.size("hits") > 0)
    shown = F.transform("hits", lambda h: F.concat(h["type"], F.lit("@"), h["start"].cast("string")))
    return every.select("kind", "id", F.array_join(shown, " ").alias("ordered"))


@register(
    "pii_report",
    f"""WITH {kept()} SELECT 'total' AS line, (SELECT count(*) FROM hits) AS n UNION ALL
    SELECT 'texts', (SELECT count(*) FROM (SELECT DISTINCT kind, id FROM hits)) UNION ALL SELECT type, count(*) FROM hits GROUP BY type""",
)
def pii_report(spark, sf_dir):
    # One pass: per text its types, plus one line for the text itself and one per hit.
    kinds = F.transform("hits", lambda h: h["type"])
    lines = F.when(F.size("hits") > 0, F.concat(F.array(F.lit("texts")), kinds, F.array_repeat(F.lit("total"), F.size("hits"))))
    rows = marked(spark, sf_dir).select(F.explode(lines).alias("line"))
    return rows.groupBy("line").agg(F.count("*").alias("n"))
