"""Registered queries over documents: forms, API specs, and reports on them, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veladura.functions import pools
from veladura.functions.families import AS_OF_DAY
from veladura.functions.html import ANY_TAG, ATTRIBUTE, ENTITIES, NOISE, attribute_of, block_pattern, inner_text, tag_pattern
from veladura.operators import apispecs, forms
from veladura.operators.catalogue import BASE, resolve_frame
from veladura.operators.generate import stress_volume
from veladura.operators.jobs import keep_first
from veladura.plans.gen_oracle import generated
from veladura.plans.gen_queries import EXACT, FALLBACK, FUZZY, unpivoted
from veladura.plans.inputs import PAGES_SQL, SPECS_SQL, form_pages, specs, table
from veladura.plans.oracle import text
from veladura.session import scratch_path
from veladura.sources import files as source

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def all_pages(spark, sf_dir) -> DataFrame:
    return form_pages(spark, sf_dir)


# --- forms: oracle in rows and windows instead of arrays ---------------------------------------


def plain(x: str) -> str:
    x = f"replace({x}, '&#241;', 'ñ')"
    for entity, char in ENTITIES.items():
        x = f"replace({x}, {text(entity)}, {text(char)})"
    return x


def shown(x: str) -> str:
    runs = f"list_transform(regexp_split_to_array({x}, {text(ANY_TAG)}), lambda r: regexp_replace({plain('r')}, '^\\s+|\\s+$', '', 'g'))"
    return f"array_to_string({runs}, '')"


def attrs(tag: str) -> str:
    groups = {g: f"regexp_extract_all({tag}, {text(ATTRIBUTE)}, {g})" for g in (1, 2, 3, 4)}
    value = f"concat({', '.join(f'coalesce(({groups[g]})[i], {text(str())})' for g in (2, 3, 4))})"
    return f"list_transform(range(1, len({groups[1]}) + 1), lambda i: {{'n': lower(({groups[1]})[i]), 'v': {plain(value)}}})"


def attr(name: str) -> str:
    return f"list_filter(attrs, lambda a: a.n = '{name}')[-1].v"


FORMS_SQL = f"""clean AS (SELECT page_id, regexp_replace(html, {text(NOISE)}, '<!>', 'g') AS html FROM ({PAGES_SQL}) WHERE regexp_matches(html, {text(forms.HAS_FIELDS)})),
opened AS (SELECT page_id, html, regexp_extract_all(html, {text(tag_pattern("form"))}) AS opens, regexp_split_to_array(html, {text(tag_pattern("form"))}) AS pieces FROM clean),
forms AS (SELECT page_id, (i - 1)::INT AS form_ix, opens[i] AS tag, list_reduce(pieces[i + 1:], lambda acc, p:
    CASE WHEN acc.depth = 0 THEN acc
         WHEN len(regexp_split_to_array(p, '(?i)</form\\s*>')) - 1 >= acc.depth
         THEN {{'depth': 0, 'text': acc.text || array_to_string(regexp_split_to_array(p, '(?i)</form\\s*>')[1:acc.depth], '')}}
         ELSE {{'depth': (acc.depth + 2 - len(regexp_split_to_array(p, '(?i)</form\\s*>')))::INT, 'text': acc.text || p}} END,
    {{'depth': 1, 'text': ''}}).text AS content
  FROM (SELECT *, unnest(range(1, len(opens) + 1)) AS i FROM opened)
  UNION ALL SELECT page_id, 0, NULL, html FROM opened WHERE len(opens) = 0 AND regexp_matches(html, {text(forms.LOOSE_FIELDS)})),
headed AS (SELECT *, CASE WHEN tag IS NULL THEN [] ELSE {attrs("tag")} END AS attrs FROM forms),
heads AS (SELECT page_id, form_ix, coalesce({attr("action")}, '') AS action, upper(coalesce({attr("method")}, 'GET')) AS method,
  CASE WHEN tag IS NULL THEN 'loose_inputs' ELSE {attr("id")} END AS form_id, CASE WHEN tag IS NULL THEN 'loose_inputs' ELSE {attr("name")} END AS form_name FROM headed)"""


def _blocks(name: str, kind: int) -> str:
    found = f"regexp_extract_all(content, {text(block_pattern(name))})"
    head = text("^" + tag_pattern(name).replace("(?i)", "")), "'i'"
    return f"""SELECT page_id, form_ix, {kind} AS kind, ord, regexp_extract(b, {head[0]}, 0, 'i') AS tag, regexp_replace(b, {head[0]}, '', 'i') AS body
      FROM (SELECT page_id, form_ix, unnest({found}) AS b, generate_subscripts({found}, 1) AS ord FROM forms)"""


INPUTS = f"regexp_extract_all(content, {text(tag_pattern('input'))})"
OPTIONS_SQL = f"""list_filter(list_transform(regexp_split_to_array(body, '(?i)<option(?:[\\s/][^>]*)?>')[2:],
  lambda o: {shown("regexp_replace(o, '(?is)(</option|</select|<optgroup|</optgroup).*$', '')")}), lambda o: o <> '')"""
FIELDS_SQL = f"""{FORMS_SQL},
elements AS (SELECT page_id, form_ix, 0 AS kind, generate_subscripts({INPUTS}, 1) AS ord, unnest({INPUTS}) AS tag, '' AS body FROM forms
  UNION ALL {_blocks("select", 1)} UNION ALL {_blocks("textarea", 2)} UNION ALL {_blocks("button", 3)}),
parsed AS (SELECT *, {attrs("tag")} AS attrs FROM elements),
typed AS (SELECT *, {attr("type")} AS raw_type, coalesce(nullif({attr("name")}, ''), CASE WHEN kind < 3 THEN nullif({attr("id")}, '') END) AS raw_name FROM parsed),
candidates AS (SELECT page_id, form_ix, kind, ord, lower(trim(raw_name)) AS name,
  CASE kind WHEN 0 THEN lower(coalesce(raw_type, 'text')) WHEN 1 THEN 'select' WHEN 2 THEN 'textarea' ELSE 'button' END AS type, {attr("id")} AS id,
  CASE WHEN kind IN (0, 2) THEN {attr("placeholder")} END AS placeholder, ({attr("required")} IS NOT NULL AND kind <> 3) AS required,
  CASE WHEN kind = 1 THEN {OPTIONS_SQL} ELSE [] END AS options,
  CASE WHEN kind IN (2, 3) THEN {shown("body")} ELSE {attr("value")} END AS default_value,
  {attr("min")} AS lowest, {attr("max")} AS highest, CASE WHEN kind = 0 THEN nullif({attr("pattern")}, '') END AS pattern,
  NOT (kind = 0 AND coalesce(raw_type = 'hidden', false)) AS visible
  FROM typed WHERE raw_name IS NOT NULL AND NOT (kind = 0 AND lower(coalesce(raw_type, 'text')) IN ('submit', 'reset', 'button', 'image'))
  AND NOT (kind = 3 AND coalesce(raw_type = 'submit', false))),
radios AS (SELECT page_id, form_ix, name, list(default_value ORDER BY ord) FILTER (default_value <> '') AS radio_values FROM candidates WHERE type = 'radio' GROUP BY ALL),
every AS (SELECT c.page_id, c.form_ix, c.name, c.type, c.id, c.placeholder, c.required, array_to_string(CASE WHEN c.type = 'radio' THEN coalesce(r.radio_values, []) ELSE c.options END, '|') AS options,
  c.default_value, CASE WHEN kind = 0 AND type = 'range' THEN coalesce(try_cast(lowest AS INT), 0) WHEN kind = 0 AND type = 'number' THEN try_cast(lowest AS INT) END AS min_value,
  CASE WHEN kind = 0 AND type = 'range' THEN coalesce(try_cast(highest AS INT), 100) WHEN kind = 0 AND type = 'number' THEN try_cast(highest AS INT) END AS max_value, c.pattern, c.visible,
  row_number() OVER (PARTITION BY c.page_id, c.form_ix ORDER BY kind, ord) AS place, row_number() OVER (PARTITION BY c.page_id, c.form_ix, c.name ORDER BY kind, ord) AS repeated
  FROM candidates c LEFT JOIN radios r ON r.page_id = c.page_id AND r.form_ix = c.form_ix AND r.name = c.name),
fields AS (SELECT * EXCLUDE (place, repeated), (row_number() OVER (PARTITION BY page_id, form_ix ORDER BY place) - 1)::INT AS field_ix FROM every WHERE repeated = 1)"""
FIELD_OUT = (
    "page_id, form_ix, field_ix, name, type, id, placeholder, required, options, default_value, "
    "min_value::VARCHAR AS min_value, max_value::VARCHAR AS max_value, pattern, visible"
)


def field_rows(spark, sf_dir, unique: bool = True) -> DataFrame:
    return forms.form_fields(all_pages(spark, sf_dir), unique=unique)


def fields_out(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"options": F.array_join("options", "|")} | {c: F.col(c).cast("string") for c in ("min_value", "max_value")}
    )


@register("form_list", f"WITH {FORMS_SQL} SELECT page_id, form_ix, action, method, form_id, form_name FROM heads")
def form_list(spark, sf_dir):
    return forms.form_list(all_pages(spark, sf_dir)).drop("first_char", "n_chars")


@register("form_fields", f"WITH {FIELDS_SQL} SELECT {FIELD_OUT} FROM fields")
def form_fields(spark, sf_dir):
    return fields_out(field_rows(spark, sf_dir))


for _name, _types in (
    ("form_inputs", "type NOT IN ('select', 'textarea', 'button')"), ("form_selects", "type = 'select'"),
    ("form_textareas", "type = 'textarea'"), ("form_buttons", "type = 'button'"),
):
    QUERIES[_name] = lambda spark, sf_dir, types=_types: fields_out(field_rows(spark, sf_dir)).where(types).drop("field_ix")
    ORACLE[_name] = f"WITH {FIELDS_SQL} SELECT {FIELD_OUT.replace('field_ix, ', '')} FROM fields WHERE {_types}"

ALL_OUT = "page_id, form_ix, name, type, id, options"


@register("set_union_fields", f"WITH {FIELDS_SQL} SELECT page_id, form_ix, (place - 1)::INT AS field_ix, name, type FROM every")
def set_union_fields(spark, sf_dir):
    return field_rows(spark, sf_dir, unique=False).select("page_id", "form_ix", "field_ix", "name", "type")


@register("win_keep_first", f"WITH {FIELDS_SQL} SELECT page_id, form_ix, name, type, options FROM every WHERE repeated = 1")
def win_keep_first(spark, sf_dir):
    every = fields_out(field_rows(spark, sf_dir, unique=False))
    return keep_first(every, ["page_id", "form_ix", "name"], "field_ix").select("page_id", "form_ix", "name", "type", "options")


@register("filter_named", f"WITH {FIELDS_SQL} SELECT count(*) AS named, count(id) AS with_id FROM every")
def filter_named(spark, sf_dir):
    return field_rows(spark, sf_dir, unique=False).agg(F.count("name").alias("named"), F.count("id").alias("with_id"))


@register("filter_input_type", f"WITH {FIELDS_SQL} SELECT type, count(*) AS n FROM every WHERE type NOT IN ('select', 'textarea', 'button') GROUP BY type")
def filter_input_type(spark, sf_dir):
    inputs = field_rows(spark, sf_dir, unique=False).where("type NOT IN ('select', 'textarea', 'button')")
    return inputs.groupBy("type").agg(F.count("*").alias("n"))


@register("proj_fields", f"WITH {FIELDS_SQL} SELECT page_id, form_ix, field_ix, name FROM fields WHERE field_ix IN (0, 2)")
def proj_fields(spark, sf_dir):
    return forms.choose_fields(field_rows(spark, sf_dir), [0, 2]).select("page_id", "form_ix", "field_ix", "name")


@register("proj_nonbutton", f"WITH {FIELDS_SQL} SELECT page_id, form_ix, name FROM fields WHERE type <> 'button'")
def proj_nonbutton(spark, sf_dir):
    return field_rows(spark, sf_dir).where("type <> 'button'").select("page_id", "form_ix", "name")


CONFIG_SQL = f"""WITH {FIELDS_SQL} SELECT h.page_id, h.form_ix, action, method, form_id, form_name,
  coalesce(string_agg(name, ',' ORDER BY field_ix) FILTER (type <> 'button'), '') AS columns, count(name)::INT AS total_fields,
  (count(*) FILTER (required))::INT AS required_fields, coalesce(string_agg(name, ',' ORDER BY field_ix), '') AS field_names
  FROM heads h LEFT JOIN fields f ON f.page_id = h.page_id AND f.form_ix = h.form_ix GROUP BY ALL"""


@register("form_config", CONFIG_SQL)
def form_config(spark, sf_dir):
    config = forms.form_config(all_pages(spark, sf_dir))
    return config.withColumns({c: F.array_join(c, ",") for c in ("columns", "field_names")})


@register("agg_required", f"SELECT page_id, form_ix, required_fields, total_fields, field_names FROM ({CONFIG_SQL})")
def agg_required(spark, sf_dir):
    return form_config(spark, sf_dir).select("page_id", "form_ix", "required_fields", "total_fields", "field_names")


TYPES_SQL = f"WITH {FIELDS_SQL} SELECT type, count(*) AS n FROM fields GROUP BY type"


@register("agg_field_types", TYPES_SQL)
def agg_field_types(spark, sf_dir):
    return field_rows(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


@register("sort_types_name", f"{TYPES_SQL} ORDER BY type")
def sort_types_name(spark, sf_dir):
    return agg_field_types(spark, sf_dir).orderBy("type")


RULE_SQL = """CASE WHEN type IN ('text', 'search', 'url') AND contains(name, 'email') THEN 'email'
  WHEN type IN ('text', 'search', 'url') AND (contains(name, 'nombre') OR contains(name, 'name')) THEN 'name'
  WHEN type IN ('text', 'search', 'url') AND (contains(name, 'telefono') OR contains(name, 'phone')) THEN 'phone'
  WHEN type IN ('text', 'search', 'url') THEN 'word' WHEN type = 'email' THEN 'email' WHEN type = 'number' THEN 'number'
  WHEN type IN ('select', 'radio') THEN 'option' WHEN type = 'checkbox' THEN 'boolean' WHEN type = 'textarea' THEN 'paragraph'
  WHEN type = 'date' THEN 'date' ELSE 'word' END"""


@register("join_form_rules", f"WITH {FIELDS_SQL} SELECT page_id, form_ix, name, {RULE_SQL} AS rule FROM fields")
def join_form_rules(spark, sf_dir):
    return field_rows(spark, sf_dir).select("page_id", "form_ix", "name", forms.form_rule(F.col("name"), F.col("type")).alias("rule"))


RECORDS = 3


def _item(pool, i) -> str:
    return f"list_extract([{', '.join(text(p) for p in pool)}], b[{i + 1}] % {len(pool)} + 1)"


def _sentence(i: int) -> str:
    first = _item(pools.WORDS, i)
    rest = " || ' ' || ".join(_item(pools.WORDS, i + k) for k in range(1, 5))
    return f"upper(substr({first}, 1, 1)) || substr({first}, 2) || ' ' || {rest} || '.'"


RECORDS_SQL = f"""WITH {FIELDS_SQL},
drawn AS (SELECT *, sha256('42|' || page_id || '|' || form_ix || '|' || record_ix || '|' || name) AS digest, {RULE_SQL} AS rule
  FROM (SELECT *, unnest(range({RECORDS}))::INT AS record_ix FROM fields)),
bytes AS (SELECT *, list_transform(range(20), lambda i: ('0x' || substr(digest, (2 * i + 1)::INT, 2))::INT) AS b, ('0x' || substr(digest, 1, 13))::BIGINT AS big,
  coalesce(min_value, 0) AS low, greatest(coalesce(min_value, 0), coalesce(max_value, 100)) AS high, CASE WHEN options = '' THEN [] ELSE string_split(options, '|') END AS opts FROM drawn)
SELECT page_id, form_ix, record_ix, name, CASE
  WHEN rule = 'email' THEN {_item(pools.MAIL_FIRST, 0)} || '.' || {_item(pools.MAIL_LAST, 1)} || (b[3] + 100) || '@' || {_item(pools.MAIL_DOMAINS, 3)}
  WHEN rule = 'name' THEN {_item(pools.FIRST_NAMES, 0)} || ' ' || {_item(pools.LAST_NAMES, 1)}
  WHEN rule = 'phone' THEN '55' || {' || '.join(f'(b[{i + 1}] % 10)' for i in range(8))}
  WHEN rule = 'number' THEN (low + big % (high - low + 1))::VARCHAR
  WHEN rule = 'option' AND len(opts) > 0 THEN opts[(big % len(opts))::INT + 1]
  WHEN rule = 'boolean' THEN CASE WHEN b[1] % 2 = 1 THEN 'true' ELSE 'false' END
  WHEN rule = 'paragraph' THEN {_sentence(0)} || ' ' || {_sentence(5)} || ' ' || {_sentence(10)}
  WHEN rule = 'date' THEN (DATE '1970-01-01' + (big % {AS_OF_DAY})::INT)::VARCHAR
  ELSE {_item(pools.WORDS, 0)} END AS value FROM bytes"""


def _records(spark, sf_dir) -> DataFrame:
    rows = forms.form_records(all_pages(spark, sf_dir), RECORDS)
    return rows.select("page_id", "form_ix", "record_ix", F.explode("record").alias("name", "value"))


QUERIES["F26"] = _records
ORACLE["F26"] = RECORDS_SQL


@register("form_to_dataset", f"SELECT name, count(*) AS n, count(DISTINCT value) AS values, max(length(value))::INT AS longest FROM ({RECORDS_SQL}) GROUP BY name")
def form_to_dataset(spark, sf_dir):
    return _records(spark, sf_dir).groupBy("name").agg(
        F.count("*").alias("n"), F.countDistinct("value").alias("values"), F.max(F.length("value")).alias("longest")
    )


# --- HTML helpers on real pages ------------------------------------------------------------------

A_TAGS = f"regexp_extract_all(regexp_replace(html, {text(NOISE)}, '<!>', 'g'), {text(tag_pattern('a'))})"


@register(
    "fn_html_attr",
    f"""SELECT page_id, link_ix, {attr("href")} AS href FROM (SELECT page_id, (ord - 1)::INT AS link_ix, {attrs("tag")} AS attrs FROM
    (SELECT page_id, unnest({A_TAGS}) AS tag, generate_subscripts({A_TAGS}, 1) AS ord FROM ({PAGES_SQL}))) WHERE {attr("href")} IS NOT NULL""",
)
def fn_html_attr(spark, sf_dir):
    return forms.links(all_pages(spark, sf_dir))


@register("fn_html_text", f"SELECT page_id, {shown('html')} AS shown FROM ({PAGES_SQL})")
def fn_html_text(spark, sf_dir):
    return all_pages(spark, sf_dir).select("page_id", inner_text(F.col("html")).alias("shown"))


INPUT_TAGS = f"regexp_extract_all(html, {text(tag_pattern('input'))})"


@register(
    "fn_to_int",
    f"SELECT page_id, input_ix, try_cast(trim({attr('min')}) AS INT)::VARCHAR AS lowest, try_cast(trim({attr('max')}) AS INT)::VARCHAR AS highest FROM (SELECT page_id, (ord - 1)::INT AS input_ix, {attrs('tag')} AS attrs FROM "
    f"(SELECT page_id, unnest({INPUT_TAGS}) AS tag, generate_subscripts({INPUT_TAGS}, 1) AS ord FROM ({PAGES_SQL})))",
)
def fn_to_int(spark, sf_dir):
    tags = F.regexp_extract_all("html", F.lit(tag_pattern("input")), F.lit(0))
    rows = all_pages(spark, sf_dir).select("page_id", F.posexplode(tags).alias("input_ix", "tag"))
    return rows.select("page_id", "input_ix", *[F.trim(attribute_of(F.col("tag"), a)).try_cast("int").cast("string").alias(n) for a, n in (("min", "lowest"), ("max", "highest"))])


# Ten pages to a file, and a file that is not UTF-8.
PAGE_FILES_SQL = "SELECT page_id // 10 AS file, string_agg(replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10) ORDER BY page_id) || chr(10) AS html FROM pages GROUP BY ALL"
FOREIGN = 999_999


def numbered_path() -> Column:
    return F.regexp_extract("path", "file=([0-9]+)", 1).cast("bigint").alias("file")


@register(
    "src_pages",
    f"SELECT file, md5(html) AS html_md5, length(html)::INT AS chars, NULL::VARCHAR AS problem FROM ({PAGE_FILES_SQL}) UNION ALL SELECT {FOREIGN}, NULL, NULL, 'not UTF-8'",
)
def src_pages(spark, sf_dir):
    """Pages written to files and read back as whole files, with the one that is no text."""
    path = scratch_path(spark, "pages")
    rows = table(spark, sf_dir, "pages").select(F.expr("page_id div 10").alias("file"), "page_id", "html")
    rows.repartition("file").sortWithinPartitions("file", "page_id").drop("page_id").write.partitionBy("file").text(path)
    foreign = spark.createDataFrame([("<p>ma\u00f1ana</p>",)], "html string").coalesce(1)
    foreign.write.option("encoding", "ISO-8859-1").csv(f"{path}/file={FOREIGN}")
    read = source.read_pages(spark, f"{path}/*/part-*").select(numbered_path(), F.md5("html").alias("html_md5"), F.length("html").alias("chars"), F.lit(None).cast("string").alias("problem"))
    bad = source.rejected_files(spark, f"{path}/*/part-*").select(numbered_path(), F.lit(None).cast("string").alias("html_md5"), F.lit(None).cast("int").alias("chars"), "problem")
    return read.unionByName(bad)


# --- API documents -------------------------------------------------------------------------------

DOCS_SQL = f"docs AS (SELECT spec_id, clean::JSON AS doc FROM ({SPECS_SQL}) WHERE starts_with(ltrim(clean), '{{') AND json_valid(clean))"
ENTRIES = "map_entries(CAST(coalesce({x}, '{{}}'::JSON) AS MAP(VARCHAR, JSON)))"


def entries(x: str) -> str:
    return ENTRIES.format(x=x)


FIRST, LATER = entries("doc->'components'->'schemas'"), entries("doc->'definitions'")
SCHEMAS_SQL = f"""{DOCS_SQL},
listed AS (SELECT spec_id, 0 AS part, unnest({FIRST}) AS e, generate_subscripts({FIRST}, 1) AS ord FROM docs
  UNION ALL SELECT spec_id, 1, unnest({LATER}), generate_subscripts({LATER}, 1) FROM docs),
merged AS (SELECT spec_id, e.key AS schema, arg_max(e.value, part)::VARCHAR AS body, arg_min(part * 1000 + ord, part) AS place FROM listed GROUP BY spec_id, e.key),
schemas AS (SELECT spec_id, schema, body, (row_number() OVER (PARTITION BY spec_id ORDER BY place) - 1)::INT AS schema_ix,
  coalesce(len(json_keys(body::JSON->'properties')), 0)::INT AS n_properties FROM merged)"""
PROPS = entries("body::JSON->'properties'")
COLUMNS_SQL = f"""{SCHEMAS_SQL}, columns AS (SELECT spec_id, schema, (ord - 1)::INT AS property_ix, e.key AS property, coalesce(e.value->>'type', 'string') AS type, e.value AS definition
  FROM (SELECT spec_id, schema, unnest({PROPS}) AS e, generate_subscripts({PROPS}, 1) AS ord FROM schemas))"""
ITEMS = entries("doc->'paths'")
DETAILS = entries("item")
ENDPOINTS_SQL = f"""{DOCS_SQL}, items AS (SELECT spec_id, (o - 1)::INT AS path_ix, e.key AS path, e.value AS item FROM
  (SELECT spec_id, unnest({ITEMS}) AS e, generate_subscripts({ITEMS}, 1) AS o FROM docs)),
endpoints AS (SELECT spec_id, path_ix, (o - 1)::INT AS method_ix, path, upper(e.key) AS method, coalesce(e.value->>'summary', '') AS summary, coalesce(e.value->>'description', '') AS description,
  coalesce((e.value->'parameters')::VARCHAR, '[]') AS parameters, coalesce((e.value->'requestBody')::VARCHAR, '{{}}') AS request_body, coalesce((e.value->'responses')::VARCHAR, '{{}}') AS responses
  FROM (SELECT *, unnest({DETAILS}) AS e, generate_subscripts({DETAILS}, 1) AS o FROM items) WHERE lower(e.key) IN ('get', 'post', 'put', 'delete', 'patch', 'options', 'head'))"""
BASE_URL = """coalesce(doc->'servers'->0->>'url', coalesce(doc->'schemes'->>0, 'https') || '://' || (doc->>'host') || coalesce(doc->>'basePath', ''), '')"""


def parsed(spark, sf_dir) -> DataFrame:
    return apispecs.parse_specs(specs(spark, sf_dir))


@register(
    "src_specs",
    f"SELECT spec_id, (starts_with(ltrim(spec), '{{') AND json_valid(spec)) AS readable, length(spec)::INT AS chars FROM ({SPECS_SQL})",
)
def src_specs(spark, sf_dir):
    frame = parsed(spark, sf_dir)
    good = apispecs.accepted(frame).select("spec_id", F.lit(True).alias("readable"), F.length("spec").alias("chars"))
    return good.unionByName(
        apispecs.rejected(frame).select("spec_id", F.lit(False).alias("readable"), F.length("spec").alias("chars"))
    )


@register("api_version", f"WITH {DOCS_SQL} SELECT spec_id, coalesce(doc->>'openapi', doc->>'swagger') AS version FROM docs")
def api_version(spark, sf_dir):
    return apispecs.accepted(parsed(spark, sf_dir)).select("spec_id", apispecs.api_version(F.col("doc")).alias("version"))


@register("api_base_url", f"WITH {DOCS_SQL} SELECT spec_id, {BASE_URL} AS base_url FROM docs")
def api_base_url(spark, sf_dir):
    return apispecs.accepted(parsed(spark, sf_dir)).select("spec_id", apispecs.api_base_url(F.col("doc")).alias("base_url"))


@register("fn_url_join", f"WITH {DOCS_SQL} SELECT spec_id, 'https://' || (doc->>'host') || coalesce(doc->>'basePath', '') AS url FROM docs WHERE doc->>'host' IS NOT NULL")
def fn_url_join(spark, sf_dir):
    docs = apispecs.accepted(parsed(spark, sf_dir)).where("doc.host IS NOT NULL")
    return docs.select("spec_id", F.concat(F.lit("https://"), F.col("doc.host"), F.coalesce("doc.basePath", F.lit(""))).alias("url"))


@register("fn_json_path", f"WITH {DOCS_SQL} SELECT spec_id, doc->'servers'->0->>'url' AS server, coalesce(doc->>'basePath', '/') AS base_path FROM docs")
def fn_json_path(spark, sf_dir):
    docs = apispecs.accepted(parsed(spark, sf_dir))
    return docs.select(
        "spec_id", F.get_json_object("spec", "$.servers[0].url").alias("server"),
        F.coalesce(F.get_json_object("spec", "$.basePath"), F.lit("/")).alias("base_path"),
    )


@register("api_schemas", f"WITH {SCHEMAS_SQL} SELECT spec_id, schema_ix, schema, body, n_properties FROM schemas")
def api_schemas(spark, sf_dir):
    return apispecs.api_schemas(parsed(spark, sf_dir))


@register("set_merge_schemas", f"WITH {SCHEMAS_SQL} SELECT spec_id, string_agg(schema, ',' ORDER BY schema_ix) AS schemas FROM schemas GROUP BY spec_id")
def set_merge_schemas(spark, sf_dir):
    names = F.transform(apispecs.merged_schemas(F.col("doc")), lambda e: e["key"])
    return apispecs.accepted(parsed(spark, sf_dir)).select("spec_id", F.array_join(names, ",").alias("schemas"))


@register("agg_schema_props", f"WITH {SCHEMAS_SQL} SELECT schema, count(*) AS documents, sum(n_properties)::BIGINT AS properties FROM schemas GROUP BY schema")
def agg_schema_props(spark, sf_dir):
    rows = apispecs.api_schemas(parsed(spark, sf_dir))
    return rows.groupBy("schema").agg(F.count("*").alias("documents"), F.sum("n_properties").alias("properties"))


@register("api_columns", f"WITH {COLUMNS_SQL} SELECT spec_id, schema, property_ix, property, type FROM columns")
def api_columns(spark, sf_dir):
    return apispecs.api_columns(apispecs.api_schemas(parsed(spark, sf_dir))).drop("definition")


ENDPOINT_OUT = "spec_id, path_ix, method_ix, path, method, summary, description, parameters, request_body, responses"


@register("api_endpoints", f"WITH {ENDPOINTS_SQL} SELECT {ENDPOINT_OUT} FROM endpoints")
def api_endpoints(spark, sf_dir):
    return apispecs.api_endpoints(parsed(spark, sf_dir))


@register("filter_http_method", f"WITH {ENDPOINTS_SQL} SELECT method, count(*) AS n FROM endpoints GROUP BY method")
def filter_http_method(spark, sf_dir):
    return apispecs.api_endpoints(parsed(spark, sf_dir)).groupBy("method").agg(F.count("*").alias("n"))


@register(
    "api_summary",
    f"""WITH {ENDPOINTS_SQL}, {SCHEMAS_SQL.removeprefix(DOCS_SQL + ',')}
    SELECT d.spec_id, {BASE_URL} AS base_url, (SELECT count(*) FROM schemas s WHERE s.spec_id = d.spec_id)::INT AS schemas_count,
    (SELECT count(*) FROM endpoints e WHERE e.spec_id = d.spec_id)::INT AS endpoints_count,
    coalesce((SELECT string_agg(schema || ' (' || n_properties || ')', ', ' ORDER BY schema_ix) FROM schemas s WHERE s.spec_id = d.spec_id AND schema_ix < 5), '') AS first_schemas,
    greatest((SELECT count(*) FROM schemas s WHERE s.spec_id = d.spec_id) - 5, 0)::INT AS more_schemas,
    coalesce((SELECT string_agg(method || ' ' || path, ', ' ORDER BY path_ix, method_ix) FROM (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY path_ix, method_ix) AS place FROM endpoints) e
      WHERE e.spec_id = d.spec_id AND place <= 5), '') AS first_endpoints,
    greatest((SELECT count(*) FROM endpoints e WHERE e.spec_id = d.spec_id) - 5, 0)::INT AS more_endpoints FROM docs d""",
)
def api_summary(spark, sf_dir):
    return apispecs.api_summary(parsed(spark, sf_dir))


@register(
    "F27",
    f"""WITH {COLUMNS_SQL}, bodies AS (SELECT spec_id, schema, unnest(range(2))::INT AS body_ix FROM schemas),
    valued AS (SELECT b.spec_id, b.schema, b.body_ix, property_ix, to_json(property)::VARCHAR || ':' || coalesce((definition->'example')::VARCHAR,
      CASE WHEN json_array_length(definition->'enum') > 0 THEN
        (definition->'enum'->(('0x' || substr(sha256('42|' || b.spec_id || '|' || b.schema || '|' || b.body_ix || '|' || property), 1, 13))::BIGINT % json_array_length(definition->'enum'))::INT)::VARCHAR END,
      CASE type WHEN 'string' THEN to_json('test_' || property)::VARCHAR WHEN 'integer' THEN '0' WHEN 'boolean' THEN 'false' ELSE 'null' END) AS pair
      FROM bodies b LEFT JOIN columns c ON c.spec_id = b.spec_id AND c.schema = b.schema)
    SELECT spec_id, schema, body_ix, '{{' || coalesce(string_agg(pair, ',' ORDER BY property_ix), '') || '}}' AS request FROM valued GROUP BY ALL""",
)
def schema_records(spark, sf_dir):
    return apispecs.request_bodies(apispecs.api_schemas(parsed(spark, sf_dir)), 2)


# Every document's schemas as tables of their own columns.
DATASET_ROWS = 2
DATASET_NAMES = [
    "nombre", "email", "edad", "activo", "tipo", "peso", "nivel", "puntos", "id", *(f"c{i}" for i in range(25)), "viejo", "s", "nuevo", "otro", *(f"email_{k}" for k in range(8)),
]
DATASET_SQL = unpivoted(
    generated(f"SELECT spec_id * {DATASET_ROWS} + i AS id_, spec_id, i AS record_ix FROM ({SPECS_SQL}), (SELECT unnest(range({DATASET_ROWS}))::INT AS i)", "id_", DATASET_NAMES, ["spec_id", "record_ix"]),
    DATASET_NAMES, ["spec_id", "record_ix"],
)


@register(
    "api_to_dataset",
    f"""WITH {COLUMNS_SQL}, v AS ({DATASET_SQL}) SELECT c.spec_id, c.schema, v.record_ix, string_agg(c.property || '=' || v.value, '|' ORDER BY c.property_ix) AS record
    FROM columns c JOIN v ON v.spec_id = c.spec_id AND v.name = c.property GROUP BY ALL""",
)
def api_to_dataset(spark, sf_dir):
    records = apispecs.schema_datasets(apispecs.api_schemas(parsed(spark, sf_dir)), DATASET_ROWS)
    pairs = F.transform(F.map_entries("record"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return records.select("spec_id", "schema", "record_ix", F.array_join(pairs, "|").alias("record"))


@register(
    "api_resolve_columns",
    f"""WITH {COLUMNS_SQL} SELECT property, CASE WHEN clean IN ({EXACT}) THEN clean {FUZZY} ELSE '{FALLBACK}' END AS provider, count(*) AS n
    FROM (SELECT property, lower(trim(property)) AS clean FROM columns) GROUP BY ALL""",
)
def api_resolve_columns(spark, sf_dir):
    columns = apispecs.api_columns(apispecs.api_schemas(parsed(spark, sf_dir))).select("property")
    resolved = resolve_frame(columns, BASE, "property")
    return resolved.groupBy("property", "provider").agg(F.count("*").alias("n"))


@register("api_stress_volume", "SELECT c_custkey, least(c_custkey * 10, 1000000) AS volumen FROM customer")
def api_stress_volume(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", stress_volume(F.col("c_custkey")).alias("volumen"))

