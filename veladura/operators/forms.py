"""HTML forms to rows: forms of a page, their fields, and synthetic records for them.

One page is one row and every step is an expression over it, so extraction needs
no shuffle; only reports over many forms aggregate. A page is cut once, at its form tags, into gaps. Every form is a
stretch of gaps, found by the depth of the tags, and its fields are stretches of the page's elements, which are read
gap by gap: nested or unclosed forms copy no text. An element ends where a form begins or ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veladura.functions import pools
from veladura.functions.draws import DEFAULT_SEED, digest_byte
from veladura.functions.families import AS_OF_DAY, pool_array
from veladura.functions.html import (
    attribute,
    attribute_parts,
    attributes,
    block_pattern,
    inner_text,
    tag_pattern,
    unescape,
    without_noise,
)
from veladura.operators.detect import running

HAS_FIELDS = r"(?i)<(?:form|input|select|textarea)"
LOOSE_FIELDS = r"(?i)<(?:input|select|textarea)[\s/>]"
LOOSE = "loose_inputs"
FORM_TAG = "(?i)(?:" + tag_pattern("form").removeprefix("(?i)") + r"|</form\s*>)"
OPTION = r"(?is)<option(?:[\s/][^>]*)?>(.*?)(?=<option[\s/>]|</option|</select|<optgroup|</optgroup|\z)"
GIVEN = ["name", "id", "placeholder", "required", "value", "min", "max", "pattern"]
FIELD_COLUMNS = [
    "name", "type", "id", "placeholder", "required", "options", "default_value", "min_value", "max_value", "pattern", "visible",
]


# (i, end) of every form: its tag is event i, it ends at event end, or at the number of events when unclosed. Between
# two depths the tags go up and down in turn, so an opening tag's closing one is the next tag of its level.
SPANS = f"""transform(transform(transform(
  array(transform(__events, t -> if(startswith(t, '</'), -1, 1))), a -> named_struct('s', a, 'b', {running("a", "int", "0", "x + y")})),
  c -> array_sort(transform(c.s, (w, k) -> named_struct('level', get(c.b, k) + greatest(w, 0), 'i', k, 'open', w > 0)))),
  d -> array_sort(transform(filter(transform(d, (w, k) -> named_struct('i', w.i, 'end', if(get(d, k + 1).level = w.level, get(d, k + 1).i, size(d)), 'open', w.open)), w -> w.open),
    w -> named_struct('i', w.i, 'end', w.`end`))))[0]"""
# Characters before every event.
PLACES = running("transform(__gaps, (g, k) -> length(g) + coalesce(length(get(__events, k)), 0))", "int", "0", "x + y")


def _cut(pages: DataFrame, html: str, keys: Sequence[str]) -> DataFrame:
    """keys, __html without noise, __events (form tags), __gaps (texts between them) and __spans of every page that has fields."""
    with_fields = pages.where(F.col(html).rlike(HAS_FIELDS)).select(*keys, without_noise(F.col(html)).alias("__html"))
    clean = F.col("__html")
    none = F.array().cast("array<string>")
    opened = with_fields.withColumn("__events", F.when(clean.rlike(tag_pattern("form")), F.regexp_extract_all(clean, F.lit(FORM_TAG), F.lit(0))).otherwise(none))
    some = F.size("__events") > 0
    loose = F.when(clean.rlike(LOOSE_FIELDS), F.expr("array(named_struct('i', -1, 'end', 0))"))
    return opened.withColumns({"__gaps": F.when(some, F.split(clean, FORM_TAG, -1)).otherwise(F.array(clean)), "__spans": F.when(some, F.expr(SPANS)).otherwise(loose)})


def _headed(forms: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with action, method, id and name read from the form's tag; the pseudo-form has none."""
    tag = F.col("tag")
    parsed = forms.withColumn("__parts", F.struct(*attribute_parts(tag))).withColumn("__attrs", F.when(tag.isNotNull(), attributes(F.col("__parts"))))
    attrs = F.col("__attrs")
    heads = [
        F.coalesce(attribute(attrs, "action"), F.lit("")).alias("action"),
        F.upper(F.coalesce(attribute(attrs, "method"), F.lit("GET"))).alias("method"),
        F.when(tag.isNull(), F.lit(LOOSE)).otherwise(attribute(attrs, "id")).alias("form_id"),
        F.when(tag.isNull(), F.lit(LOOSE)).otherwise(attribute(attrs, "name")).alias("form_name"),
    ]
    return parsed.select(*[h if c is None else c for c in columns for h in (heads if c is None else [c])])


def form_list(pages: DataFrame, html: str = "html", keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """One row per form with action, method, id, name and its place. A page without forms but with
    fields gives one pseudo-form over the whole page; ``form_ix`` numbers the forms of a page.
    ``first_char`` and ``n_chars`` place the inner HTML in the page without comments, scripts and styles."""
    placed = _cut(pages, html, keys).withColumn("__places", F.expr(PLACES))
    spans = """transform(__spans, s -> named_struct('tag', get(__events, s.i), 'first_char', get(__places, s.i + 1),
      'n_chars', get(__places, s.`end`) + length(get(__gaps, s.`end`)) - get(__places, s.i + 1)))"""
    listed = placed.select(*keys, F.posexplode_outer(F.expr(spans)).alias("form_ix", "__form")).where(F.col("form_ix").isNotNull())
    return _headed(listed.select(*keys, "form_ix", "__form.*"), [*keys, "form_ix", None, "first_char", "n_chars"])


def _blocks(gap: Column, name: str, kind: int) -> Column:
    opening = "(?i)^" + tag_pattern(name).removeprefix("(?i)")
    return F.transform(
        F.regexp_extract_all(gap, F.lit(block_pattern(name)), F.lit(0)),
        lambda b: F.struct(F.lit(kind).alias("kind"), F.regexp_extract(b, opening, 0).alias("tag"), F.regexp_replace(b, opening, "").alias("body")),
    )


def _elements(gap: Column) -> Column:
    """Raw elements of a gap: inputs, selects, textareas, buttons, each an array."""
    inputs = F.transform(
        F.regexp_extract_all(gap, F.lit(tag_pattern("input")), F.lit(0)),
        lambda t: F.struct(F.lit(0).alias("kind"), t.alias("tag"), F.lit("").alias("body")),
    )
    return F.array(inputs, _blocks(gap, "select", 1), _blocks(gap, "textarea", 2), _blocks(gap, "button", 3))


def _number(text: Column) -> Column:
    return F.trim(text).try_cast("int")


def _given(e: Column) -> Column:
    """An element with the attributes that a field is made of, looked up before its columns share them, and its type as an input."""
    raw_type = attribute(e["attrs"], "type")
    given = [attribute(e["attrs"], a).alias(f"a_{a}") for a in GIVEN]
    return F.struct(e["kind"].alias("kind"), e["body"].alias("body"), raw_type.alias("a_type"), F.lower(F.coalesce(raw_type, F.lit("text"))).alias("input_type"), *given)


def _field(e: Column) -> Column:
    def get(name: str) -> Column:
        return e[f"a_{name}"]

    kind, raw_type, input_type = e["kind"], get("type"), e["input_type"]
    kind_type = (
        F.when(kind == 0, input_type).when(kind == 1, F.lit("select")).when(kind == 2, F.lit("textarea")).otherwise(F.lit("button"))
    )
    # Only buttons have no id fallback.
    name = F.nullif(get("name"), F.lit(""))
    name = F.when(kind == 3, name).otherwise(F.coalesce(name, F.nullif(get("id"), F.lit(""))))
    options = F.filter(
        F.transform(F.regexp_extract_all(e["body"], F.lit(OPTION), F.lit(1)), inner_text), lambda o: o != ""
    )
    low = F.when(input_type == "range", F.coalesce(_number(get("min")), F.lit(0))).when(input_type == "number", _number(get("min")))
    high = F.when(input_type == "range", F.coalesce(_number(get("max")), F.lit(100))).when(input_type == "number", _number(get("max")))
    wanted = (
        name.isNotNull()
        & ~((kind == 0) & input_type.isin("submit", "reset", "button", "image"))
        & ~((kind == 3) & F.coalesce(raw_type == "submit", F.lit(False)))
    )
    return F.struct(
        F.lower(F.trim(name)).alias("name"),
        kind_type.alias("type"),
        get("id").alias("id"),
        F.when(kind.isin(0, 2), get("placeholder")).alias("placeholder"),
        (get("required").isNotNull() & (kind != 3)).alias("required"),
        F.when(kind == 1, options).otherwise(F.array().cast("array<string>")).alias("options"),
        F.when(kind.isin(2, 3), inner_text(e["body"])).otherwise(get("value")).alias("default_value"),
        F.when(kind == 0, low).alias("min_value"),
        F.when(kind == 0, high).alias("max_value"),
        F.when(kind == 0, F.nullif(get("pattern"), F.lit(""))).alias("pattern"),
        (~((kind == 0) & F.coalesce(raw_type == "hidden", F.lit(False)))).alias("visible"),
        wanted.alias("wanted"),
    )


# A form's fields sorted by name and place; runs of one name are groups, found without comparing pairs.
SORTED = "array_sort(transform(__fields, (f, i) -> named_struct('name', f.name, 'i', i, 'f', f)))"
STARTS = "filter(transform(__sorted, (x, k) -> named_struct('k', k, 'new', k = 0 OR get(__sorted, k - 1).name <> x.name)), x -> x.new)"
RUNS = "transform(__starts, (x, g) -> slice(__sorted, x.k + 1, coalesce(get(__starts, g + 1).k, size(__sorted)) - x.k))"


def _with_groups(staged: DataFrame, others: Sequence[str], unique: bool) -> DataFrame:
    """others, fields: all of raw ``__fields`` or the first of each name. A radio group is several tags: its options are the values of all of them."""
    values = "filter(transform(filter(r, x -> x.f.type = 'radio'), x -> x.f.default_value), v -> v <> '')"
    field = ", ".join(f"'{c}', " + ("if(x.f.type = 'radio', v, x.f.options)" if c == "options" else f"x.f.{c}") for c in FIELD_COLUMNS)
    members = "slice(r, 1, 1)" if unique else "r"
    given = f"flatten(transform({RUNS}, r -> transform(array({values}), v -> transform({members}, x -> named_struct('i', x.i, 'f', named_struct({field}))))[0]))"
    sorted_ = staged.withColumn("__sorted", F.expr(SORTED)).withColumn("__starts", F.expr(STARTS))
    return sorted_.select(*others, F.expr(f"transform(array_sort({given}), x -> x.f)").alias("fields"))


def forms_with_fields(pages: DataFrame, html: str = "html", keys: Sequence[str] = ("page_id",), unique: bool = True) -> DataFrame:
    """One row per form: keys, form_ix, action, method, id, name and ``fields``; ``unique`` keeps the first field of each name."""
    found = _cut(pages, html, keys).withColumn("__found", F.transform("__gaps", _elements))
    kept = [*keys, "__events", "__spans"]
    kinds = range(4)
    counted = found.select(
        *kept, *(F.flatten(F.transform("__found", lambda x: x[k])).alias(f"__flat{k}") for k in kinds),
        *(F.expr(running(f"transform(__found, x -> size(x[{k}]))", "int", "0", "x + y")).alias(f"__before{k}") for k in kinds),
    )
    sizes, starts = [f"size(__flat{k})" for k in kinds], [f"__before{k}" for k in kinds]
    read = F.transform(
        F.transform(
            F.transform(
                F.concat(*(f"__flat{k}" for k in kinds)),
                lambda e: F.struct(e["kind"].alias("kind"), e["body"].alias("body"), F.struct(*attribute_parts(e["tag"])).alias("parts")),
            ),
            lambda e: F.struct(e["kind"].alias("kind"), e["body"].alias("body"), attributes(e["parts"]).alias("attrs")),
        ),
        lambda e: F.transform(F.array(_given(e)), _field)[0],
    )
    parsed = counted.select(*kept, *starts, *(F.expr(x).alias(f"__size{k}") for k, x in enumerate(sizes)), read.alias("__read"))
    # The fields of a form: of each kind the stretch that its gaps hold.
    parts = [
        f"slice(__read, {' + '.join(f'__size{j}' for j in range(k)) or '0'} + get(__before{k}, s.i + 1) + 1, coalesce(get(__before{k}, s.`end` + 1), __size{k}) - get(__before{k}, s.i + 1))"
        for k in kinds
    ]
    spans = f"transform(__spans, s -> named_struct('tag', get(__events, s.i), 'fields', filter(concat({', '.join(parts)}), f -> f.wanted)))"
    listed = parsed.select(*keys, F.posexplode_outer(F.expr(spans)).alias("form_ix", "__form")).where(F.col("form_ix").isNotNull())
    headed = _headed(listed.select(*keys, "form_ix", F.col("__form.tag").alias("tag"), F.col("__form.fields").alias("__fields")), [*keys, "form_ix", None, "__fields"])
    return _with_groups(headed, [*keys, "form_ix", "action", "method", "form_id", "form_name"], unique)


def form_fields(pages: DataFrame, html: str = "html", keys: Sequence[str] = ("page_id",), unique: bool = True) -> DataFrame:
    """One row per field: keys, form_ix, field_ix and the field attributes."""
    fielded = forms_with_fields(pages, html, keys, unique)
    rows = fielded.select(*keys, "form_ix", F.posexplode_outer("fields").alias("field_ix", "__f"))
    return rows.where(F.col("field_ix").isNotNull()).select(*keys, "form_ix", "field_ix", "__f.*")


def choose_fields(fields: DataFrame, indices: Sequence[int]) -> DataFrame:
    """Fields by their position in the form."""
    return fields.where(F.col("field_ix").isin([int(i) for i in indices]))


def form_config(pages: DataFrame, html: str = "html", keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Form header, generator columns (buttons left out) and field counts, one row per form."""
    fielded = forms_with_fields(pages, html, keys)
    usable = F.filter("fields", lambda f: f["type"] != "button")
    return fielded.select(
        *keys, "form_ix", "action", "method", "form_id", "form_name",
        F.transform(usable, lambda f: f["name"]).alias("columns"),
        F.size("fields").alias("total_fields"),
        F.size(F.filter("fields", lambda f: f["required"])).alias("required_fields"),
        F.transform("fields", lambda f: f["name"]).alias("field_names"),
    )


def form_rule(name: Column, kind: Column) -> Column:
    """Which generator fills a field: by type, and for text fields by words in the name."""
    low = F.lower(name)

    def has(*words: str) -> Column:
        found = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            found = found | F.contains(low, F.lit(w))
        return found

    textual = kind.isin("text", "search", "url")
    return (
        F.when(textual & has("email"), "email")
        .when(textual & has("nombre", "name"), "name")
        .when(textual & has("telefono", "phone"), "phone")
        .when(textual, "word")
        .when(kind == "email", "email")
        .when(kind == "number", "number")
        .when(kind.isin("select", "radio"), "option")
        .when(kind == "checkbox", "boolean")
        .when(kind == "textarea", "paragraph")
        .when(kind == "date", "date")
        .otherwise("word")
    )


def _record_value(rule: Column, f: Column, digest: Column) -> Column:
    """Field value from the digest of (form, record, field): bytes pick from the pools."""
    def item(pool: Sequence[str], i: int) -> Column:
        return F.element_at(pool_array(pool), digest_byte(digest, i) % F.lit(len(pool)) + 1)

    def sentence(i: int) -> Column:
        first = F.initcap(item(pools.WORDS, i))
        return F.concat(F.concat_ws(" ", first, *[item(pools.WORDS, i + k) for k in range(1, 5)]), F.lit("."))

    big = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
    low = F.coalesce(f["min_value"], F.lit(0)).cast("bigint")
    high = F.greatest(low, F.coalesce(f["max_value"], F.lit(100)).cast("bigint"))
    digits = F.concat(*[(digest_byte(digest, i) % F.lit(10)).cast("string") for i in range(8)])
    mail = F.concat(
        item(pools.MAIL_FIRST, 0), F.lit("."), item(pools.MAIL_LAST, 1), (digest_byte(digest, 2) + 100).cast("string"),
        F.lit("@"), item(pools.MAIL_DOMAINS, 3),
    )
    chosen = F.get(f["options"], (big % F.greatest(F.size(f["options"]), F.lit(1))).cast("int"))
    return (
        F.when(rule == "email", mail)
        .when(rule == "name", F.concat_ws(" ", item(pools.FIRST_NAMES, 0), item(pools.LAST_NAMES, 1)))
        .when(rule == "phone", F.concat(F.lit("55"), digits))
        .when(rule == "number", (low + big % (high - low + 1)).cast("string"))
        .when((rule == "option") & (F.size(f["options"]) > 0), chosen)
        .when(rule == "boolean", F.when(digest_byte(digest, 0) % F.lit(2) == 1, "true").otherwise("false"))
        .when(rule == "paragraph", F.concat_ws(" ", sentence(0), sentence(5), sentence(10)))
        .when(rule == "date", F.date_from_unix_date((big % F.lit(AS_OF_DAY)).cast("int")).cast("string"))
        .otherwise(item(pools.WORDS, 0))
    )


def form_records(pages: DataFrame, n: int, html: str = "html", keys: Sequence[str] = ("page_id",), seed: int = DEFAULT_SEED) -> DataFrame:
    """``n`` synthetic records per form as a map from field name to text value."""
    fielded = forms_with_fields(pages, html, keys)
    rows = fielded.select(*keys, "form_ix", "fields", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("record_ix"))
    place = F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys], F.col("form_ix"), F.col("record_ix"))
    keyed = F.transform(
        "fields",
        lambda f: F.struct(
            f.alias("f"), form_rule(f["name"], f["type"]).alias("rule"), F.sha2(F.concat_ws("|", place, f["name"]), 256).alias("digest")
        ),
    )
    values = F.transform(keyed, lambda k: _record_value(k["rule"], k["f"], k["digest"]))
    return rows.select(
        *keys, "form_ix", "record_ix", F.map_from_arrays(F.transform("fields", lambda f: f["name"]), values).alias("record")
    )


def links(pages: DataFrame, html: str = "html", keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Link targets of a page, in order."""
    tags = pages.select(
        *keys, F.posexplode_outer(F.regexp_extract_all(without_noise(F.col(html)), F.lit(tag_pattern("a")), F.lit(0))).alias("link_ix", "__tag")
    ).where(F.col("link_ix").isNotNull())
    parsed = tags.withColumn("__parts", F.struct(*attribute_parts(F.col("__tag")))).withColumn("__attrs", attributes(F.col("__parts")))
    return parsed.select(*keys, "link_ix", attribute(F.col("__attrs"), "href").alias("href")).where(F.col("href").isNotNull())


__all__ = [
    "choose_fields", "form_config", "form_fields", "form_list", "form_records", "form_rule", "forms_with_fields", "links", "unescape",
]
