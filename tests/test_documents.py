from __future__ import annotations

import collections
import json
import random
import re
import time

from pyspark.sql import functions as F

from veladura.operators import apispecs, forms, report
from veladura.operators.jobs import keep_first
from veladura.plans import inputs

PAGE = """<html><!-- <form><input name=ghost></form> --><script>var a='<input name="js">'</script>
<form action="/submit?a=1&amp;b=2" method="post" id=f1><input type="text" name="Nombre " required placeholder="a > b"><input type='email' name='email' required>
<input type="number" name="edad" min="18" max="99"><select name="pais"><option>M&eacute;xico</option><option value="x"> Espa&#241;a </option><option></option></select>
<textarea name="comentarios"> hola <b> x </b></textarea><button type="submit" name="s">Enviar</button><button name=b2>Ir</button>
<input type=radio name=r value=a><input type=radio name=r value=b><input type=hidden id=h1><input type=range name=rg><input type=submit name=sub><input name=edad>
<form><input name=inner></form><input name=after></form><form id=z><input name=last>"""


def pages(spark):
    return spark.createDataFrame([(1, PAGE), (2, "<p>sin campos</p>"), (3, "<input name=q><button name=w>"), (4, None)], "page_id int, html string")


def test_forms(spark):
    rows = forms.form_list(pages(spark)).orderBy("page_id", "form_ix").collect()
    assert [(r["page_id"], r["form_ix"], r["action"], r["method"], r["form_id"]) for r in rows] == [
        (1, 0, "/submit?a=1&b=2", "POST", "f1"), (1, 1, "", "GET", None), (1, 2, "", "GET", "z"), (3, 0, "", "GET", "loose_inputs"),
    ]


def test_fields(spark):
    rows = forms.form_fields(pages(spark)).where("page_id = 1 AND form_ix = 0").orderBy("field_ix").collect()
    assert [(r["name"], r["type"]) for r in rows] == [
        ("nombre", "text"), ("email", "email"), ("edad", "number"), ("r", "radio"), ("h1", "hidden"), ("rg", "range"), ("inner", "text"),
        ("after", "text"), ("pais", "select"), ("comentarios", "textarea"), ("b2", "button"),
    ]
    by_name = {r["name"]: r for r in rows}
    assert by_name["nombre"]["required"] and by_name["nombre"]["placeholder"] == "a > b"
    assert (by_name["edad"]["min_value"], by_name["edad"]["max_value"]) == (18, 99)
    assert (by_name["rg"]["min_value"], by_name["rg"]["max_value"]) == (0, 100)
    assert by_name["pais"]["options"] == ["México", "España"] and by_name["r"]["options"] == ["a", "b"]
    assert by_name["comentarios"]["default_value"] == "holax" and not by_name["h1"]["visible"]


def test_config_and_records(spark):
    config = forms.form_config(pages(spark)).where("page_id = 3").first()
    assert config["columns"] == ["q"] and config["total_fields"] == 2 and config["field_names"] == ["q", "w"]
    records = forms.form_records(pages(spark), 5).where("page_id = 1 AND form_ix = 0").collect()
    assert len(records) == 5
    for r in records:
        record = r["record"]
        assert 18 <= int(record["edad"]) <= 99 and record["pais"] in ("México", "España") and record["r"] in ("a", "b") and "@" in record["email"]


def test_places_of_forms(spark):
    """first_char and n_chars cut the inner HTML out of the page without comments, scripts and styles."""
    clean = forms.without_noise(F.col("html"))
    rows = forms.form_list(pages(spark)).join(pages(spark).select("page_id", clean.alias("clean")), "page_id").where("page_id = 1").orderBy("form_ix").collect()
    inner = [r["clean"][r["first_char"] : r["first_char"] + r["n_chars"]] for r in rows]
    assert inner[0].startswith('<input type="text"') and inner[0].endswith("<input name=after>") and inner[1:] == ["<input name=inner>", "<input name=last>"]


def model(html):
    """Forms of a page by a stack, as the names of their inputs."""
    open_, found = [], []
    for tag in re.findall(r"<form>|</form>|<input name=\w+>", html):
        if tag == "<form>":
            open_.append(len(found))
            found.append([])
        elif tag == "</form>":
            open_ = open_[:-1]
        else:
            for i in open_:
                found[i].append(tag[12:-1])
    return found


def test_nested_and_unclosed_forms(spark):
    draw = random.Random(2)
    html = ["".join(draw.choice(["<form>", "</form>", f"<input name=n{draw.randrange(9)}>", "text"]) for _ in range(60)) for _ in range(150)]
    frame = spark.createDataFrame(list(enumerate(html)), "page_id int, html string")
    every = collections.defaultdict(list)
    for r in forms.form_fields(frame, unique=False).orderBy("page_id", "form_ix", "field_ix").collect():
        every[r["page_id"], r["form_ix"]].append(r["name"])
    first = {(r["page_id"], r["form_ix"]): r["field_names"] for r in forms.form_config(frame).collect()}
    for k, page in enumerate(html):
        for i, names in enumerate(model(page)):
            assert every.get((k, i), []) == names and first[k, i] == list(dict.fromkeys(names))


def test_many_unclosed_forms_and_radios(spark):
    """Work grows with the page: headers of unclosed forms copy no text, options of a radio group are gathered once."""
    took = []
    for n in (500, 4000):
        page = spark.createDataFrame([(1, "<form><input name=a>" * n)], "page_id int, html string")
        began = time.time()
        rows = forms.form_list(page).agg({"n_chars": "sum", "form_ix": "count"}).first()
        took.append(time.time() - began)
        assert (rows["count(form_ix)"], rows["sum(n_chars)"]) == (n, sum(20 * k + 14 for k in range(n)))
    assert took[1] < 10
    group = "".join(f"<input type=radio name=r{i % 40} value={i}>" for i in range(4000))
    rows = forms.form_fields(spark.createDataFrame([(1, f"<form><input name=r3>{group}</form>")], "page_id int, html string")).orderBy("field_ix").collect()
    assert [r["name"] for r in rows[:3]] == ["r3", "r0", "r1"] and len(rows) == 40
    assert rows[0]["options"] == [] and rows[1]["options"] == [str(i) for i in range(0, 4000, 40)]


def test_keep_first_is_by_order(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "k string, o int, v string")
    assert sorted(map(tuple, keep_first(df, ["k"], "o").collect())) == [("a", 1, "y"), ("b", 3, None)]


def test_extraction_does_not_shuffle(spark):
    plan = forms.form_records(pages(spark), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


SPEC = {
    "openapi": "3.0.0", "servers": [{"url": "http://h/v1"}],
    "paths": {"/u": {"get": {"summary": "L"}, "parameters": [], "POST": {"parameters": [{"name": "x"}]}}},
    "components": {"schemas": {"Z": {"properties": {"b": {"type": "string", "example": 'q"x'}, "a": {"type": "integer"}, "e": {"enum": ["u", "v"]}, "n": {"type": "number"}}}, "Y": {}}},
    "definitions": {"Z2": {"properties": {"k": {"type": "boolean"}}}, "Y": {"properties": {"y": {}}}},
}


def test_specs(spark):
    df = spark.createDataFrame(
        [(1, json.dumps(SPEC)), (2, '{"swagger":"2.0","host":"h","basePath":"/b"}'), (3, "{roto"), (4, "openapi: 3"), (5, None)],
        "spec_id int, spec string",
    )
    parsed = apispecs.parse_specs(df)
    assert sorted(r["spec_id"] for r in apispecs.rejected(parsed).collect()) == [3, 4, 5]
    good = {r["spec_id"]: r for r in apispecs.accepted(parsed).select("spec_id", apispecs.api_version(parsed["doc"]).alias("v"), apispecs.api_base_url(parsed["doc"]).alias("u")).collect()}
    assert (good[1]["v"], good[1]["u"], good[2]["v"], good[2]["u"]) == ("3.0.0", "http://h/v1", "2.0", "https://h/b")
    schemas = apispecs.api_schemas(parsed)
    assert [(r["schema"], r["n_properties"]) for r in schemas.orderBy("schema_ix").collect()] == [("Z", 4), ("Y", 1), ("Z2", 1)]
    columns = apispecs.api_columns(schemas).where("schema = 'Z'").orderBy("property_ix").collect()
    assert [(c["property"], c["type"]) for c in columns] == [("b", "string"), ("a", "integer"), ("e", "string"), ("n", "number")]
    ends = apispecs.api_endpoints(parsed).orderBy("method_ix").collect()
    assert [(e["path"], e["method"], e["summary"], e["parameters"]) for e in ends] == [("/u", "GET", "L", "[]"), ("/u", "POST", "", '[{"name":"x"}]')]
    bodies = apispecs.request_bodies(schemas, 4).collect()
    for b in bodies:
        body = json.loads(b["request"])
        if b["schema"] == "Z":
            assert body["b"] == 'q"x' and body["a"] == 0 and body["e"] in ("u", "v") and body["n"] is None
        elif b["schema"] == "Y":
            assert body == {"y": "test_y"}
        else:
            assert body == {"k": False}
    summary = apispecs.api_summary(parsed).where("spec_id = 1").first()
    assert (summary["schemas_count"], summary["endpoints_count"], summary["first_schemas"]) == (3, 2, "Z (4), Y (1), Z2 (1)")


def test_repeated_keys_and_broken_documents(spark):
    """What Python's reader makes of a document: the last of repeated keys, in the place of the first; the rest is rejected."""
    repeated = '{"openapi":"3.0.0","paths":{},"openapi":"3.0.1","paths":{"/a":{"get":{},"put":{},"get":{"summary":"x"}},"/b":{},"/a":{"post":{"summary":"1","summary":"2"}}},' \
        '"components":{"schemas":{"S":{"properties":{"p":{},"q":{"type":"integer"},"p":{"type":"boolean","type":"number"}}},"T":{},"S":{"properties":{"z":{},"y":{"type":"number"},"z":{"type":"integer"}}}}}}'
    broken = ['{"a":1} x', '{"a":1}{"b":2}', '{"a":1},{"b":2}', "{'a':1}", '{"a":', "[]", "", None, '{"a":01}']
    rows = [(0, repeated), *enumerate(broken, 1), (50, ' {"openapi":"3.0.0","openapi":"3.0.1","paths":{}} ')]
    parsed = apispecs.parse_specs(spark.createDataFrame(rows, "spec_id int, spec string"))
    assert sorted(r["spec_id"] for r in apispecs.rejected(parsed).collect()) == list(range(1, len(broken) + 1))
    versions = {r[0]: r[1] for r in apispecs.accepted(parsed).select("spec_id", apispecs.api_version(parsed["doc"])).collect()}
    assert versions == {0: "3.0.1", 50: "3.0.1"}
    first = parsed.where("spec_id = 0")
    schemas = apispecs.api_schemas(first)
    assert [(r["schema"], r["n_properties"]) for r in schemas.orderBy("schema_ix").collect()] == [("S", 2), ("T", 0)]
    assert [(r["property"], r["type"]) for r in apispecs.api_columns(schemas).orderBy("property_ix").collect()] == [("z", "integer"), ("y", "number")]
    assert [(r["path"], r["method"], r["summary"]) for r in apispecs.api_endpoints(first).collect()] == [("/a", "POST", "2")]
    assert json.loads(repeated)["paths"]["/a"] == {"post": {"summary": "2"}}


def test_summaries_tell_how_many_more(spark):
    doc = {"openapi": "3.0.0", "paths": {f"/p{i}": {"get": {}, "post": {}} for i in range(6)}, "components": {"schemas": {f"S{i}": {} for i in range(9)}}}
    row = apispecs.api_summary(apispecs.parse_specs(spark.createDataFrame([(1, json.dumps(doc))], "spec_id int, spec string"))).first()
    assert (row["schemas_count"], row["more_schemas"], row["endpoints_count"], row["more_endpoints"]) == (9, 4, 12, 7)
    assert row["first_endpoints"] == "GET /p0, POST /p0, GET /p1, POST /p1, GET /p2"
    groups = spark.createDataFrame([(k, i) for k, n in (("a", 40), ("b", 2), (None, 7)) for i in range(n)], "g string, v int").repartition(5)
    shown = report.preview_groups(groups, ["g"], 3, [F.desc("v")])
    got = sorted(((r["g"], r["place"], r["v"], r["more"]) for r in shown.collect()), key=str)
    assert got == sorted([("a", 1, 39, 37), ("a", 2, 38, 37), ("a", 3, 37, 37), ("b", 1, 1, 0), ("b", 2, 0, 0), (None, 1, 6, 4), (None, 2, 5, 4), (None, 3, 4, 4)], key=str)
    assert "WindowGroupLimit" in shown._jdf.queryExecution().executedPlan().toString()


def test_every_schema_has_its_own_columns(spark):
    docs = [{"components": {"schemas": {"A": {"properties": {"email": {}, "edad": {}}}, "Leer": {}}}}, {"definitions": {"A": {"properties": {"zeta": {}, "Nombre": {}, "alfa": {}}}}}]
    parsed = apispecs.parse_specs(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "spec_id bigint, spec string"))
    rows = apispecs.schema_datasets(apispecs.api_schemas(parsed), 3).withColumn("names", F.map_keys("record")).collect()
    records = {(r["spec_id"], r["schema"], r["record_ix"]): r["record"] for r in rows}
    assert {(r["spec_id"], r["schema"], r["record_ix"]): r["names"] for r in rows} == {(0, "A", i): ["email", "edad"] for i in range(3)} | {(1, "A", i): ["zeta", "Nombre", "alfa"] for i in range(3)}
    assert all("@" in r["email"] and 18 <= int(r["edad"]) <= 90 for (d, _, _), r in records.items() if d == 0) and len({r["email"] for (d, _, _), r in records.items() if d == 0}) == 3


def test_references_are_decoded_once(spark):
    from veladura.functions.html import unescape

    cases = {"&#xE9;&hellip;&mdash;&ordm;": "é…—º", "&#38;lt; &amp;lt;": "&lt; &lt;", "a & b &nope;": "a & b &nope;", "&#8364;&euro;&apos;": "€€'", "": ""}
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", unescape(F.col("t")).alias("u")).collect()
    assert {r["t"]: r["u"] for r in rows} == cases


def test_attributes_are_looked_up_beforehand(spark):
    """A field's type decides a dozen of its columns; it is searched among the attributes of its tag as it is and as an input's, no more."""
    plan = forms.forms_with_fields(pages(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f".name = {a})") for a in ("type", "min", "max", "pattern", "placeholder")] == [2, 1, 1, 1, 1]


def test_pages_and_parts_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    """Pages of one row group are dealt as parts are, and no row is lost or doubled."""
    monkeypatch.setattr(inputs, "PAGES_PER_TASK", 10)
    rows = spark.range(40).selectExpr("id AS page_id", "concat('<form><input name=a', id, '></form>') AS html")
    rows.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    spark.range(40).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "1 AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    dealt = inputs.form_pages(spark, str(tmp_path))
    assert dealt.rdd.getNumPartitions() == 8
    assert sorted(r.page_id for r in dealt.select("page_id").collect()) == [*range(40), *(inputs.PAGE_SHIFT + i for i in range(40))]
