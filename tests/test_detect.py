"""Detection against a small model in plain Python, plus literal cases."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from veladura.functions.rules import KEYWORDS, LEVELS, RULES, java_pattern, select_rules
from veladura.operators import report
from veladura.operators.detect import MARKER, HitSet, detect, detect_table, running, text_columns, with_hit_sets, with_hits
from veladura.operators.mask import censor_levels
from veladura.plans import inputs, pii_queries


def model_confidence(kind, value, context, base):
    c = base
    for word in KEYWORDS.get(kind, []):
        if word in context.lower():
            c = min(c + 0.05, 0.99)
    if kind == "rfc" and len(value) not in (12, 13) or kind == "curp" and len(value) != 18:
        c *= 0.7
    if kind == "email" and ("@" not in value or "." not in value.split("@")[-1]):
        c *= 0.5
    return min(c, 0.99)


def model(text, rules=RULES):
    hits = []
    for rule in rules:
        for m in re.finditer(rule.pattern, text, re.I if rule.ignore_case else 0):
            context = text[max(0, m.start() - 30) : m.end() + 30]
            c = model_confidence(rule.type, m.group(), context, rule.confidence)
            if c >= 0.6:
                hits.append((rule.type, m.group(), m.start(), m.end(), context, c))
    kept = []
    for h in sorted(hits, key=lambda h: (h[2], -h[5])):
        clash = next((k for k in kept if h[2] < k[3] and h[3] > k[2]), None)
        if clash is None:
            kept.append(h)
        elif h[5] > clash[5]:
            kept.remove(clash)
            kept.append(h)
    return kept


PIECES = [
    "ABCD850101XY1", "ñabc561231j98", "XEXT990101NI4A", "GODE561231HDFRRN09", "ana.perez@mail.com", "a@b.co", "x@y", "5512345678", "55 1234 5678",
    "12345678", "1234-5678", "10.0.0.1", "999.1.22.333", "aa:bb:cc:dd:ee:ff", "AA-BB-CC-01-02-03", "0f8fad5b-d9cb-469f-a165-70867728950e",
    "4111-1111-1111-1111", "4111111111111111", "12345678901", "1234567890", "ABC-123", "123 xyz", "06500", "31/12/1999", "01-02-2005", "No. 12",
    "Núm 45", "NÚM.7", "#9", "a#123", "rfc", "CURP", "correo", "tel", "móvil", "contribuyente", "señal", "é", "ñ", "Ú", "🐍", "\n", "\t", ",", ".",
    "__", "edad: 33", "٣٤٥٦٧", "", " ", "  ", "-", MARKER,
]


@pytest.fixture(scope="module")
def random_texts():
    rng = random.Random(7)
    return ["".join(rng.choice(PIECES) + rng.choice(["", " ", " ", ";"]) for _ in range(rng.randrange(0, 14))) for _ in range(2000)]


def test_matches_the_model(spark, random_texts):
    df = spark.createDataFrame(list(enumerate(random_texts)), "id int, text string").repartition(4)
    found = {}
    for r in detect(df, "text", ["id"]).collect():
        found.setdefault(r["id"], []).append((r["hit_ix"], (r["type"], r["value"], r["start"], r["end"], r["context"], r["confidence"])))
    for i, text in enumerate(random_texts):
        got = [h for _, h in sorted(found.get(i, []))]
        assert got == model(text), text


def test_null_empty_and_one_character_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "7")], "id int, text string")
    assert [r["hits"] for r in with_hits(df, "text").orderBy("id").collect()] == [[], [], []]


def test_unicode_digits_pass_the_gates(spark):
    text = "llame al ٥٥١٢٣٤٥٦٧٨ hoy"
    rows = detect(spark.createDataFrame([(1, text)], "id int, text string"), "text", ["id"]).collect()
    assert [(r["type"], r["value"]) for r in rows] == [(h[0], h[1]) for h in model(text)] != []


def test_shape_penalties_only_bite_on_custom_rules(spark):
    custom = {r"RF\d{4}": "rfc", r"C\d{3}": "curp", r"m=\w+": "email"}
    df = spark.createDataFrame([(1, "RF1234 C123 m=juan")], "id int, text string")
    rules = [r for r in select_rules(None, custom) if r.confidence == 0.90 and r.pattern in custom]
    hits = {r["type"]: r["confidence"] for r in detect(df, "text", ["id"], rules, min_confidence=0.0).collect()}
    assert hits["rfc"] == pytest.approx(0.63) and hits["curp"] == pytest.approx(0.63) and hits["email"] == pytest.approx(0.45)


def test_rules_that_cannot_be_used_are_refused():
    with pytest.raises(ValueError):
        select_rules(None, {r"x*": "vacio"})
    with pytest.raises(ValueError):
        select_rules(["no existe"])
    with pytest.raises(ValueError):
        select_rules(None, {r"x": "a'b"})


def test_table_scan_takes_text_columns_only(spark):
    df = spark.createDataFrame([(1, "tel 5512345678", "a@b.co", 5)], "id int, nota string, `co.rreo` string, n int")
    assert text_columns(df, ["NOT"]) == ["co.rreo"]
    rows = detect_table(df, ["id"]).collect()
    assert {(r["column"], r["type"]) for r in rows} == {("nota", "telefono"), ("co.rreo", "email")}


def test_long_text_with_many_hits(spark):
    text = " ".join(f"{10000 + i}" for i in range(3000))
    row = with_hits(spark.createDataFrame([(text,)], "text string"), "text", select_rules(["codigo_postal"])).first()
    assert [h["start"] for h in row["hits"]] == [6 * i for i in range(3000)]


def test_detection_runs_once_and_without_python(spark):
    df = spark.createDataFrame([(1, "a@b.co")], "id int, text string")
    marked = with_hits(df, "text").where(F.size("hits") > 0)
    for frame in (marked, report.pii_by_type(marked), detect(df, "text", ["id"])):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("translate(") == 1 and "Python" not in plan


def test_reports(spark):
    df = spark.createDataFrame([(1, "a@b.co a@b.co 06500"), (2, "nada"), (3, "b@c.co")], "id int, text string")
    marked = with_hits(df, "text")
    assert report.pii_totals(marked).first().asDict() == {"total_hits": 4, "texts_with_hits": 2, "texts": 3}
    assert [(r["type"], r["n"]) for r in report.by_count(report.pii_by_type(marked)).collect()] == [("email", 3), ("codigo_postal", 1)]
    values = marked.where("id = 1").select(report.pii_values(F.col("hits")).alias("v")).first()["v"]
    assert [(v["type"], v["values"]) for v in values] == [("email", ["a@b.co"]), ("codigo_postal", ["06500"])]
    first = report.distinct_values(marked, "hits", "id").where("value = 'a@b.co'").first()
    assert (first["first_id"], first["first_start"], first["n"]) == (1, 0, 2)


def test_many_hits_in_one_text_take_linear_time(spark):
    import time

    rules = select_rules(["codigo_postal"])

    def seconds(n):
        df = spark.createDataFrame([(" ".join(f"CP {i % 90000 + 10000}" for i in range(n)),)], "text string").cache()
        df.count()
        began = time.time()
        assert with_hits(df, "text", rules).select(F.size("hits")).first()[0] == n
        return time.time() - began

    seconds(32_000)
    half, whole = min(seconds(32_000) for _ in range(2)), min(seconds(64_000) for _ in range(2))
    assert whole < 30 and whole <= 2.5 * half + 0.5


def test_long_texts_have_the_hits_of_their_parts(spark):
    part = "ñ😀 RFC: GODE561231GR8 y correo ana@example.com tel 5512345678 CP 06700. "
    row = with_hits(spark.createDataFrame([(part * 300,), (part,)], "text string"), "text").collect()
    many, one = (r["hits"] for r in row)
    assert len(many) == 300 * len(one)
    assert [(h["value"], h["start"] % len(part)) for h in many[-len(one) :]] == [(h["value"], h["start"]) for h in one]
    assert all((part * 300)[h["start"] : h["end"]] == h["value"] for h in many)


def test_rule_sets_share_one_detection(spark):
    """Several sets from one pass of every pattern equal those found apart; the sets' order must agree."""
    draw = random.Random(9)
    parts = ["ana@x.com", "5512345678", "10.0.0.1", "rfc: ABCD800101XY1", "CP 01234", "edad: 33", " ", "x"]
    texts = spark.createDataFrame([(i, " ".join(draw.choices(parts, k=6))) for i in range(200)], "id int, t string")
    low, medium = select_rules(LEVELS["bajo"]), select_rules(LEVELS["medio"])
    sets = {"all": HitSet(), "every": HitSet(overlaps=True), "sure": HitSet(min_confidence=0.9), "low": HitSet(tuple(low)), "medium": HitSet(tuple(medium))}
    together = with_hit_sets(texts, "t", sets)
    for out, wanted in sets.items():
        apart = with_hits(texts, {"t": "h"}, wanted.rules, wanted.min_confidence, wanted.overlaps)
        assert together.select("id", out).collect() == apart.select("id", "h").collect(), out
    plan = censor_levels(texts, "t", ["id"])._jdf.queryExecution().optimizedPlan().toString()
    mail = next(r for r in RULES if r.type == "email")
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    assert plan.count(f", {java_pattern(mail)}, {MARKER}$0{MARKER}") == 1
    with pytest.raises(ValueError):
        with_hit_sets(texts, "t", {"a": HitSet(), "b": HitSet(tuple(reversed(RULES)))})


def test_running_over_one_block_or_many(spark):
    """Sums and maxima before each element, for arrays up to, at and over a block, empty and null ones."""
    sizes = [0, 1, 31, 32, 33, 1023, 1024, 1100]
    rows = spark.createDataFrame([([i * 7 % 13 for i in range(n)],) for n in sizes] + [(None,)], "a array<int>")
    found = rows.select("a", F.expr(running("a", "int", "0", "x + y")).alias("sums"), F.expr(running("a", "int", "0", "greatest(x, y)")).alias("tops")).collect()
    for a, sums, tops in found:
        assert sums == (None if a is None else [sum(a[:i]) for i in range(len(a))])
        assert tops == (None if a is None else [max(a[:i], default=0) for i in range(len(a))])


def test_notes_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    """Orders of one file become notes in tasks of a bounded number of rows, alone and among the other texts."""
    for module in (inputs, pii_queries):
        monkeypatch.setattr(module, "NOTES_PER_TASK", 50)
    orders = spark.range(400).selectExpr("id AS o_orderkey", "id AS o_custkey", "'O' AS o_orderstatus", "1.5D AS o_totalprice", "'1-URGENT' AS o_orderpriority")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    for name, columns in (("documents", "doc_id bigint, text string"), ("pages", "page_id bigint, html string"), ("conversations", "conv_id bigint, turn int, text string")):
        spark.createDataFrame([], columns).write.parquet(str(tmp_path / f"{name}.parquet"))
    for frame in (pii_queries.cards(spark, str(tmp_path)), inputs.corpus(spark, str(tmp_path))):
        sizes = [r["count"] for r in frame.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 400 and max(sizes) <= 60
