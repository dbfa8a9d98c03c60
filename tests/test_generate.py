from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from veladura.functions.families import AS_OF, Provider
from veladura.operators.catalogue import (
    BASE,
    FAKER_METHODS,
    args_text,
    catalogue_frame,
    merge,
    override_frame,
    parse_provider,
    provider_of,
    providers,
    resolve,
    resolve_frame,
    resolve_name,
)
from veladura.operators.generate import generate, generate_named, generate_over, with_offset_date
from veladura.sources.dictionary import load_catalogue, load_theme, read_dictionary_text


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


SHAPES = {
    "nombre": r"\w+ \w+ \w+", "email": r"[a-z.]+\d{3}@[a-z.]+", "telefono": r"\d\d \d{4} \d{4}", "codigo_postal": r"\d{5}", "rfc": r"[A-Z]{4}\d{6}[A-Z0-9]{3}",
    "curp": r"[A-Z]{4}\d{6}[A-Z]{6}\d{2}", "clabe": r"\d{18}", "uuid": r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}",
    "ip": r"\d{1,3}(\.\d{1,3}){3}", "ipv6": r"[0-9a-f]{4}(:[0-9a-f]{4}){7}", "mac": r"[0-9a-f]{2}(:[0-9a-f]{2}){5}", "hora": r"[0-2]\d:[0-5]\d:[0-5]\d",
    "fecha": r"(19|20)\d\d-\d\d-\d\d", "id_caos": r"[A-Za-z]{4}-\d{8}-[A-Za-z]{4}", "basura": r"[A-Za-z]{15}", "regex": r"[A-Za-z]{3}-\d{3}-[A-Za-z]{3}",
    "password": r"[a-z]{4}[A-Z]{2}[!@#$%&*_]\d{3}", "oracion": r"[A-ZÁÉÍÓÚ]\w*( \w+){2,7}\.", "url": r"https://www\.[a-z]+\.[a-z]+/",
}


@pytest.fixture(scope="module")
def table(spark):
    return generate(spark, 2000, list(BASE), with_id=True).toPandas()


def test_every_base_column_has_values_of_its_kind(table):
    assert len(BASE) == 55 and len(table) == 2000 and not table.isna().any().any()
    for name, shape in SHAPES.items():
        assert table[name].map(lambda v: bool(re.fullmatch(shape, v))).all(), name
    for name, p in BASE.items():
        if p.family == "choice":
            assert set(table[name]) == set(p.args), name
    assert table["edad"].between(18, 90).all() and {18, 90} <= set(table["edad"])
    assert table["salario"].between(8000, 150000).all() and (table["salario"] * 100 % 1).abs().min() < 1e-6
    assert table["tarjeta_credito"].map(luhn).all()
    assert set(table["booleano"]) == {True, False}
    assert (table["fecha_futura"] > AS_OF).all() and (table["fecha_pasada"] < AS_OF).all()
    assert table["uuid"].is_unique


def test_draws_are_even(spark):
    counts = generate(spark, 60_000, ["dia_semana", "booleano"]).groupBy("dia_semana", "booleano").count().collect()
    assert len(counts) == 14 and all(abs(r["count"] - 60_000 / 14) < 350 for r in counts)


def test_same_rows_for_any_partitioning(spark):
    ids = spark.range(3000).withColumnRenamed("id", "k")
    columns = ["nombre", "salario", "uuid", "texto"]
    frames = [generate_over(ids.repartition(n), "k", columns, keep=["k"]).orderBy("k").collect() for n in (1, 4, 16)]
    assert frames[0] == frames[1] == frames[2]
    other = generate_over(ids, "k", columns, keep=["k"], seed=43).orderBy("k").collect()
    assert other[0]["uuid"] != frames[0][0]["uuid"]


def test_ids_beyond_32_bits_do_not_repeat(spark):
    ids = spark.range(10).select((F.col("id") * (1 << 33) + 5).alias("k"))
    assert generate_over(ids, "k", ["uuid"]).distinct().count() == 10


def test_pruning_drops_unused_columns(spark):
    plan = generate(spark, 100, list(BASE)).select("edad")._jdf.queryExecution().optimizedPlan().toString()
    assert "Bruno" not in plan and len(plan) < 6000


def test_resolution_order():
    # exact, first fuzzy key in order, fallback
    for name, target in {
        " Email ": "email", "correo_personal": "email", "templo": "empresa", "motel": "telefono", "filename": "nombre", "page": "edad",
        "fecha_alta": "fecha", "descuento": "descripcion", "columna_que_no_existe": "palabra",
    }.items():
        assert resolve_name(name) == target
    assert resolve("puesto_actual") == BASE["cargo"]


def test_resolve_frame_agrees_with_the_plan_time_resolver(spark):
    names = [" Email ", "correo_x", "templo", "motel", "nada", "Edad", "address2", "ñandú"]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    for catalogue in (BASE, catalogue_frame(spark)):
        rows = resolve_frame(frame, catalogue).collect()
        assert {r["name"]: r["provider"] for r in rows} == {n: resolve_name(n) for n in names}
    assert "BroadcastHashJoin" in resolve_frame(frame, BASE)._jdf.queryExecution().executedPlan().toString()


def test_provider_texts():
    cases = {
        "lambda: random.choice(['A', \"B\", 3])": Provider("choice", ("A", "B", 3)), "random.randint(1, 5)": Provider("int_uniform", (1, 5)),
        "lambda: random.randint(-10, 45)": Provider("int_uniform", (-10, 45)), "lambda: str(random.randint(1, 9999))": Provider("int_text", (1, 9999)),
        "lambda: round(random.uniform(-90, 90), 6)": Provider("float_uniform", (-90.0, 90.0, 6)), "fake.city": Provider("city"),
        "lambda: fake.word()": Provider("word"), "fake.bothify(text='QR-####')": Provider("template", ("QR-####",)),
        "lambda: random.choice([True, False])": Provider("boolean"), "lambda: int(random.random() * 1e9)": Provider("int_uniform", (0, 999999999)),
        "__import__('os').system('x')": Provider("const", ("__import__('os').system('x')",)), "fake.no_such_method": Provider("const", ("fake.no_such_method",)),
    }
    for text, provider in cases.items():
        assert parse_provider(text) == provider, text


def test_user_dictionary_from_text(spark, tmp_path):
    path = tmp_path / "tema.txt"
    path.write_text(
        "tema = {\n  # comentario\n  \"Nivel\": lambda: random.choice(['Bajo', 'Alto']),  # nota\n  'edad': random.randint(1, 3),\n"
        "  \"folio\": fake.bothify(text='F-##'),\n  \"pais\": \"MX\",\n}\n", encoding="utf-8",
    )
    catalogue = load_catalogue(read_dictionary_text(spark, str(path)))
    assert len(catalogue) == len(BASE) + 2
    rows = generate(spark, 50, ["nivel", "edad", "folio", "pais"], catalogue).collect()
    assert {r["nivel"] for r in rows} == {"Bajo", "Alto"} and {r["edad"] for r in rows} == {1, 2, 3}
    assert all(re.fullmatch(r"F-\d\d", r["folio"]) for r in rows) and {r["pais"] for r in rows} == {"MX"}


def test_all_methods_build(spark):
    catalogue = {m: p for m, p in FAKER_METHODS.items()}
    row = generate(spark, 1, list(catalogue), catalogue).first()
    assert all(v is not None for v in row)
    iban = generate(spark, 20, ["iban"], catalogue).collect()
    assert all(int(r[0][4:] + "2233" + r[0][2:4]) % 97 == 1 for r in iban)


def test_fixed_columns_errors_and_dates(spark):
    rows = generate(spark, 20, ["uuid", "edad"], fixed=["uuid"]).collect()
    assert len({r["uuid"] for r in rows}) == 1 and len({r["edad"] for r in rows}) > 1
    broken = merge({"roto": Provider("int_uniform", (1,))})
    assert generate(spark, 1, ["roto"], broken, on_error="mark").first()[0] == "ERROR_roto"
    with pytest.raises(TypeError):
        generate(spark, 1, ["roto"], broken)
    with pytest.raises(ValueError):
        generate(spark, 1, [])
    start = generate(spark, 100, ["fecha_pasada"], with_id=True)
    gaps = with_offset_date(start, "fecha_pasada", "fin", 1, 30, "row_id").selectExpr("datediff(fin, fecha_pasada) AS d").collect()
    assert all(1 <= r["d"] <= 30 for r in gaps)
    assert isinstance(start.first()["fecha_pasada"], dt.date)


def test_values_by_name_equal_columns(spark):
    """The long form draws the same values as the wide one, for exact, fuzzy and unknown names and nested providers."""
    catalogue = merge({"sede": 'lambda: fake.company() + " (sede)"', "nivel": "lambda: random.choice(['a', 'b'])", "fijo": "x"})
    columns = [*catalogue, "Correo personal", "desconocido", " Edad "]
    ids = spark.range(40).selectExpr("id * 4294967311 AS rid")
    wide = {r["rid"]: r.asDict() for r in generate_over(ids, "rid", columns, catalogue, keep=["rid"]).select("rid", *[F.col(f"`{c}`").cast("string") for c in columns]).collect()}
    names = spark.createDataFrame([(c,) for c in columns], "name string")
    rows = generate_named(ids.crossJoin(names), "rid", "name", catalogue).collect()
    with pytest.raises(ValueError):
        generate_named(ids.crossJoin(names), "rid", "name", {"x": Provider("word")})
    assert len(rows) == 40 * len(columns) and all(wide[r["rid"]][r["name"]] == r["value"] for r in rows)


def test_merged_catalogue_generates(spark, tmp_path):
    """The theme wins by name, in it the last entry, with family and arguments together; nested providers survive the table."""
    assert all(provider_of(p.family, args_text(p)) == p for p in [*BASE.values(), Provider("concat", (Provider("choice", ("a", 2, 1.5)), "-", Provider("company")))])
    entries = [(" Edad", "digits", "[3]", 5), ("edad", "int_uniform", "[1,1]", 9), ("EDAD", "word", "[]", 7), ("nuevo", "const", '["ñ"]', 0)]
    theme = spark.createDataFrame(entries, "name string, family string, args string, ordinal bigint")
    merged = override_frame(catalogue_frame(spark), theme)
    found = providers(merged)
    assert found == {**BASE, "edad": Provider("int_uniform", (1, 1)), "nuevo": Provider("const", ("ñ",))}
    assert {r["name"] for r in merged.where("origin = 'theme'").collect()} == {"edad", "nuevo"}
    assert generate(spark, 2, ["edad", "nuevo"], found).collect() == [(1, "ñ"), (1, "ñ")]
    with pytest.raises(ValueError):
        providers(merged, 3)
    (tmp_path / "a.txt").write_text('"x": "uno",\n"x": "dos",\n', encoding="utf-8")
    (tmp_path / "b.txt").write_text("'x': 'tres'\n", encoding="utf-8")
    assert load_theme(read_dictionary_text(spark, str(tmp_path / "*.txt"))) == {"x": Provider("const", ("tres",))}


def test_dates_count_from_a_given_day(spark):
    columns = ["fecha_futura", "fecha_pasada", "fecha", "fecha_hora"]
    today, later = (generate(spark, 60, columns, as_of=day).collect() for day in (AS_OF, AS_OF + dt.timedelta(days=400)))
    for a, b in zip(today, later, strict=True):
        assert b["fecha_futura"] - a["fecha_futura"] == b["fecha_pasada"] - a["fecha_pasada"] == dt.timedelta(days=400)
        assert 1 <= (b["fecha_futura"] - AS_OF).days - 400 <= 30
    early = generate(spark, 60, ["fecha", "fecha_hora"], as_of=dt.date(1970, 1, 8)).collect()
    assert all("1970-01-01" <= r["fecha"] <= "1970-01-08" and r["fecha_hora"] < dt.datetime(1970, 1, 8) for r in early)
