"""Registered queries of generation: families, sources, catalogue and lookups, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veladura.functions import pools
from veladura.functions.draws import DEFAULT_SEED
from veladura.functions.families import Provider
from veladura.operators.catalogue import (
    BASE,
    FALLBACK,
    FUZZY_KEYS,
    args_text,
    catalogue_frame,
    merge,
    override_frame,
    parse_provider,
    providers,
    resolve_frame,
)
from veladura.operators.generate import generate, generate_named, generate_over, with_offset_date
from veladura.plans.gen_oracle import generated, scramble
from veladura.plans.inputs import table
from veladura.plans.oracle import text
from veladura.session import scratch_path
from veladura.sources.dictionary import load_catalogue, read_dictionary_text

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def order_ids(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey")


def family_query(name: str, columns: dict[str, Provider]) -> None:
    """Columns of given providers for every order."""
    QUERIES[name] = lambda spark, sf_dir: generate_over(
        order_ids(spark, sf_dir), "o_orderkey", list(columns), columns, keep=["o_orderkey"]
    )
    ORACLE[name] = generated("SELECT o_orderkey FROM orders", "o_orderkey", columns, ["o_orderkey"])


P = Provider
FAMILY_COLUMNS: dict[str, dict[str, Provider]] = {
    "F01": {"estado_civil": BASE["estado_civil"], "banco": BASE["banco"], "cilindraje": P("choice", (1.0, 1.4, 1.6)), "ram": P("choice", (4, 8, 16))},
    "F02": {"edad": BASE["edad"], "entero": BASE["entero"], "frio": P("int_uniform", (-10, 45)), "numero": P("int_text", (1, 9999)), "segundo": P("int_uniform", (0, 10**9 - 1))},
    "F03": {"salario": BASE["salario"], "latitud": P("float_uniform", (-90, 90, 6)), "grados": P("float_uniform", (-12.5, 48.5, 1))},
    "F04": {"clabe": BASE["clabe"], "corto": P("digits", (4,))},
    "F05": {"id_caos": BASE["id_caos"], "basura": BASE["basura"], "vuelo": P("template", ("ZK-??##",))},
    "F06": {"fijo": P("const", ("ORD-1",)), "uno": P("const", (1,)), "factura": P("template", ("##/????/###",))},
    "F07": {"booleano": BASE["booleano"], "bit": P("boolean", (True,))},
    "F08": {
        "marcador": P("concat", (P("int_uniform", (0, 7)), ":", P("int_uniform", (0, 5)))),
        "sede": P("concat", ("Sede ", P("company"))), "clave": P("concat", ("K", P("capital_word"))),
    },
    "F09": {"color_hex": P("hex_color")},
    "F10": {"uuid": BASE["uuid"]},
    "F11": {"token": P("token", (32,)), "hash": P("token", (40,))},
    "F12": {"ip": BASE["ip"]},
    "F13": {"ipv6": BASE["ipv6"]},
    "F14": {"mac": BASE["mac"]},
    "F15": {"nombre": BASE["nombre"], "primer_nombre": BASE["primer_nombre"], "apellido": BASE["apellido"]},
    "F16": {"email": BASE["email"], "username": BASE["username"], "correo_corporativo": P("company_email")},
    "F17": {"telefono": BASE["telefono"]},
    "F18": {
        "direccion": BASE["direccion"], "ciudad": BASE["ciudad"], "estado": BASE["estado"], "pais": BASE["pais"],
        "codigo_postal": BASE["codigo_postal"], "calle": P("street"), "barrio": P("city_suffix"),
    },
    "F19": {c: BASE[c] for c in ("fecha_nacimiento", "fecha", "fecha_hora", "fecha_futura", "fecha_pasada", "hora")},
    "F20": {c: BASE[c] for c in ("palabra", "oracion", "parrafo", "texto")} | {"cancion": P("text", (1, 3)), "album": P("capital_word")},
    "F21": {"empresa": BASE["empresa"], "cargo": BASE["cargo"]},
    "F22": {"rfc": BASE["rfc"], "curp": BASE["curp"], "ssn": P("ssn")},
    "F23": {"tarjeta": BASE["tarjeta_credito"], "cvv": P("digits", (3,)), "iban": P("iban"), "bban": P("digits", (18,)), "swift": P("swift")},
    "F24": {"url": BASE["url"], "dominio": BASE["dominio"], "user_agent": BASE["user_agent"], "password": BASE["password"]},
    "F25": {"color": P("color"), "lenguaje": P("language"), "placa": P("plate")},
}
for _name, _columns in FAMILY_COLUMNS.items():
    family_query(_name, _columns)


def dates_as_text(name: str, dates: list[str]) -> None:
    """Dates leave the query as ISO text: clients show a DATE in different ways."""
    run, sql = QUERIES[name], ORACLE[name]
    QUERIES[name] = lambda spark, sf_dir: run(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in dates})
    ORACLE[name] = f"SELECT * REPLACE ({', '.join(f'{c}::VARCHAR AS {c}' for c in dates)}) FROM ({sql})"


dates_as_text("F19", ["fecha_nacimiento", "fecha_futura", "fecha_pasada"])

# --- sources --------------------------------------------------------------------------------

PERSON = ["nombre", "email", "edad", "ciudad", "salario", "rfc"]


@register("src_generate", generated("SELECT unnest(range((SELECT count(*) FROM customer))) AS row_id", "row_id", PERSON, ["row_id"]))
def src_generate(spark, sf_dir):
    return generate(spark, table(spark, sf_dir, "customer").count(), PERSON, with_id=True)


@register(
    "src_generate_rows",
    f"""SELECT o_orderkey, fecha_inicio, fecha_inicio + dias AS fecha_fin FROM ({generated(
        "SELECT o_orderkey FROM orders", "o_orderkey",
        {"fecha_inicio": P("date_between", (-365, 0)), "fecha_fin": P("int_uniform", (1, 30))}, ["o_orderkey"])}) AS g(o_orderkey, fecha_inicio, dias)""",
)
def src_generate_rows(spark, sf_dir):
    start = generate_over(
        order_ids(spark, sf_dir), "o_orderkey", ["fecha_inicio"], {"fecha_inicio": P("date_between", (-365, 0))}, keep=["o_orderkey"]
    )
    return with_offset_date(start, "fecha_inicio", "fecha_fin", 1, 30, "o_orderkey")


dates_as_text("src_generate_rows", ["fecha_inicio", "fecha_fin"])


@register(
    "proj_select",
    f"SELECT salario, nombre, edad FROM ({generated('SELECT o_orderkey FROM orders', 'o_orderkey', ['nombre', 'edad', 'salario'])})",
)
def proj_select(spark, sf_dir):
    wide = generate_over(order_ids(spark, sf_dir), "o_orderkey", list(BASE))
    return wide.select("salario", "nombre", "edad")


@register("agg_row_count", "SELECT count(*) AS n FROM orders")
def agg_row_count(spark, sf_dir):
    return generate_over(order_ids(spark, sf_dir), "o_orderkey", PERSON).agg(F.count("*").alias("n"))


# --- catalogue, lookups, extension surface ----------------------------------------------------

# Requested column names: every distinct word of the documents and part names, plus its use as a prefix of "fecha".
NAME_SQL = """SELECT DISTINCT name FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS name FROM documents
  UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part
  UNION ALL SELECT 'Fecha_' || lower(p_type) FROM part UNION ALL SELECT ' ' || lower(c_mktsegment) || '_EMAIL ' FROM customer
  UNION ALL SELECT 'Email ' FROM supplier UNION ALL SELECT ' Edad' FROM supplier)"""
EXACT = ", ".join(f"'{n}'" for n in BASE)
FUZZY = " ".join(f"WHEN contains(clean, '{k}') THEN '{t}'" for k, t in FUZZY_KEYS)


def names(spark, sf_dir) -> DataFrame:
    words = table(spark, sf_dir, "documents").selectExpr("explode(split(replace(text, chr(10), ' '), ' ')) AS name")
    parts = table(spark, sf_dir, "part")
    more = [
        parts.selectExpr("explode(split(p_name, ' ')) AS name"),
        parts.selectExpr("concat('Fecha_', lower(p_type)) AS name"),
        table(spark, sf_dir, "customer").selectExpr("concat(' ', lower(c_mktsegment), '_EMAIL ') AS name"),
        table(spark, sf_dir, "supplier").selectExpr("explode(array('Email ', ' Edad')) AS name"),
    ]
    for m in more:
        words = words.unionByName(m)
    return words.distinct()


@register(
    "join_resolve_provider",
    f"""SELECT name, CASE WHEN clean IN ({EXACT}) THEN clean {FUZZY} ELSE '{FALLBACK}' END AS provider,
    CASE WHEN clean IN ({EXACT}) THEN 'exact' WHEN CASE {FUZZY} END IS NOT NULL THEN 'fuzzy' ELSE 'fallback' END AS how
    FROM (SELECT name, lower(trim(name)) AS clean FROM ({NAME_SQL}))""",
)
def join_resolve_provider(spark, sf_dir):
    return resolve_frame(names(spark, sf_dir), BASE)


# A user catalogue of the words of the part names, with entries that contradict each other, and a base name twice.
THEME_SQL = """SELECT unnest(string_split(p_name, ' ')) AS name, CASE WHEN p_partkey % 2 = 0 THEN 'word' ELSE 'color' END AS family, '[]' AS args, p_partkey AS ordinal FROM part
  UNION ALL SELECT 'Edad', 'digits', '[3]', 1 UNION ALL SELECT ' edad ', 'int_uniform', '[5,9]', 2"""
SAMPLE_ID = 7
THEMED = {**BASE, "edad": Provider("int_uniform", (5, 9))}
DRAWN = scramble(scramble(f"xor({SAMPLE_ID}::BIGINT, ('0x' || substr(md5('{DEFAULT_SEED}|' || name || '|0'), 1, 8))::BIGINT)"))


def _pooled(pool) -> str:
    return f"list_extract([{', '.join(text(p) for p in pool)}], ((({DRAWN}) * {len(pool)}) >> 32)::INT + 1)"


def unpivoted(sql: str, columns, keep) -> str:
    """(keep, name, value) rows of generated columns, values as text."""
    wide = f"SELECT {', '.join(keep)}, {', '.join(f'CAST({chr(34)}{c}{chr(34)} AS VARCHAR) AS {chr(34)}{c}{chr(34)}' for c in columns)} FROM ({sql})"
    return f"SELECT {', '.join(keep)}, name, value FROM (UNPIVOT ({wide}) ON COLUMNS(* EXCLUDE ({', '.join(keep)})) INTO NAME name VALUE value)"


@register(
    "join_override_catalogue",
    f"""WITH b(name, family, args) AS (VALUES {', '.join(f"('{n}', '{p.family}', {text(args_text(p))})" for n, p in BASE.items())}),
    t AS (SELECT lower(trim(name)) AS name, arg_max({{'family': family, 'args': args}}, ordinal) AS e FROM ({THEME_SQL}) GROUP BY ALL),
    m AS (SELECT coalesce(t.name, b.name) AS name, coalesce(t.e.family, b.family) AS family, coalesce(t.e.args, b.args) AS args,
      CASE WHEN t.name IS NULL THEN 'base' ELSE 'theme' END AS origin FROM t FULL JOIN b ON t.name = b.name),
    v AS ({unpivoted(generated(f"SELECT {SAMPLE_ID} AS row_", "row_", list(THEMED), ["row_"], catalogue=THEMED), list(THEMED), ["row_"])})
    SELECT m.*, CASE WHEN origin = 'base' OR m.name = 'edad' THEN v.value WHEN family = 'word' THEN {_pooled(pools.WORDS)} ELSE {_pooled(pools.COLOURS)} END AS sample
    FROM m LEFT JOIN v ON v.name = m.name""".replace("|| name ||", "|| m.name ||"),
)
def join_override_catalogue(spark, sf_dir):
    """The merged table, and a value that each of its entries generates."""
    parts = table(spark, sf_dir, "part")
    theme = parts.selectExpr("explode(split(p_name, ' ')) AS name", "CASE WHEN p_partkey % 2 = 0 THEN 'word' ELSE 'color' END AS family", "'[]' AS args", "p_partkey AS ordinal")
    twice = spark.createDataFrame([("Edad", "digits", "[3]", 1), (" edad ", "int_uniform", "[5,9]", 2)], "name string, family string, args string, ordinal bigint")
    merged = override_frame(catalogue_frame(spark), theme.unionByName(twice))
    path = scratch_path(spark, "catalogue")
    merged.write.parquet(path)
    stored = spark.read.parquet(path)
    return generate_named(stored.withColumn("row_", F.lit(SAMPLE_ID)), "row_", "name", providers(stored), out="sample").drop("row_")


# User dictionaries as files, drawn for every order; of two entries of a name the later file's counts.
USER_TEXTS = {
    "Nivel": "lambda: random.choice(['Básico', 'Medio', 'Alto'])",
    "bit": "lambda: random.choice([0, 1])",
    "piso": "random.randint(2, 41)",
    "altura": "lambda: round(random.uniform(-12.5, 48.5), 1)",
    "serie": "fake.bothify(text='ZK-??##')",
    "medico": "fake.name",
    "lema": "lambda: fake.sentence(nb_words=4)",
    "sede": 'lambda: fake.company() + " (sede)"',
    "marcador": 'lambda: f"{random.randint(0, 7)}:{random.randint(0, 5)}"',
    "origen": "hecho a mano",
}
USER = merge(USER_TEXTS)
USER_COLUMNS = [name.lower() for name in USER_TEXTS]
FIRST_FILE = ["# temas", "GENERABLES = {", '    "piso": "viejo",', "    'medico': fake.city,  # luego otro", "}"]


def user_files(spark) -> str:
    path = scratch_path(spark, "dictionaries")
    second = ["GENERABLES = {", *[f'    "{n}": {text(t) if t == "hecho a mano" else t},' for n, t in USER_TEXTS.items()], "}"]
    for name, lines in (("a", FIRST_FILE), ("b", second)):
        spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(f"{path}/{name}")
    return f"{path}/*/*.txt"


@register("ext_catalogue", generated("SELECT o_orderkey FROM orders", "o_orderkey", [*USER_COLUMNS, "edad"], ["o_orderkey"], catalogue=USER))
def ext_catalogue(spark, sf_dir):
    user = load_catalogue(read_dictionary_text(spark, user_files(spark)))
    return generate_over(order_ids(spark, sf_dir), "o_orderkey", [*USER_COLUMNS, "edad"], user, keep=["o_orderkey"])


@register(
    "ext_provider_text",
    generated("SELECT o_orderkey FROM orders", "o_orderkey", {"elegido": P("choice", ("A", "B", 3)), "entre": P("int_uniform", (5, 9))}, ["o_orderkey"]),
)
def ext_provider_text(spark, sf_dir):
    parsed = {"elegido": parse_provider("lambda: random.choice(['A', 'B', 3])"), "entre": parse_provider("random.randint(5,9)")}
    return generate_over(order_ids(spark, sf_dir), "o_orderkey", list(parsed), parsed, keep=["o_orderkey"])


@register("ext_const", "SELECT o_orderkey, 'MX' AS pais_fijo, 7 AS siete FROM orders")
def ext_const(spark, sf_dir):
    fixed = merge({"pais_fijo": "MX", "siete": 7})
    return generate_over(order_ids(spark, sf_dir), "o_orderkey", ["pais_fijo", "siete"], fixed, keep=["o_orderkey"])


@register("ext_error_value", "SELECT o_orderkey, 'ERROR_roto' AS roto FROM orders")
def ext_error_value(spark, sf_dir):
    broken = merge({"roto": Provider("int_uniform", ("x", "y"))})
    return generate_over(order_ids(spark, sf_dir), "o_orderkey", ["roto"], broken, keep=["o_orderkey"], on_error="mark")


@register(
    "table_to_dataset",
    generated("SELECT c_custkey FROM customer", "c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
)
def table_to_dataset(spark, sf_dir):
    # The columns of an existing table name the generator columns.
    source = table(spark, sf_dir, "customer")
    return generate_over(source.select(F.col("c_custkey").alias("__id")), "__id", source.columns)

