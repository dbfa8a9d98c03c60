"""Column-name catalogue: which provider makes a column of a given name."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veladura.functions.families import Provider

# The base column names and the ranges and lists behind them.
BASE: dict[str, Provider] = {
    "nombre": Provider("person_name"),
    "nombre_completo": Provider("person_name"),
    "primer_nombre": Provider("first_name"),
    "apellido": Provider("last_name"),
    "email": Provider("email"),
    "telefono": Provider("phone"),
    "direccion": Provider("address"),
    "ciudad": Provider("city"),
    "estado": Provider("state"),
    "pais": Provider("country"),
    "codigo_postal": Provider("postcode"),
    "rfc": Provider("rfc"),
    "curp": Provider("curp"),
    "fecha_nacimiento": Provider("date_between", (-115 * 365, 0)),
    "edad": Provider("int_uniform", (18, 90)),
    "genero": Provider("choice", ("Masculino", "Femenino", "Otro", "Prefiero no decirlo")),
    "estado_civil": Provider("choice", ("Soltero/a", "Casado/a", "Divorciado/a", "Viudo/a", "Unión libre")),
    "empresa": Provider("company"),
    "cargo": Provider("job"),
    "departamento": Provider(
        "choice",
        ("Ventas", "Sistemas", "Recursos Humanos", "Contabilidad", "Marketing", "Operaciones", "Legal"),
    ),
    "salario": Provider("float_uniform", (8000.0, 150000.0, 2)),
    "salario_anual": Provider("float_uniform", (96000.0, 1800000.0, 2)),
    "tarjeta_credito": Provider("card"),
    "clabe": Provider("digits", (18,)),
    "banco": Provider("choice", ("BBVA", "Santander", "Banamex", "Banorte", "Scotiabank", "HSBC")),
    "id": Provider("uuid4"),
    "uuid": Provider("uuid4"),
    "ip": Provider("ipv4"),
    "ipv6": Provider("ipv6"),
    "mac": Provider("mac"),
    "password": Provider("password"),
    "username": Provider("user_name"),
    "user_agent": Provider("user_agent"),
    "url": Provider("url"),
    "dominio": Provider("domain"),
    "fecha": Provider("date_text"),
    "fecha_hora": Provider("datetime_past"),
    "fecha_futura": Provider("date_between", (1, 30)),
    "fecha_pasada": Provider("date_between", (-30, -1)),
    "hora": Provider("time_text"),
    "mes": Provider(
        "choice",
        (
            "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
            "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre",
        ),
    ),
    "dia_semana": Provider("choice", ("Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo")),
    "texto": Provider("text", (4, 6)),
    "oracion": Provider("text", (1, 6)),
    "parrafo": Provider("text", (3, 5)),
    "palabra": Provider("word"),
    "titulo": Provider("text", (1, 6)),
    "descripcion": Provider("text", (3, 5)),
    "entero": Provider("int_uniform", (0, 10000)),
    "decimal": Provider("float_uniform", (0, 1000, 2)),
    "porcentaje": Provider("int_uniform", (0, 100)),
    "booleano": Provider("boolean"),
    "id_caos": Provider("template", ("????-########-????",)),
    "basura": Provider("template", ("???????????????",)),
    "regex": Provider("template", ("???-###-???",)),
}

# Substring keys tried in this order when a name is not in the catalogue.
FUZZY_KEYS: list[tuple[str, str]] = [
    ("correo", "email"),
    ("mail", "email"),
    ("tel", "telefono"),
    ("cel", "telefono"),
    ("fecha", "fecha"),
    ("texto", "texto"),
    ("desc", "descripcion"),
    ("descrip", "descripcion"),
    ("nombre", "nombre"),
    ("name", "nombre"),
    ("edad", "edad"),
    ("age", "edad"),
    ("dir", "direccion"),
    ("address", "direccion"),
    ("emp", "empresa"),
    ("company", "empresa"),
    ("puesto", "cargo"),
    ("job", "cargo"),
]
FALLBACK = "palabra"

# Faker method names a user dictionary may mention, and the family that stands for each.
FAKER_METHODS: dict[str, Provider] = {
    "name": Provider("person_name"),
    "first_name": Provider("first_name"),
    "last_name": Provider("last_name"),
    "email": Provider("email"),
    "company_email": Provider("company_email"),
    "user_name": Provider("user_name"),
    "password": Provider("password"),
    "phone_number": Provider("phone"),
    "address": Provider("address"),
    "street_name": Provider("street"),
    "city": Provider("city"),
    "city_suffix": Provider("city_suffix"),
    "state": Provider("state"),
    "country": Provider("country"),
    "postcode": Provider("postcode"),
    "rfc": Provider("rfc"),
    "curp": Provider("curp"),
    "ssn": Provider("ssn"),
    "date_of_birth": Provider("date_between", (-115 * 365, 0)),
    "date": Provider("date_text"),
    "date_time": Provider("datetime_past"),
    "future_date": Provider("date_between", (1, 30)),
    "past_date": Provider("date_between", (-30, -1)),
    "time": Provider("time_text"),
    "company": Provider("company"),
    "job": Provider("job"),
    "credit_card_number": Provider("card"),
    "credit_card_security_code": Provider("digits", (3,)),
    "iban": Provider("iban"),
    "bban": Provider("digits", (18,)),
    "swift": Provider("swift"),
    "uuid4": Provider("uuid4"),
    "md5": Provider("token", (32,)),
    "sha1": Provider("token", (40,)),
    "ipv4": Provider("ipv4"),
    "ipv6": Provider("ipv6"),
    "mac_address": Provider("mac"),
    "url": Provider("url"),
    "domain_name": Provider("domain"),
    "user_agent": Provider("user_agent"),
    "color_name": Provider("color"),
    "language_name": Provider("language"),
    "license_plate": Provider("plate"),
    "word": Provider("word"),
    "sentence": Provider("text", (1, 6)),
    "paragraph": Provider("text", (3, 5)),
    "text": Provider("text", (4, 6)),
}

NUMBER = r"[-+]?[0-9]+(?:\.[0-9]+)?"
CHOICE_TEXT = re.compile(r"random\.choice\(\[(.*)\]\)", re.S)
RANDINT_TEXT = re.compile(r"random\.randint\(\s*([-+]?\d+)\s*,\s*([-+]?\d+)\s*\)")
UNIFORM_TEXT = re.compile(rf"round\(\s*random\.uniform\(\s*({NUMBER})\s*,\s*({NUMBER})\s*\)\s*,\s*(\d+)\s*\)")
TEMPLATE_TEXT = re.compile(r"fake\s*\.\s*(bothify|lexify|numerify)\(\s*(?:text\s*=\s*)?(['\"])(.*?)\2\s*\)")
FAKE_TEXT = re.compile(r"fake\s*\.\s*(\w+)\s*(?:\(([^)]*)\))?")


def parse_provider(text: str) -> Provider:
    """Provider from its dictionary text; the text is matched, never evaluated.

    Knows choices, integer and rounded float ranges, templates and Faker method
    names, alone or as the only draw in an expression. Anything else is a constant.
    """
    body = re.sub(r"^lambda\s*:\s*", "", text.strip())
    for rule, make in (
        (re.compile(r"str\(\s*" + RANDINT_TEXT.pattern + r"\s*\)"), lambda m: Provider("int_text", (int(m[1]), int(m[2])))),
        (RANDINT_TEXT, lambda m: Provider("int_uniform", (int(m[1]), int(m[2])))),
        (UNIFORM_TEXT, lambda m: Provider("float_uniform", (float(m[1]), float(m[2]), int(m[3])))),
        (TEMPLATE_TEXT, lambda m: Provider("template", (m[3],))),
    ):
        if m := rule.fullmatch(body):
            return make(m)
    if m := CHOICE_TEXT.fullmatch(body):
        try:
            pool = tuple(ast.literal_eval(f"[{m[1]}]"))
        except (ValueError, SyntaxError):
            return Provider("const", (text,))
        if pool == (0, 1):
            return Provider("boolean", (True,))
        if pool and set(map(type, pool)) == {bool}:
            return Provider("boolean")
        return Provider("choice", pool) if pool else Provider("const", (text,))
    if m := FAKE_TEXT.fullmatch(body):
        return _faker_provider(m[1], m[2] or "", text)
    return _composite(body, text)


def _faker_provider(method: str, arguments: str, text: str) -> Provider:
    if method == "sentence" and (m := re.search(r"(\d+)", arguments)):
        return Provider("text", (1, int(m[1])))
    return FAKER_METHODS.get(method, Provider("const", (text,)))


def _composite(body: str, text: str) -> Provider:
    """A few dictionary idioms that join draws with fixed text."""
    if m := re.fullmatch(r"fake\.word\(\)\.capitalize\(\)(?:\s*\+\s*(['\"])(.*?)\1)?", body):
        return Provider("concat", (Provider("capital_word"), m[2])) if m[2] else Provider("capital_word")
    if m := re.fullmatch(r"fake\.(\w+)\(\)\s*\+\s*(['\"])(.*?)\2", body):
        base = _faker_provider(m[1], "", text)
        return Provider("concat", (base, m[3])) if base.family != "const" else base
    if m := re.fullmatch(r"f(['\"])\{(.*?)\}(.*?)\{(.*?)\}\1", body):
        return Provider("concat", (parse_provider(m[2]), m[3], parse_provider(m[4])))
    if m := re.fullmatch(r"''\.join\(\[str\(random\.randint\(0,\s*9\)\) for _ in range\((\d+)\)\]\)", body):
        return Provider("digits", (int(m[1]),))
    if re.fullmatch(r"(['\"])#\1\s*\+\s*''\.join\(\[random\.choice\('0123456789ABCDEF'\) for _ in range\(6\)\]\)", body):
        return Provider("hex_color")
    if m := re.fullmatch(r"int\(random\.random\(\)\s*\*\s*(1e9|\d+)\)", body):
        return Provider("int_uniform", (0, int(float(m[1])) - 1))
    return Provider("const", (text,))


def as_provider(value: object) -> Provider:
    """Provider from a dictionary entry: a provider, dictionary text, or a plain constant."""
    if isinstance(value, Provider):
        return value
    if isinstance(value, str):
        looks_drawn = "lambda" in value or "random." in value or "fake." in value
        return parse_provider(value) if looks_drawn else Provider("const", (value,))
    if isinstance(value, (int, float, bool)):
        return Provider("const", (value,))
    raise TypeError(f"a catalogue entry must be a Provider, text or a constant, got {type(value).__name__}")


def merge(*themes: Mapping[str, object]) -> dict[str, Provider]:
    """Base catalogue overridden by user dictionaries, later ones first; keys are lower-cased."""
    merged = dict(BASE)
    for theme in themes:
        merged.update({name.strip().lower(): as_provider(value) for name, value in theme.items()})
    return merged


def resolve_name(name: str, catalogue: Mapping[str, Provider] = BASE) -> str:
    """Catalogue name for a requested column: exact, first fuzzy key, or the fallback word."""
    clean = name.lower().strip()
    if clean in catalogue:
        return clean
    return next((target for key, target in FUZZY_KEYS if key in clean), FALLBACK)


def resolve(name: str, catalogue: Mapping[str, Provider] = BASE) -> Provider:
    return catalogue[resolve_name(name, catalogue)]


def fuzzy_target(name: Column) -> Column:
    """First matching substring key as one CASE: no join for eighteen fixed keys."""
    clean = F.lower(F.trim(name))
    rule = F.when(F.contains(clean, F.lit(FUZZY_KEYS[0][0])), F.lit(FUZZY_KEYS[0][1]))
    for key, target in FUZZY_KEYS[1:]:
        rule = rule.when(F.contains(clean, F.lit(key)), F.lit(target))
    return rule


def args_text(provider: Provider) -> str:
    """Arguments as JSON; a provider inside them is an object of its family and arguments."""
    return json.dumps(provider.args, ensure_ascii=False, separators=(",", ":"), default=str) if not any(isinstance(a, Provider) for a in provider.args) else (
        "[" + ",".join(json.dumps({"family": a.family, "args": json.loads(args_text(a))}, ensure_ascii=False, separators=(",", ":")) if isinstance(a, Provider) else json.dumps(a, ensure_ascii=False) for a in provider.args) + "]"
    )


def provider_of(family: str, args: str | None) -> Provider:
    """Provider from a catalogue row."""
    return Provider(family, tuple(provider_of(a["family"], json.dumps(a["args"])) if isinstance(a, dict) else a for a in json.loads(args or "[]")))


def catalogue_frame(spark, catalogue: Mapping[str, Provider] = BASE) -> DataFrame:
    """(name, family, args, ordinal) rows of a catalogue; args are JSON."""
    rows = [(name, p.family, args_text(p), i) for i, (name, p) in enumerate(catalogue.items())]
    return spark.createDataFrame(rows, "name string, family string, args string, ordinal bigint")


# A catalogue given as a dict is part of the plan and may be broadcast up to this many entries.
MAX_BROADCAST_ENTRIES = 20_000


def resolve_frame(names: DataFrame, catalogue: DataFrame | Mapping[str, Provider], name: str = "name") -> DataFrame:
    """Adds ``provider`` and ``how`` (exact, fuzzy, fallback) to a frame of column names.

    The exact lookup is a left equi-join. A dict catalogue has a known size and is broadcast, so the
    names are not shuffled; for a catalogue table the optimizer decides by its size.
    """
    if not isinstance(catalogue, DataFrame):
        keys = sorted({entry.strip().lower() for entry in catalogue})
        entries = names.sparkSession.createDataFrame([(k,) for k in keys], "__entry string")
        return _resolved(names, F.broadcast(entries) if len(keys) <= MAX_BROADCAST_ENTRIES else entries, name)
    return _resolved(names, catalogue.select(F.lower(F.trim("name")).alias("__entry")).distinct(), name)


def _resolved(names: DataFrame, entries: DataFrame, name: str) -> DataFrame:
    keyed = names.withColumn("__name", F.lower(F.trim(F.col(name))))
    joined = keyed.join(entries, keyed["__name"] == entries["__entry"], "left")
    fuzzy = fuzzy_target(F.col("__name"))
    return joined.select(
        *[joined[c] for c in names.columns],
        F.coalesce(F.col("__entry"), fuzzy, F.lit(FALLBACK)).alias("provider"),
        F.when(F.col("__entry").isNotNull(), "exact").when(fuzzy.isNotNull(), "fuzzy").otherwise("fallback").alias("how"),
    )


def override_frame(base: DataFrame, theme: DataFrame) -> DataFrame:
    """Base catalogue table with a theme table over it: the theme wins by name, and in each the last entry by ``ordinal``.

    Families and arguments go together, so the merged table generates: see ``providers``.
    """
    def last(entries: DataFrame, out: str) -> DataFrame:
        named = entries.select(F.lower(F.trim("name")).alias("name"), "family", "args", "ordinal")
        return named.groupBy("name").agg(F.max_by(F.struct("family", "args"), "ordinal").alias(out))

    merged = last(base, "base").join(last(theme, "theme"), "name", "full_outer")
    kept = F.coalesce("theme", "base")
    return merged.select(
        "name", kept["family"].alias("family"), kept["args"].alias("args"),
        F.when(F.col("theme").isNotNull(), "theme").otherwise("base").alias("origin"),
    )


def providers(entries: DataFrame, max_entries: int = MAX_BROADCAST_ENTRIES) -> dict[str, Provider]:
    """A catalogue table as a dict; a larger one than ``max_entries`` is an error, never cut."""
    rows = entries.select("name", "family", "args").limit(max_entries + 1).collect()
    if len(rows) > max_entries:
        raise ValueError(f"a catalogue may have at most {max_entries} entries")
    return {r["name"]: provider_of(r["family"], r["args"]) for r in rows}
