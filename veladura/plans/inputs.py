"""Inputs of the registered queries: the given tables, and texts built from their rows.

The given tables hold few or no tax ids, forms, API documents or job files, so those
are built row by row from orders, part, supplier and customer. The building
expressions use only SQL that Spark and DuckDB read alike; the oracle builds the
same inputs from the same strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veladura.session import dealt


# Rows of the slim tables that a task turns into pages, notes or exported text.
PAGES_PER_TASK, NOTES_PER_TASK, EXPORTED_PER_TASK = 5_000, 25_000, 50_000


def table(spark: SparkSession, sf_dir: str, name: str, per_task: int | None = None) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"), per_task)


def letter(number: str) -> str:
    return f"chr(cast(65 + ({number}) % 26 as int))"


def padded(number: str, size: int) -> str:
    return f"lpad(cast(({number}) % {10**size} as string), {size}, '0')"


def hexes(key: str, salt: str) -> str:
    return f"md5(concat('{salt}', cast({key} as string)))"


# --- client notes from orders: every kind of personal data, keywords, overlaps, accents ----

K = "o_orderkey"
DAY = f"lpad(cast(1 + {K} % 28 as string), 2, '0')"
MONTH = f"lpad(cast(1 + {K} % 12 as string), 2, '0')"
YEAR2 = padded(f"{K} * 7", 2)
RFC = (
    f"concat({letter(f'{K} * 3')}, {letter(f'{K} * 5 + 1')}, CASE WHEN {K} % 5 = 0 THEN 'Ñ' ELSE {letter(f'{K} + 2')} END, "
    f"CASE WHEN {K} % 3 = 0 THEN '' ELSE {letter(f'{K} * 11')} END, {YEAR2}, {MONTH}, {DAY}, "
    f"{letter(K)}, cast({K} % 10 as string), cast({K} * 3 % 10 as string))"
)
CURP = (
    f"concat({letter(K)}, {letter(f'{K} * 3')}, {letter(f'{K} * 7')}, {letter(f'{K} * 9')}, {YEAR2}, {MONTH}, {DAY}, "
    f"CASE WHEN {K} % 2 = 0 THEN 'H' ELSE 'M' END, 'DF', {letter(f'{K} * 5')}, {letter(f'{K} + 7')}, {letter(f'{K} * 17')}, {padded(K, 2)})"
)
MAIL = (
    f"concat(CASE WHEN {K} % 9 = 0 THEN 'a' WHEN {K} % 9 = 1 THEN 'ab' ELSE concat('cliente.', cast(o_custkey as string)) END, "
    f"'@correo', cast({K} % 5 as string), '.example.com')"
)
PHONE = f"concat('55', {padded(f'{K} * 7919', 8)})"
SPACED_PHONE = f"concat('33 ', {padded(f'{K} * 31', 4)}, '-', {padded(f'{K} * 17', 4)})"
IP = f"concat(cast({K} % 256 as string), '.', cast({K} * 3 % 256 as string), '.', cast({K} % 300 as string), '.1')"
MAC_HEX = hexes(K, "mac")
MAC = "concat(" + ", ':', ".join(f"substr({MAC_HEX}, {1 + 2 * i}, 2)" for i in range(6)) + ")"
UUID_HEX = hexes(K, "uuid")
UUID = (
    f"concat(substr({UUID_HEX}, 1, 8), '-', substr({UUID_HEX}, 9, 4), '-', substr({UUID_HEX}, 13, 4), '-', "
    f"substr({UUID_HEX}, 17, 4), '-', substr({UUID_HEX}, 21, 12))"
)
CARD_SIGN = f"CASE {K} % 3 WHEN 0 THEN '-' WHEN 1 THEN ' ' ELSE '' END"
CARD = f"concat('4111', {CARD_SIGN}, {padded(f'{K} * 13', 4)}, {CARD_SIGN}, {padded(f'{K} * 29', 4)}, {CARD_SIGN}, {padded(K, 4)})"
PLATE = (
    f"CASE WHEN {K} % 2 = 0 THEN concat({letter(K)}, {letter(f'{K} * 3')}, {letter(f'{K} * 5')}, '-', {padded(K, 3)}) "
    f"ELSE concat({padded(K, 3)}, ' ', {letter(K)}, {letter(f'{K} * 3')}, {letter(f'{K} * 5')}) END"
)
BIRTH = f"concat({DAY}, CASE WHEN {K} % 2 = 0 THEN '/' ELSE '-' END, {MONTH}, CASE WHEN {K} % 2 = 0 THEN '/' ELSE '-' END, '19', {YEAR2})"

NOTE = f"""CASE cast({K} % 9 as int)
 WHEN 0 THEN concat('Cliente con RFC: ', {RFC}, ' y CURP ', {CURP}, ' pedido ', o_orderstatus)
 WHEN 1 THEN concat('Escribir al correo ', {MAIL}, ', tel. ', {PHONE}, ' o cel ', {SPACED_PHONE}, chr(10), 'Gracias')
 WHEN 2 THEN concat('Acceso desde ', {IP}, ' equipo ', {MAC})
 WHEN 3 THEN concat('Folio ', {UUID}, ' pagado con ', {CARD}, ' — registro federal ', {RFC})
 WHEN 4 THEN concat('NSS ', {padded(f'{K} * 104729', 11)}, ' placa ', {PLATE}, ' CP ', {padded(f'{K} * 37', 5)})
 WHEN 5 THEN concat('Nació el ', {BIRTH}, ', calle Núm. ', cast({K} % 900 as string), ' a#', cast({K} % 90 as string), ' #', cast({K} % 7 as string))
 WHEN 6 THEN concat('🐍 móvil 1', {padded(f'{K} * 53', 9)}, ' edad: ', cast(18 + {K} % 60 as string), ' lugar ', cast({K} % 90 as string), '.5° ', cast({K} % 180 as string), '.25')
 WHEN 7 THEN concat('Pedido ', o_orderpriority, ' sin datos, señal é', cast({K} as string), 'ñ')
 ELSE concat({RFC}, {letter(K)}, ' ', {MAIL}, '; ', {PHONE}, ' ', {PHONE}, ' ', {CARD}, ' ', {padded(f'{K} * 37', 5)})
END"""

# (table, kind, key, id expression, text expression)
CORPUS = [
    ("documents", "document", "doc_id", "doc_id", "text"),
    ("pages", "page", "page_id", "page_id", "html"),
    ("conversations", "conversation", "conv_id", "conv_id * 1000 + turn", "text"),
    ("orders", "note", "o_orderkey", "o_orderkey", NOTE),
]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all tables that have some: (kind, id, text)."""
    parts = [
        table(spark, sf_dir, name, NOTES_PER_TASK if kind == "note" else None).selectExpr(f"'{kind}' AS kind", f"cast({ident} as bigint) AS id", f"{text} AS text")
        for name, kind, _, ident, text in CORPUS
    ]
    frame = parts[0]
    for part in parts[1:]:
        frame = frame.unionByName(part)
    return frame


CORPUS_SQL = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, cast({ident} as bigint) AS id, {text} AS text FROM {name}" for name, kind, _, ident, text in CORPUS
)


# --- form pages from parts -------------------------------------------------------------------

PART_PAGE = """CASE cast(p_partkey % 7 as int)
 WHEN 0 THEN concat('<html><body><!-- <form><input name="ghost"></form> --><script>var t="<input name=js>";</script><form action="/p/', cast(p_partkey as string),
   '?a=1&amp;b=2" method="post" id="f', cast(p_partkey as string), '" name="alta"><label>Nombre</label><input type="text" name="Nombre " required placeholder="a > b">',
   '<input type="email" name="email" required><input type="number" name="edad" min="18" max="', cast(p_size + 30 as string), '"><select name="pais"><option>M&eacute;xico</option>',
   '<option value="x"> Espa&#241;a </option><option></option></select><textarea name="comentarios">', p_name, ' <b>', p_brand, '</b></textarea>',
   '<button type="submit" name="s">Enviar</button></form></body></html>')
 WHEN 1 THEN concat('<form action=/buscar><input name=q', cast(p_size as string), ' type=search><input type=submit name=go></form><FORM METHOD=Put ID=''f2''>',
   '<input type=radio name=color value=rojo><input type=radio name=color value=azul><input type="checkbox" name="ok"><input type=text name=telefono_casa></FORM>')
 WHEN 2 THEN concat('<p>', p_name, '</p><input name="suelto" type="TEL"><input id="porid"><input><button name="b1">', p_brand, '</button><select id=s1><option>1<option>2 &amp; 3</select>')
 WHEN 3 THEN concat('<p>', p_name, '</p><a href="/parte/', cast(p_partkey as string), '">', p_brand, '</a>')
 WHEN 4 THEN concat('<form id="dup"><input name="edad" type="number" min="200"><input name="EDAD" type="text"><input type="hidden" name="token" value="',
   cast(p_partkey as string), '"><input type=range name=nivel max=10><input type="date" name="alta"><input name="clave" pattern="[A-Z]{3}" value=''x"y''>',
   '<input type="image" name="img"><button name="calc" type="button">Calcular</button><input type="number" name="mal" min="abc" max="7"></form>')
 WHEN 5 THEN concat('<form name="fuera"><input name="uno"><form name="dentro"><input name="dos"></form><input name="tres"></form><form name="abierto"><input name="ultimo" title="',
   p_brand, ' name=falso"><textarea id="notas" required> ', p_name, ' </textarea>')
 ELSE concat('<form action=""><input type="text" name="nombre_completo"><input type="url" name="sitio"><select name="vacio"></select><input type="text" name="email_2"></form>')
END"""
PAGE_SHIFT = 1_000_000
PAGES_SQL = f"SELECT page_id, html FROM pages UNION ALL SELECT {PAGE_SHIFT} + p_partkey AS page_id, {PART_PAGE} AS html FROM part"


def form_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = table(spark, sf_dir, "part", PAGES_PER_TASK).selectExpr(f"{PAGE_SHIFT} + p_partkey AS page_id", f"{PART_PAGE} AS html")
    return table(spark, sf_dir, "pages", PAGES_PER_TASK).select("page_id", "html").unionByName(built)


# --- API documents from suppliers ------------------------------------------------------------

USER_SCHEMA = (
    '{"type":"object","properties":{"nombre":{"type":"string"},"email":{"type":"string","example":"ana@example.com"},'
    '"edad":{"type":"integer"},"activo":{"type":"boolean"},"tipo":{"type":"string","enum":["A","B","C"]},"peso":{"type":"number"},'
    '"nivel":{"enum":[1,2,3,4,5]},"puntos":{"type":"integer","example":7}}}'
)
# Keys that objects repeat: the last value counts, at the place of the first.
REPEATED_SPEC = (
    """concat('{"openapi":"3.0.0","paths":{"/x":{"get":{}}},"openapi":"3.0.', cast(s_nationkey as string), '","paths":{"/b":{"get":{"summary":"uno"}},"/c":{"put":{}},"/b":{"post":{"summary":"', """
    """s_name, '"},"get":{}}},"definitions":{"Doble":{"properties":{"viejo":{}}},"Otro":{},"Doble":{"properties":{"nombre":{"type":"string"},"edad":{"type":"integer"}}}}}')"""
)
CLEAN_SPEC = (
    """concat('{"openapi":"3.0.', cast(s_nationkey as string), '","paths":{"/b":{"post":{"summary":"', s_name, """
    """'"},"get":{}},"/c":{"put":{}}},"definitions":{"Doble":{"properties":{"nombre":{"type":"string"},"edad":{"type":"integer"}}},"Otro":{}}}')"""
)
# More schemas and endpoints than a summary shows.
LARGE_SPEC = (
    "concat('{\"swagger\":\"2.0\",\"host\":\"grande.example.com\",\"paths\":{" + ",".join(f'"/r{i}":{{"get":{{}},"post":{{}}}}' for i in range(6)) + "},\"definitions\":{"
    + ",".join(f'"S{i}":{{"properties":{{' + ",".join(f'"email_{k}":{{"type":"string"}}' for k in range(i)) + "}}" for i in range(9)) + "}}')"
)
SPEC = f"""CASE cast(s_suppkey % 7 as int)
 WHEN 0 THEN concat('{{"openapi":"3.0.0","servers":[{{"url":"https://api', cast(s_suppkey as string), '.example.com/v1"}}],"paths":{{"/usuarios":{{"get":{{"summary":"Lista de ', s_name,
   '"}},"post":{{"summary":"Alta","description":"Crea","parameters":[{{"name":"x"}}],"requestBody":{{"required":true}},"responses":{{"201":{{}}}}}},"parameters":[]}},"/pedidos/{{id}}":{{"DELETE":{{}},"trace":{{}}}}}},',
   '"components":{{"schemas":{{"Usuario":{USER_SCHEMA},"Vacio":{{"type":"object"}}}}}}}}')
 WHEN 1 THEN concat('{{"swagger":"2.0","host":"h', cast(s_suppkey as string), '.example.com","basePath":"/api","paths":{{"/z":{{"get":{{"summary":"Z"}}}},"/a":{{"put":{{}}}}}},',
   '"definitions":{{"Zeta":{USER_SCHEMA},"Alfa":{{"properties":{{"id":{{"type":"integer"}},"c', cast(s_nationkey as string), '":{{"type":"string"}}}}}}}}}}')
 WHEN 2 THEN concat('{{"openapi":"3.1.0","host":"no.example.com","schemes":["http"],"components":{{"schemas":{{"Comun":{{"properties":{{"viejo":{{}}}}}},"Solo":{{"properties":{{"s":{{}}}}}}}}}},',
   '"definitions":{{"Extra":{{}},"Comun":{{"properties":{{"nuevo":{{"type":"string"}},"otro":{{"type":"boolean"}}}}}}}}}}')
 WHEN 3 THEN concat('{{"openapi":"3.0.0","paths":{{"/roto', cast(s_suppkey as string), '":')
 WHEN 4 THEN concat('openapi: 3.0.0', chr(10), 'info: ', s_name)
 WHEN 5 THEN {REPEATED_SPEC}
 ELSE {LARGE_SPEC} END"""
# clean: the same documents without repeated keys.
SPECS_SQL = f"SELECT s_suppkey AS spec_id, {SPEC} AS spec, CASE WHEN s_suppkey % 7 = 5 THEN {CLEAN_SPEC} ELSE {SPEC} END AS clean FROM supplier"


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS spec_id", f"{SPEC} AS spec")


# --- column lists and job configs from parts and customers -------------------------------------

LIST_TEXT = """CASE cast(p_partkey % 4 as int)
 WHEN 0 THEN concat(' Nombre, EMAIL ,,', replace(p_name, ' ', ','), ', ', lower(p_type))
 WHEN 1 THEN concat(p_name, chr(10), ' Edad ', chr(13), chr(10), chr(10), 'ciudad', chr(10), 'Edad')
 WHEN 2 THEN concat('a,b', chr(10), p_brand, chr(10))
 ELSE concat(chr(10), '  ', chr(10)) END"""
LISTS_SQL = f"SELECT p_partkey, {LIST_TEXT} AS content FROM part"


def column_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{LIST_TEXT} AS content")


JOB_TEXT = """CASE cast(c_custkey % 4 as int)
 WHEN 0 THEN concat('{"volumen":', cast(c_custkey + 1 as string), ',"columnas":["nombre","', lower(c_mktsegment), '"],"formato":"csv","motor":"python"}')
 WHEN 1 THEN concat('{"columnas":["email"],"formato":"', lower(c_mktsegment), '"}')
 WHEN 2 THEN '{"volumen":0}'
 ELSE concat('{"volumen":-', cast(c_nationkey as string), ',"columnas":[],"formato":"parquet","motor":"rust"}') END"""
JOBS_SQL = f"SELECT c_custkey, {JOB_TEXT} AS job FROM customer"


def job_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{JOB_TEXT} AS job")
