"""Registered queries over jobs, sets, scalars, sinks and streams, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veladura.functions import sqltext
from veladura.functions.sqltext import create_table, literal, measures_of, quoted_ident, sql_type
from veladura.operators import jobs, report
from veladura.operators.numbering import numbered, staged
from veladura.plans.gen_oracle import generated
from veladura.plans.inputs import (
    EXPORTED_PER_TASK,
    CORPUS_SQL,
    JOBS_SQL,
    LISTS_SQL,
    column_texts,
    corpus,
    job_texts,
    table,
)
from veladura.plans.oracle import kept, text
from veladura.plans.pii_queries import masked_sql, partial_sql
from veladura.session import scratch_path
from veladura.sinks import files as sink
from veladura.sinks.sqltext import insert_batches, single_inserts, write_sql
from veladura.sources import files as source
from veladura.sources.jdbc import url_column
from veladura.streaming import streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


# --- column lists and jobs -----------------------------------------------------------------------

CLEAN_LIST = "list_filter(list_transform({x}, lambda n: lower(regexp_replace(n, '^\\s+|\\s+$', '', 'g'))), lambda n: n <> '')"
LINES_SQL = CLEAN_LIST.format(x="regexp_split_to_array(content, '\\r\\n|[\\n\\r]')")
CONTENT_SQL = f"CASE WHEN contains(content, ',') AND NOT contains(content, chr(10)) THEN {CLEAN_LIST.format(x='string_split(content, {c})'.replace('{c}', text(',')))} ELSE {LINES_SQL} END"


def _list_sql(names: str) -> str:
    return f"SELECT p_partkey, (generate_subscripts(names, 1) - 1)::INT AS ordinal, unnest(names) AS name FROM (SELECT p_partkey, {names} AS names FROM ({LISTS_SQL}))"


# Column lists as files: many lists one after another, lines to lines, comma lists on one line.
LIST_FILES = 40


def list_files(spark, sf_dir, kind: str, separator: str) -> str:
    path = scratch_path(spark, "lists")
    rows = column_texts(spark, sf_dir).where(kind).select(F.expr(f"p_partkey % {LIST_FILES}").alias("file"), "p_partkey", "content")
    rows.repartition("file").sortWithinPartitions("file", "p_partkey").drop("p_partkey").write.option("lineSep", separator).partitionBy("file").text(path)
    return f"{path}/*/part-*"


def _files_sql(names: str, kind: str, separator: str) -> str:
    files = f"SELECT p_partkey % {LIST_FILES} AS file, string_agg(content, {separator} ORDER BY p_partkey) || {separator} AS content FROM ({LISTS_SQL}) WHERE {kind} GROUP BY ALL"
    return f"SELECT file, (generate_subscripts(names, 1) - 1)::INT AS ordinal, unnest(names) AS name FROM (SELECT file, {names} AS names FROM ({files}))"


ONE_LINE, LINES = "p_partkey % 4 = 0", "p_partkey % 4 <> 0"


def file_number() -> Column:
    return F.regexp_extract("path", "file=([0-9]+)", 1).cast("bigint").alias("file")


@register("src_spec_txt", _files_sql(LINES_SQL, "true", "chr(10)"))
def src_spec_txt(spark, sf_dir):
    return source.read_column_lines(spark, list_files(spark, sf_dir, "true", "\n")).select(file_number(), "ordinal", "name")


@register("src_spec_csvline", f"SELECT 'comma' AS form, * FROM ({_files_sql(CONTENT_SQL, ONE_LINE, text(','))}) UNION ALL SELECT 'lines', * FROM ({_files_sql(CONTENT_SQL, LINES, 'chr(10)')})")
def src_spec_csvline(spark, sf_dir):
    forms = (("comma", ONE_LINE, ","), ("lines", LINES, "\n"))
    one, other = (source.read_column_files(spark, list_files(spark, sf_dir, kind, separator)).select(F.lit(form).alias("form"), file_number(), "ordinal", "name") for form, kind, separator in forms)
    return one.unionByName(other)


def name_lists(spark, sf_dir) -> DataFrame:
    return jobs.column_list(column_texts(spark, sf_dir), jobs.names_from_content(F.col("content")), ["p_partkey"])


@register(
    "filter_nonblank",
    f"""SELECT p_partkey, count(*) AS names FROM (SELECT p_partkey, unnest(regexp_split_to_array(content, '\\r\\n|[\\n\\r]')) AS name FROM ({LISTS_SQL}))
    WHERE trim(name) <> '' GROUP BY p_partkey""",
)
def filter_nonblank(spark, sf_dir):
    rows = column_texts(spark, sf_dir).select("p_partkey", F.explode(F.split("content", jobs.LINE_BREAK, -1)).alias("name"))
    return rows.where(F.trim("name") != "").groupBy("p_partkey").agg(F.count("*").alias("names"))


@register("agg_duplicate_names", f"SELECT p_partkey, name, count(*) AS n FROM ({_list_sql(CONTENT_SQL)}) GROUP BY ALL HAVING count(*) > 1")
def agg_duplicate_names(spark, sf_dir):
    return jobs.duplicate_names(name_lists(spark, sf_dir), ["p_partkey"])


@register(
    "set_distinct_names",
    f"""SELECT p_partkey, string_agg(name, ',' ORDER BY first_ix) AS names FROM (SELECT p_partkey, name, min(ordinal) AS first_ix
    FROM ({_list_sql(CONTENT_SQL)}) GROUP BY ALL) GROUP BY p_partkey""",
)
def set_distinct_names(spark, sf_dir):
    names = F.array_distinct(jobs.names_from_content(F.col("content")))
    lists = column_texts(spark, sf_dir).select("p_partkey", names.alias("names"))
    return lists.where(F.size("names") > 0).select("p_partkey", F.array_join("names", ",").alias("names"))


JOB_SQL = f"""SELECT c_custkey, coalesce((j->>'volumen')::BIGINT, 1000) AS volumen, coalesce(array_to_string((j->'columnas')::VARCHAR[], ','), '') AS columnas,
  coalesce(j->>'formato', 'excel') AS formato, coalesce(j->>'motor', 'python') AS motor FROM (SELECT c_custkey, job::JSON AS j FROM ({JOBS_SQL}))"""


@register("src_spec_json", f"SELECT NULL::VARCHAR AS problem, volumen, columnas, formato, motor, count(*) AS n FROM ({JOB_SQL}) GROUP BY ALL UNION ALL SELECT 'not a JSON object', 1000, '', 'excel', 'python', 1")
def src_spec_json(spark, sf_dir):
    """Configs written one per line, with a line that is none, and read back."""
    path = scratch_path(spark, "jobs")
    job_texts(spark, sf_dir).select("job").write.text(path)
    spark.createDataFrame([('{"volumen": 5',)], "job string").coalesce(1).write.mode("append").text(path)
    jobs_read = source.read_job_lines(spark, path).withColumn("columnas", F.array_join("columnas", ","))
    return jobs_read.groupBy("problem", "volumen", "columnas", "formato", "motor").agg(F.count("*").alias("n"))


SQL_JOB_TEXT = """concat('{"database":{"type":"', CASE n_nationkey % 3 WHEN 0 THEN 'mysql' WHEN 1 THEN 'postgresql' ELSE 'sqlserver' END, '","database":"', n_name, '"', CASE WHEN n_nationkey % 2 = 0 THEN ',"schema":"ventas"' ELSE '' END,
  '},"query":{', CASE WHEN n_nationkey % 4 = 0 THEN '"sql":"SELECT 1"' ELSE '"table":"t"' END, '}', CASE WHEN n_nationkey % 5 = 0 THEN ',"volumen":25' ELSE '' END, '}')"""


@register(
    "src_spec_sql",
    """SELECT n_nationkey AS file, CASE WHEN n_nationkey % 5 = 0 THEN 25 ELSE 1000 END::BIGINT AS volumen, CASE n_nationkey % 3 WHEN 0 THEN 'mysql' WHEN 1 THEN 'postgresql' ELSE 'sqlserver' END AS connection_type,
    n_name AS database, CASE WHEN n_nationkey % 2 = 0 THEN 'ventas' ELSE 'public' END AS schema, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE 't' END AS table, n_nationkey % 4 = 0 AS query_provided FROM nation""".replace("AS table,", 'AS "table",'),
)
def src_spec_sql(spark, sf_dir):
    """A config file per nation, read as whole files."""
    path = scratch_path(spark, "sqljobs")
    rows = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS file", f"{SQL_JOB_TEXT} AS job")
    rows.repartition("file").write.partitionBy("file").text(path)
    return source.read_sql_job_files(spark, f"{path}/*/part-*").select(file_number(), "volumen", "connection_type", "database", "schema", "table", "query_provided")


REPAIR_SQL = f"""SELECT c_custkey, CASE WHEN volumen > 0 THEN volumen ELSE 100 END AS volumen, CASE WHEN columnas = '' THEN 'nombre,email' ELSE columnas END AS columnas,
  CASE WHEN formato IN ('excel', 'csv', 'json', 'parquet') THEN formato ELSE 'csv' END AS formato FROM ({JOB_SQL})"""


@register("src_spec_dict", REPAIR_SQL)
def src_spec_dict(spark, sf_dir):
    given = jobs.parse_jobs(job_texts(spark, sf_dir), "job", ["c_custkey"])
    return jobs.repair_jobs(given, ["c_custkey"]).withColumn("columnas", F.array_join("columnas", ","))


@register(
    "filter_valid_volume",
    f"""SELECT c_custkey, CASE WHEN volumen > 0 THEN volumen ELSE 1000 END AS volumen, CASE WHEN c_custkey * 1000 > 10000000 THEN 'massive'
    WHEN c_custkey * 1000 > 100000 THEN 'very large' WHEN c_custkey * 1000 > 50000 THEN 'large' ELSE 'normal' END AS size_class FROM ({JOB_SQL})""",
)
def filter_valid_volume(spark, sf_dir):
    given = jobs.parse_jobs(job_texts(spark, sf_dir), "job", ["c_custkey"])
    return given.select(
        "c_custkey", jobs.valid_volume(F.col("volumen")).alias("volumen"),
        jobs.volume_class(F.col("c_custkey") * 1000).alias("size_class"),
    )


@register("fn_default", f"SELECT c_custkey, coalesce((j->>'volumen')::BIGINT, -1) AS volumen, coalesce(j->>'motor', 'none') AS motor, j->>'motor' IS NULL AS missing FROM (SELECT c_custkey, job::JSON AS j FROM ({JOBS_SQL}))")
def fn_default(spark, sf_dir):
    """Defaults for fields that most of the given texts lack."""
    raw = job_texts(spark, sf_dir).select("c_custkey", F.from_json("job", jobs.JOB).alias("j")).select("c_custkey", "j.*")
    return raw.select("c_custkey", F.coalesce("volumen", F.lit(-1)).alias("volumen"), F.coalesce("motor", F.lit("none")).alias("motor"), F.isnull("motor").alias("missing"))


@register(
    "src_jdbc_url",
    """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'jdbc:postgresql://h' || s_nationkey || ':5432/db' WHEN 1 THEN 'jdbc:mysql://localhost:3306/db'
    WHEN 2 THEN 'jdbc:sqlserver://h' || s_nationkey || ':1433;databaseName=db' WHEN 3 THEN 'jdbc:sqlite:datos.db' END AS url FROM supplier""",
)
def src_jdbc_url(spark, sf_dir):
    connections = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey", "element_at(array('postgresql', 'mysql', 'sqlserver', 'sqlite', 'oracle'), cast(s_suppkey % 5 as int) + 1) AS engine",
        "CASE WHEN s_suppkey % 5 <> 1 THEN concat('h', s_nationkey) END AS host",
    )
    none = F.lit(None)
    return connections.select(
        "s_suppkey", url_column(F.col("engine"), F.col("host"), none.cast("int"), F.lit("db"), none.cast("string")).alias("url")
    )


# --- run metrics, made of orders: one run per order ------------------------------------------------

RUN_COLUMNS = [
    "o_orderkey AS run", "o_orderdate AS timestamp", "o_custkey AS volumen", "o_orderstatus AS motor",
    "o_totalprice / 1000 AS tiempo_segundos",
]
RUNS_SQL = f"SELECT {', '.join(RUN_COLUMNS)} FROM orders"


def runs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*RUN_COLUMNS)


def stored_metrics(spark, sf_dir) -> DataFrame:
    """Run metrics written as JSON lines and read back through the metrics source."""
    path = scratch_path(spark, "metrics")
    config = F.struct(F.col("volumen").alias("volumen"), F.array(F.lit("nombre"), F.col("motor")).alias("columnas"), F.lit("csv").alias("formato"))
    runs(spark, sf_dir).select("timestamp", "volumen", "motor", "tiempo_segundos", config.alias("config")).write.json(path)
    return source.read_metric_lines(spark, path)


@register("src_metrics", f"SELECT timestamp, volumen, motor, tiempo_segundos, 'nombre,' || motor AS columnas FROM ({RUNS_SQL})")
def src_metrics(spark, sf_dir):
    return stored_metrics(spark, sf_dir).select(
        "timestamp", "volumen", "motor", "tiempo_segundos", F.array_join("config.columnas", ",").alias("columnas")
    )


METRIC_RUNS = {"F": "csv", "O": "jsonl", "P": "parquet"}


@register(
    "sink_metrics",
    "SELECT count(*) AS volumen, 'spark' AS motor, f.format AS formato, 'o_orderkey,o_custkey' AS columnas, true AS timed FROM orders "
    f"JOIN (VALUES {', '.join(str(x) for x in METRIC_RUNS.items())}) f(status, format) ON o_orderstatus = f.status GROUP BY f.format",
)
def sink_metrics(spark, sf_dir):
    """Three exports, each of which adds the line of its run; rows and seconds are measured while it writes."""
    path = scratch_path(spark, "runs")
    for status, format in METRIC_RUNS.items():
        rows = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).select("o_orderkey", "o_custkey")
        sink.write(rows, format, scratch_path(spark, "run"), metrics=path)
    return source.read_metric_lines(spark, path).select(
        "volumen", "motor", F.col("config.formato").alias("formato"), F.array_join("config.columnas", ",").alias("columnas"), (F.col("tiempo_segundos") > 0).alias("timed")
    )


@register("agg_throughput", f"SELECT motor, round(sum(volumen) / sum(tiempo_segundos), 6) AS rows_per_second FROM ({RUNS_SQL}) GROUP BY motor")
def agg_throughput(spark, sf_dir):
    totals = jobs.session_totals(runs(spark, sf_dir), ["motor"])
    return totals.select("motor", F.round("rows_per_second", 6).alias("rows_per_second"))


@register("agg_session_totals", f"SELECT count(*) AS runs, sum(volumen)::BIGINT AS total_rows, round(sum(tiempo_segundos), 2) AS seconds FROM ({RUNS_SQL})")
def agg_session_totals(spark, sf_dir):
    return jobs.session_totals(runs(spark, sf_dir)).select("runs", "total_rows", F.round("seconds", 2).alias("seconds"))


# --- aggregates and previews over tables -----------------------------------------------------------

WIDE = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@register("agg_max_len", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", max(length({c}::VARCHAR))::INT AS max_len FROM customer" for c in WIDE))
def agg_max_len(spark, sf_dir):
    return report.max_lengths(table(spark, sf_dir, "customer").select(*WIDE))


@register(
    "agg_column_width",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", least(greatest(max(length({c}::VARCHAR)), {len(c)}) + 3, 50)::INT AS width FROM customer" for c in WIDE
    ) + " UNION ALL SELECT 'html', 50 FROM (SELECT 1)",
)
def agg_column_width(spark, sf_dir):
    pages = report.column_widths(table(spark, sf_dir, "pages").select("html"))
    return report.column_widths(table(spark, sf_dir, "customer").select(*WIDE)).unionByName(pages)


@register(
    "topk_preview",
    """SELECT c_mktsegment, place, c_custkey, c_name, c_acctbal, n - 15 AS more FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)::INT AS place,
    greatest(count(*) OVER (PARTITION BY c_mktsegment), 15) AS n FROM customer) WHERE place <= 15""",
)
def topk_preview(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_name", "c_acctbal")
    return report.preview_groups(rows, ["c_mktsegment"], 15, [F.desc("c_acctbal"), "c_custkey"])


# Ids with gaps: full batches must not depend on their values.
SPARSE_ID = "o_orderkey * 1000 + o_orderkey % 7"


@register("win_batch", f"SELECT row_ix // 500 AS batch, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT {SPARSE_ID} AS id, row_number() OVER (ORDER BY {SPARSE_ID}) - 1 AS row_ix FROM orders) GROUP BY ALL")
def win_batch(spark, sf_dir):
    rows = staged(table(spark, sf_dir, "orders").selectExpr(f"{SPARSE_ID} AS id"))
    batches = numbered(rows, "id", range_rows=4_000).groupBy(F.expr("row_ix div 500").alias("batch"))
    return batches.agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


# --- SQL text --------------------------------------------------------------------------------------

# An apostrophe, a null and a truth value per row make the literals worth testing.
LITERAL_COLUMNS = [
    "o_orderkey", "o_orderstatus = 'F' AS cerrado", "CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS total", "o_orderdate",
    "CASE WHEN o_orderkey % 5 <> 0 THEN concat('it''s ', o_orderpriority) END AS nota",
]
LITERAL_SQL = f"SELECT {', '.join(LITERAL_COLUMNS)} FROM orders"


def literal_rows(spark, sf_dir) -> DataFrame:
    # Spark reads '' inside a literal as two literals joined, so the apostrophe is spelled as a character.
    columns = [c.replace("'it''s '", "concat('it', chr(39), 's ')") for c in LITERAL_COLUMNS]
    return table(spark, sf_dir, "orders").selectExpr(*columns)


def _cells(yes: str, no: str) -> list[str]:
    return [
        "o_orderkey::VARCHAR", f"CASE WHEN cerrado THEN '{yes}' ELSE '{no}' END", "coalesce(total::VARCHAR, 'NULL')",
        "'''' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ''''", "coalesce('''' || replace(nota, '''', '''''') || '''', 'NULL')",
    ]


def _row(yes: str, no: str) -> str:
    return "'(' || " + " || ', ' || ".join(_cells(yes, no)) + " || ')'"


def _head(quote: str) -> str:
    names = ", ".join(f"{quote}{c}{quote}" for c in ("o_orderkey", "cerrado", "total", "o_orderdate", "nota"))
    return f"INSERT INTO {quote}pedidos{quote} ({names}) VALUES"


SPARSE_SQL = f"SELECT * REPLACE ({SPARSE_ID} AS o_orderkey) FROM ({LITERAL_SQL})"
BATCHES_SQL = f"""SELECT batch, '{_head("`")}' || chr(10) || string_agg({_row('TRUE', 'FALSE')}, ',' || chr(10) ORDER BY o_orderkey) || ';' AS statement
  FROM (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS batch FROM ({SPARSE_SQL})) GROUP BY batch"""


def sparse_rows(spark, sf_dir) -> DataFrame:
    return literal_rows(spark, sf_dir).withColumn("o_orderkey", F.expr(SPARSE_ID))


@register("win_last_row", f"SELECT batch, right(statement, 2) AS ending, length(statement)::INT AS size FROM ({BATCHES_SQL})")
def win_last_row(spark, sf_dir):
    batches = insert_batches(sparse_rows(spark, sf_dir), "pedidos", row_id="o_orderkey")
    return batches.select("batch", F.right("statement", F.lit(2)).alias("ending"), F.length("statement").alias("size"))


@register("sink_sql_script", f"SELECT trim(line) AS line, count(*) AS n FROM (SELECT unnest(string_split(statement, chr(10))) AS line FROM ({BATCHES_SQL})) GROUP BY ALL")
def sink_sql_script(spark, sf_dir):
    """Script files written and read back line by line."""
    path = scratch_path(spark, "script")
    sink.write(sparse_rows(spark, sf_dir), "sql", path, table="pedidos", row_id="o_orderkey")
    lines = spark.read.text(f"{path}/inserts")
    return lines.groupBy(F.trim("value").alias("line")).agg(F.count("*").alias("n"))


@register(
    "sink_sql_inserts",
    "SELECT '" + _head('"') + " ' || " + _row("1", "0") + f" || ';' AS statement FROM ({LITERAL_SQL})",
)
def sink_sql_inserts(spark, sf_dir):
    return single_inserts(literal_rows(spark, sf_dir), "pedidos", "postgresql")


# All columns of orders, a double that no decimal holds and one with three decimals.
DDL_EXTRA = ["o_orderkey * 1e-20 AS tiny", "o_custkey / 8.0D AS eighths"]
TEXT_TYPE = "'VARCHAR(' || greatest(255, max(length({c})) + 10) || ')'"
PRICE_TYPE = "'DECIMAL(' || greatest(15, max(length(split_part(abs(o_totalprice)::VARCHAR, '.', 1))) + 2) || ',2)'"
EIGHTHS_TYPE = "'DECIMAL(15,' || max(CASE WHEN o_custkey % 8 = 0 THEN 2 WHEN o_custkey % 4 = 0 THEN 2 WHEN o_custkey % 2 = 0 THEN 2 ELSE 3 END) || ')'"
DDL_TYPES = {
    "o_orderkey": "'BIGINT'", "o_custkey": "'BIGINT'", "o_orderstatus": TEXT_TYPE.format(c="o_orderstatus"), "o_totalprice": PRICE_TYPE, "o_orderdate": "'TIMESTAMP'",
    "o_orderpriority": TEXT_TYPE.format(c="o_orderpriority"), "tiny": "'{double}'", "eighths": EIGHTHS_TYPE,
}


def ddl_sql(quote: str = "`", double: str = "DOUBLE") -> str:
    lines = " || ',' || chr(10) || ".join(f"'    {quote}{c}{quote} ' || {t.format(double=double)}" for c, t in DDL_TYPES.items())
    return f"'CREATE TABLE {quote}pedidos{quote} (' || chr(10) || {lines} || chr(10) || ');'"


def ddl_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("*", *DDL_EXTRA).select(*DDL_TYPES)


@register("sink_sql_ddl", f"""SELECT 'mysql' AS dialect, {ddl_sql()} AS statement FROM orders UNION ALL SELECT 'postgresql', {ddl_sql('"', "DOUBLE PRECISION")} FROM orders""")
def sink_sql_ddl(spark, sf_dir):
    rows = ddl_rows(spark, sf_dir)
    one = lambda d: create_table(rows, "pedidos", d).select(F.lit(d).alias("dialect"), "statement")
    return one("mysql").unionByName(one("postgresql"))


RULE = "-- " + "=" * 44


@register(
    "sink_sql_mode",
    f"""SELECT concat_ws(chr(10), '{RULE}', '-- table pedidos for mysql', '-- rows ' || count(*), '{RULE}', {ddl_sql()}) AS statement,
    count(*) AS loaded FROM orders""",
)
def sink_sql_mode(spark, sf_dir):
    """Script mode: both files read back; the rows are counted from the written statements."""
    path = scratch_path(spark, "sqlmode")
    write_sql(ddl_rows(spark, sf_dir), "script", path, "pedidos", row_id="o_orderkey")
    loaded = spark.read.text(f"{path}/inserts").where(F.startswith("value", F.lit("("))).agg(F.count("*").alias("loaded"))
    header = spark.read.text(f"{path}/ddl", wholetext=True).select(F.regexp_replace("value", "\n$", "").alias("statement"))
    return header.join(loaded)


@register("fn_sql_escape", "SELECT o_orderkey, replace(nota, '''', '''''') AS escaped FROM (" + LITERAL_SQL + ") WHERE nota IS NOT NULL")
def fn_sql_escape(spark, sf_dir):
    rows = literal_rows(spark, sf_dir).where("nota IS NOT NULL")
    return rows.select("o_orderkey", sqltext.escape(F.col("nota")).alias("escaped"))


@register(
    "fn_sql_literal",
    "SELECT o_orderkey, " + ", ".join(f"{cell} AS c{i}" for i, cell in enumerate(_cells("TRUE", "FALSE"))) + f" FROM ({LITERAL_SQL})",
)
def fn_sql_literal(spark, sf_dir):
    rows = literal_rows(spark, sf_dir)
    cells = [literal(F.col(f.name), f.dataType).alias(f"c{i}") for i, f in enumerate(rows.schema.fields)]
    return rows.select("o_orderkey", *cells)


ODD_NAME = "concat(c_mktsegment, ' `', cast(c_nationkey as string), '` ', chr(34), 'x', chr(34))"


@register(
    "fn_quote_ident",
    f"""SELECT c_custkey, '`' || replace(name, '`', '``') || '`' AS mysql, '"' || replace(name, '"', '""') || '"' AS postgresql, name AS sqlite
    FROM (SELECT c_custkey, {ODD_NAME} AS name FROM customer)""",
)
def fn_quote_ident(spark, sf_dir):
    names = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{ODD_NAME} AS name")
    return names.select("c_custkey", *[quoted_ident(F.col("name"), d).alias(d) for d in ("mysql", "postgresql", "sqlite")])


@register(
    "fn_sql_type",
    """SELECT doc_id, CASE WHEN n > 1000 THEN 'TEXT' WHEN n > 255 THEN 'VARCHAR(' || least(n, 4000) || ')' ELSE 'VARCHAR(' || greatest(255, n + 10) || ')' END AS sql_type,
    CASE WHEN doc_id % 5 = 0 AND n > 0 THEN 'FLOAT(53)' WHEN n % 2 = 1 AND doc_id % 5 <> 0 THEN 'DECIMAL(15,3)' ELSE 'DECIMAL(15,2)' END AS number_type
    FROM (SELECT doc_id, length(text) AS n FROM documents)""",
)
def fn_sql_type(spark, sf_dir):
    """Types of one-document tables, from the measures of their column of texts and their column of doubles."""
    number = F.when(F.col("doc_id") % 5 == 0, F.length("text") * F.lit(1e-25)).otherwise(F.length("text") / F.lit(8.0))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.struct("text").alias("t"), number.alias("number"))
    profile = docs.groupBy("doc_id").agg(F.max(F.length("t.text")).alias("longest"), *measures_of(docs)[-3:])
    digits = F.struct(*(F.col(f"__2_{k}").alias(k) for k in ("whole", "scale", "plain")))
    return profile.select(
        "doc_id", sql_type(T.StringType(), F.col("longest")).alias("sql_type"), sql_type(T.DoubleType(), digits, "sqlserver").alias("number_type")
    )


# --- other scalars -----------------------------------------------------------------------------------


@register("fn_trim_lower", "SELECT c_custkey, lower(trim('  ' || c_mktsegment || ' ')) AS clean FROM customer")
def fn_trim_lower(spark, sf_dir):
    padded = F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" "))
    return table(spark, sf_dir, "customer").select("c_custkey", F.lower(F.trim(padded)).alias("clean"))


@register("fn_split", "SELECT p_partkey, string_split(p_name, ' ')[1] AS first, split_part(p_brand, '#', 2) AS brand, len(string_split(p_name, ' '))::INT AS words FROM part")
def fn_split(spark, sf_dir):
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(
        "p_partkey", words[0].alias("first"), F.substring_index("p_brand", "#", -1).alias("brand"), F.size(words).alias("words")
    )


@register("fn_contains_ci", "SELECT doc_id, contains(lower(text), lower('RÉ')) AS found FROM documents")
def fn_contains_ci(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.contains(F.lower("text"), F.lower(F.lit("RÉ"))).alias("found"))


@register("fn_regex_all", f"SELECT kind, id, array_to_string(regexp_extract_all(text, '[0-9]+'), ',') AS numbers FROM ({CORPUS_SQL})")
def fn_regex_all(spark, sf_dir):
    numbers = F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    return corpus(spark, sf_dir).select("kind", "id", F.array_join(numbers, ",").alias("numbers"))


PROVIDER_TEXT = "concat('lambda: random.randint(', cast(p_size as string), ', ', cast(p_size + p_partkey as string), ')')"


@register(
    "fn_regex_group",
    f"SELECT p_partkey, regexp_extract(t, '\\(([0-9]+),\\s*([0-9]+)\\)', 1)::INT AS low, regexp_extract(t, '\\(([0-9]+),\\s*([0-9]+)\\)', 2)::INT AS high FROM (SELECT p_partkey, {PROVIDER_TEXT} AS t FROM part)",
)
def fn_regex_group(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{PROVIDER_TEXT} AS t")
    pattern = r"\(([0-9]+),\s*([0-9]+)\)"
    return rows.select("p_partkey", *[F.regexp_extract("t", pattern, i).cast("int").alias(n) for i, n in ((1, "low"), (2, "high"))])


@register("fn_parse_list", "SELECT p_partkey, string_split(p_name, ' ')[1] AS first, len(string_split(p_name, ' '))::INT AS n FROM part")
def fn_parse_list(spark, sf_dir):
    listed = F.concat(F.lit("["), F.regexp_replace("p_name", "([a-z]+)", '"$1"'), F.lit("]"))
    values = F.from_json(F.replace(listed, F.lit(" "), F.lit(",")), "array<string>")
    return table(spark, sf_dir, "part").select("p_partkey", values[0].alias("first"), F.size(values).alias("n"))


@register("fn_thousands", "SELECT o_orderkey, format('{:,}', o_orderkey * 1000) AS shown FROM orders")
def fn_thousands(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.format_number(F.col("o_orderkey") * 1000, 0).alias("shown"))


@register("fn_timestamp_fmt", "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM events")
def fn_timestamp_fmt(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("shown")
    )


@register("fn_round", "SELECT o_orderkey, round(o_totalprice, 1) AS one, round(o_totalprice / 3, 6) AS six FROM orders")
def fn_round(spark, sf_dir):
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(price, 1).alias("one"), F.round(price / 3, 6).alias("six"))


for _name, _sql, _fn in (
    ("fn_sha256", "sha256(c_name)", lambda c: F.sha2(c, 256)), ("fn_md5", "md5(c_name)", F.md5), ("fn_sha1", "sha1(c_name)", F.sha1),
    ("fn_concat", "c_name || '/' || c_mktsegment", lambda c: F.concat(c, F.lit("/"), F.col("c_mktsegment"))),
    ("fn_capitalize", "upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2))", lambda c: F.initcap("c_mktsegment")),
    ("fn_upper", "upper(c_name)", F.upper),
):
    QUERIES[_name] = lambda spark, sf_dir, fn=_fn: table(spark, sf_dir, "customer").select("c_custkey", fn(F.col("c_name")).alias("value"))
    ORACLE[_name] = f"SELECT c_custkey, {_sql} AS value FROM customer"

JSON_ROW = """'{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"' || c_mktsegment || 'ñ"' END || '}'"""


def json_rows(spark, sf_dir) -> DataFrame:
    return json_rows_of(table(spark, sf_dir, "customer"))


def json_rows_of(customers: DataFrame) -> DataFrame:
    return customers.selectExpr("c_custkey", "c_name", "CASE WHEN c_custkey % 3 <> 0 THEN concat(c_mktsegment, 'ñ') END AS c_mktsegment")


@register("fn_json_record", f"SELECT {JSON_ROW} AS record FROM customer")
def fn_json_record(spark, sf_dir):
    return json_rows(spark, sf_dir).select(sink.json_record().alias("record"))


# --- sinks: written to the scratch folder, read back, compared with the source -------------------------

SINK_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
# What text formats may spoil: ids beyond 2^53 and sparse, doubles below any decimal, microseconds.
SINK_BIG, SINK_TINY = "4611686018427387904 + c_custkey * 1000003 AS big_id", "c_custkey * 1e-20 AS tiny"
SINK_SQL = (
    f"SELECT {', '.join(SINK_COLUMNS)}, {SINK_BIG}, {SINK_TINY}, TIMESTAMP '2001-02-03 04:05:06' + to_microseconds((c_custkey % 3) * c_custkey * 123) AS seen_at FROM customer"
)


def sink_rows(spark, sf_dir) -> DataFrame:
    seen = "TIMESTAMP_NTZ '2001-02-03 04:05:06' + make_dt_interval(0, 0, 0, (c_custkey % 3) * c_custkey * 0.000123) AS seen_at"
    return table(spark, sf_dir, "customer", EXPORTED_PER_TASK).selectExpr(*SINK_COLUMNS, SINK_BIG, SINK_TINY, seen)


def _round_trip(name: str, format: str, read):
    def run(spark, sf_dir):
        rows, path = sink_rows(spark, sf_dir), scratch_path(spark, name)
        sink.write(rows, format, path)
        return read(spark, path, rows.schema)

    QUERIES[name], ORACLE[name] = run, SINK_SQL


_round_trip("sink_csv", "csv", lambda spark, path, schema: sink.read_csv(spark, path, schema))
_round_trip("sink_csv_semicolon", "excel", lambda spark, path, schema: sink.read_csv(spark, path, schema, ";"))
_round_trip("sink_jsonl", "jsonl", lambda spark, path, schema: spark.read.schema(schema).json(path))
_round_trip("sink_parquet", "parquet", lambda spark, path, schema: spark.read.parquet(path))
_round_trip("sink_xml", "xml", lambda spark, path, schema: spark.read.schema(schema).options(rowTag="row", **sink.TIME_OPTIONS).xml(path))


@register("sink_object_store", SINK_SQL)
def sink_object_store(spark, sf_dir):
    """Keys under one prefix per value, as object stores lay them out; any path Spark can write will do, the scratch folder
    stands for it. All prefixes are read back; the column itself stays in the files, as prefixes tell no empty text from null."""
    rows, path = sink_rows(spark, sf_dir), scratch_path(spark, "objects")
    sink.write(rows.withColumn("prefix", F.col("c_mktsegment")), "parquet", path, partition_by=["prefix"])
    return spark.read.parquet(path).select(*rows.columns)


@register("sink_dispatch", "SELECT format, count(*) AS n FROM customer, (VALUES ('csv'), ('json'), ('parquet')) f(format) GROUP BY format")
def sink_dispatch(spark, sf_dir):
    rows, found = sink_rows(spark, sf_dir), []
    for format in ("csv", "json", "parquet"):
        path = scratch_path(spark, f"dispatch-{format}")
        sink.write(rows, format, path)
        back = sink.read_csv(spark, path, rows.schema) if format == "csv" else spark.read.schema(rows.schema).format(format).load(path)
        found.append(back.select(F.lit(format).alias("format")))
    return found[0].unionByName(found[1]).unionByName(found[2]).groupBy("format").agg(F.count("*").alias("n"))


@register(
    "sink_json_array",
    f"SELECT batch, '[' || chr(10) || string_agg('  ' || record, ',' || chr(10) ORDER BY c_custkey) || chr(10) || ']' AS records "
    f"FROM (SELECT c_custkey, {JSON_ROW} AS record, (row_number() OVER (ORDER BY c_custkey) - 1) // 1000 AS batch FROM (SELECT * REPLACE (c_custkey * 1013 AS c_custkey) FROM customer)) GROUP BY batch",
)
def sink_json_array(spark, sf_dir):
    sparse = table(spark, sf_dir, "customer").withColumn("c_custkey", F.col("c_custkey") * 1013)
    return sink.json_arrays(json_rows_of(sparse), "c_custkey", 1000)


@register(
    "sink_metadata",
    """SELECT 'written_at' AS property, 'true' AS value UNION ALL SELECT 'rows', count(*)::VARCHAR FROM customer
    UNION ALL SELECT 'columns', '8' UNION ALL SELECT 'engine', 'spark' UNION ALL SELECT 'seconds', 'true'""",
)
def sink_metadata(spark, sf_dir):
    """The sheet next to an export, read back; of the time and the seconds it tells that they are such."""
    path = scratch_path(spark, "metadata")
    sink.write(sink_rows(spark, sf_dir), "csv", scratch_path(spark, "exported"), metadata=path)
    sheet = spark.read.csv(path, header=True)
    told = F.when(F.col("property") == "written_at", (F.col("value").try_cast("timestamp") <= F.current_timestamp()).cast("string"))
    told = told.when(F.col("property") == "seconds", (F.col("value").try_cast("double") > 0).cast("string"))
    return sheet.select("property", told.otherwise(F.col("value")).alias("value"))


@register("sink_spec", JOB_SQL)
def sink_spec(spark, sf_dir):
    """Job configs saved as JSON and read back."""
    path = scratch_path(spark, "specs")
    sink.write_specs(jobs.parse_jobs(job_texts(spark, sf_dir), "job", ["c_custkey"]), path)
    saved = spark.read.schema(source.schema_of("struct<c_custkey:bigint," + jobs.JOB.removeprefix("struct<"))).json(path)
    return jobs.with_defaults(saved, ["c_custkey"]).withColumn("columnas", F.array_join("columnas", ","))


# --- streams: run over the given files until nothing is left ---------------------------------------------


@register(
    "stream_generate",
    generated("SELECT event_id FROM events", "event_id", ["nombre", "edad", "ip"], ["event_id"]),
)
def stream_generate(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    rows = streams.read_table_stream(spark, sf_dir, "events", schema)
    path = scratch_path(spark, "stream-generate")
    streams.run_to_files(streams.stream_generate(rows, "event_id", ["nombre", "edad", "ip"], ["event_id"]), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out")


@register("stream_mask", f"SELECT id, masked FROM ({masked_sql(partial_sql(), 'SELECT 0 AS kind, doc_id AS id, text FROM documents')})")
def stream_mask(spark, sf_dir):
    schema = table(spark, sf_dir, "documents").schema
    docs = streams.read_table_stream(spark, sf_dir, "documents", schema).select(F.col("doc_id").alias("id"), "text")
    path = scratch_path(spark, "stream-mask")
    streams.run_to_files(streams.stream_mask(docs, "text").withColumnRenamed("text", "masked"), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out")


EVENT_TEXT = "concat('ip 10.0.', cast(user_id % 256 as string), '.', cast(event_id % 256 as string), CASE WHEN event_type = 'click' THEN concat(' cliente', cast(user_id as string), '@example.com') ELSE '' END)"


@register(
    "stream_pii_counts",
    f"""WITH {kept(f"SELECT 0 AS kind, event_id AS id, {EVENT_TEXT} AS text FROM events")}
    SELECT time_bucket(INTERVAL 1 day, ts) AS day, type, count(*) AS n FROM hits JOIN events ON event_id = id GROUP BY ALL""",
)
def stream_pii_counts(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    events = streams.read_table_stream(spark, sf_dir, "events", schema)
    texts = events.selectExpr(f"{EVENT_TEXT} AS text", "cast(ts as timestamp) AS ts")
    counts = streams.stream_pii_counts(texts, "text", "ts", window="1 day", delay="40 days")
    path = scratch_path(spark, "stream-counts")
    flat = counts.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "type", "n")
    streams.run_keyed(flat, f"{path}/out", f"{path}/state", ["day", "type"])
    return streams.keyed_state(spark, f"{path}/out", ["day", "type"])

