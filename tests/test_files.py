from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veladura.functions.jsontext import is_object
from veladura.functions.sqltext import create_table, plain_number
from veladura.operators.numbering import numbered, staged
from veladura.operators.generate import generate
from veladura.plans import inputs, table_queries
from veladura.plans.table_queries import sink_object_store, sink_rows
from veladura.session import scratch_path
from veladura.sinks import files as sink
from veladura.sinks.sqltext import insert_batches, single_inserts, write_sql
from veladura.sources import files as source
from veladura.sources import jdbc


def test_column_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" Nombre\r\n\nEMAIL \nnombre", encoding="utf-8")
    (tmp_path / "b.txt").write_text("a, B,,c ", encoding="utf-8")
    (tmp_path / "c.txt").write_text(" \n", encoding="utf-8")
    rows = source.read_column_files(spark, str(tmp_path / "*.txt")).orderBy("path", "ordinal").collect()
    found = {}
    for r in rows:
        found.setdefault(Path(r["path"]).name, []).append(r["name"])
    assert found == {"a.txt": ["nombre", "email", "nombre"], "b.txt": ["a", "b", "c"]}
    (tmp_path / "d.txt").write_bytes("a\u00f1o".encode("latin-1"))
    (tmp_path / "e.txt").write_bytes(b"a,b\r")
    rejected = source.rejected_column_files(spark, str(tmp_path / "*.txt")).collect()
    assert sorted((Path(r["path"]).name, r["problem"]) for r in rejected) == [("c.txt", "no names"), ("d.txt", "not UTF-8")]
    assert [r["name"] for r in source.read_column_files(spark, str(tmp_path / "e.txt")).collect()] == ["a,b"]
    assert [r["name"] for r in source.read_column_lines(spark, str(tmp_path / "b.txt")).collect()] == ["a, b,,c"]


def test_job_and_metric_files(spark, tmp_path):
    (tmp_path / "job.json").write_text(json.dumps({"volumen": 500, "columnas": ["nombre"]}, indent=1), encoding="utf-8")
    job = source.read_job_files(spark, str(tmp_path / "job.json")).first()
    assert (job["volumen"], job["columnas"], job["formato"], job["motor"]) == (500, ["nombre"], "excel", "python")
    (tmp_path / "bad.json").write_text('{"volumen": 5', encoding="utf-8")
    assert source.read_job_files(spark, str(tmp_path / "*.json")).count() == 1
    assert [(Path(r["path"]).name, r["problem"]) for r in source.rejected_files(spark, str(tmp_path / "*.json"), is_object).collect()] == [("bad.json", "not a JSON object")]
    (tmp_path / "lines.jsonl").write_text('{"volumen":7}\n\n[1]\n', encoding="utf-8")
    assert sorted((r["volumen"], r["problem"]) for r in source.read_job_lines(spark, str(tmp_path / "lines.jsonl")).collect()) == [(7, None), (1000, "not a JSON object")]
    (tmp_path / "sql.json").write_text(json.dumps({"database": {"database": "d"}, "query": {"table": "t"}}), encoding="utf-8")
    sql = source.read_sql_job_files(spark, str(tmp_path / "sql.json")).first()
    assert (sql["volumen"], sql["connection_type"], sql["database"], sql["schema"], sql["table"], sql["query_provided"]) == (1000, "postgresql", "d", "public", "t", False)
    for n in (10, 20):
        sink.write_metrics(spark, str(tmp_path / "m"), n, "spark", 1.5, {"volumen": n, "columnas": ["a"], "_metadata": {"fuente": "x"}})
    rows = source.read_metric_lines(spark, str(tmp_path / "m")).orderBy("volumen").collect()
    assert [r["volumen"] for r in rows] == [10, 20] and rows[0]["config"]["_metadata"]["fuente"] == "x"


def test_sparse_ids_fill_batches(spark):
    """A thousand ids with gaps of a thousand are two statements of 500, in id order, for one range and for many."""
    rows = spark.range(1000).selectExpr("id * 1000 + 5 AS id", "cast(id as string) AS t").repartition(7)
    listed = sorted(insert_batches(rows, "t", row_id="id").collect(), key=lambda b: b["batch"])
    assert [b["statement"].count("\n(") for b in listed] == [500, 500]
    ids = [int(line.split(",")[0].strip("(")) for b in listed for line in b["statement"].split("\n")[1:]]
    assert ids == [i * 1000 + 5 for i in range(1000)]
    assert sorted(b["statement"].count("\n(") for b in insert_batches(rows, "t").collect()) == [500, 500]


@pytest.mark.parametrize("range_rows", [10, 64, 10**6])
def test_numbers_without_gaps(spark, range_rows):
    ids = [None, None, *range(-300, 300, 7), 5, 5, 2**60, -(2**60)]
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(5)
    got = sorted((r["row_ix"], r["id"]) for r in numbered(staged(rows), "id", range_rows).collect())
    assert [ix for ix, _ in got] == list(range(len(ids))) and [i for _, i in got] == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert sorted(r["row_ix"] for r in numbered(staged(rows)).collect()) == list(range(len(ids)))
    assert numbered(staged(rows.where("1 = 0")), "id").count() == 0
    times = rows.selectExpr("timestamp_seconds(id % 1000) AS at").where("at IS NOT NULL")
    assert [r["at"] for r in numbered(staged(times), "at", range_rows).orderBy("row_ix").collect()] == sorted(r["at"] for r in times.collect())


def test_types_hold_every_double(spark):
    def ddl(values, dialect="mysql"):
        return create_table(spark.createDataFrame([(v,) for v in values], "x double"), "t", dialect).first()[0].split("`x` " if dialect == "mysql" else '"x" ')[1].split("\n")[0]

    assert ddl([1.5, -22.25, None]) == "DECIMAL(15,2)" and ddl([]) == "DECIMAL(15,2)" and ddl([None]) == "DECIMAL(15,2)"
    assert ddl([0.125, 3.0]) == "DECIMAL(15,3)" and ddl([123456789012345.0, 0.5]) == "DECIMAL(17,2)" and ddl([1e18, 0.5]) == "DECIMAL(21,2)"
    assert ddl([1e-20]) == "DOUBLE" and ddl([1e300, 1.0], "postgresql") == "DOUBLE PRECISION" and ddl([float("nan"), 2.5]) == "DECIMAL(15,2)"
    assert ddl([0.000001]) == "DECIMAL(15,6)"


def test_exports_compute_the_frame_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    rows = spark.range(1200).selectExpr("id", "concat('t', id) AS t", "id / 8.0D AS x").repartition(3).mapInArrow(seen, "id bigint, t string, x double")
    run = sink.write(rows, "sql", str(tmp_path / "s"), table="t", row_id="id", metadata=str(tmp_path / "m"), metrics=str(tmp_path / "r"))
    assert calls.value == 1200 and (run.rows, run.columns) == (1200, 3) and run.seconds > 0
    ddl = spark.read.text(str(tmp_path / "s/ddl"), wholetext=True).first()[0]
    assert "-- rows 1200" in ddl and "`x` DECIMAL(15,3)" in ddl and "`t` VARCHAR(255)" in ddl
    assert spark.read.text(str(tmp_path / "s/inserts")).where("value LIKE '(%'").count() == 1200
    sheet = {r["property"]: r["value"] for r in spark.read.csv(str(tmp_path / "m"), header=True).collect()}
    assert (sheet["rows"], sheet["columns"], sheet["engine"]) == ("1200", "3", "spark") and float(sheet["seconds"]) > 0
    line = source.read_metric_lines(spark, str(tmp_path / "r")).first()
    assert line["volumen"] == 1200 and line["config"]["columnas"] == ["id", "t", "x"] and line["config"]["formato"] == "sql" and line["tiempo_segundos"] > 0
    for format in ("csv", "jsonl", "parquet", "json_array"):
        before = calls.value
        assert sink.write(rows, format, str(tmp_path / format)).rows == 1200 and calls.value - before == 1200


def test_pages_and_specs_are_whole_files(spark, tmp_path):
    (tmp_path / "p.html").write_text("<form>\n<input name=x>\n</form>", encoding="utf-8")
    row = source.read_pages(spark, str(tmp_path / "p.html")).first()
    assert row["html"].count("\n") == 2 and row["path"].endswith("p.html")


def sample(spark):
    return spark.createDataFrame(
        [(1, "uno; \"dos\", ñ", 12345678.5, True, None), (2, " borde ", 0.5, False, "it's"), (3, "salto\nlínea", None, None, "")],
        "id int, texto string, n double, b boolean, nota string",
    )


def test_csv(spark, tmp_path):
    sink.write(sample(spark).coalesce(1), "csv", str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_bytes().decode("utf-8")
    assert text.startswith("﻿id,texto,n,b,nota\n") and '"uno; ""dos"", ñ",12345678.5,True,' in text and ", borde ,0.5,False," in text
    back = sink.read_csv(spark, str(tmp_path / "csv"), "id int, texto string, n double, b boolean, nota string").orderBy("id").collect()
    assert [tuple(r)[:4] for r in back] == [tuple(r)[:4] for r in sample(spark).orderBy("id").collect()]


def test_json_formats(spark, tmp_path):
    sink.write(sample(spark), "jsonl", str(tmp_path / "j"))
    lines = [json.loads(x) for p in (tmp_path / "j").glob("part-*") for x in p.read_text(encoding="utf-8").splitlines()]
    assert sorted(x["id"] for x in lines) == [1, 2, 3] and all("nota" in x for x in lines)
    arrays = sink.json_arrays(generate(spark, 25, ["edad"], with_id=True), "row_id", 10).orderBy("batch").collect()
    assert [len(json.loads(r["records"])) for r in arrays] == [10, 10, 5]


def test_slim_tables_are_dealt_by_rows(spark, tmp_path):
    """One file of one row group gives tasks of about so many rows, and the same rows; few rows stay where they are."""
    spark.range(12_001).selectExpr("if(id = 0, null, id) AS k", "'x' AS v").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    rows = inputs.table(spark, str(tmp_path), "t", 1000)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 13 and max(sizes) < 1000
    whole = inputs.table(spark, str(tmp_path), "t")
    assert whole.exceptAll(rows).count() == rows.exceptAll(whole).count() == 0
    assert inputs.table(spark, str(tmp_path), "t", 20_000).rdd.getNumPartitions() == whole.rdd.getNumPartitions()


def test_queries_deal_their_slim_tables(spark, tmp_path, monkeypatch):
    """Pages made of parts and exported customers: a task gets a bounded number of rows, whatever the file."""
    monkeypatch.setattr(inputs, "PAGES_PER_TASK", 50)
    monkeypatch.setattr(table_queries, "EXPORTED_PER_TASK", 50)
    spark.range(400).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "1 AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, "<input name=a>")], "page_id bigint, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.range(400).selectExpr("id AS c_custkey", "'n' AS c_name", "1 AS c_nationkey", "1.5D AS c_acctbal", "'m' AS c_mktsegment").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    for frame, n in ((inputs.form_pages(spark, str(tmp_path)), 401), (sink_rows(spark, str(tmp_path)), 400)):
        sizes = [r["count"] for r in frame.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == n and max(sizes) <= 60


def test_object_store_gives_every_row_back(spark, tmp_path):
    """All prefixes, with texts that look like numbers, empty ones and nulls."""
    rows = [(i, f"c{i}", i % 3, i * 1.5, m) for i, m in enumerate(["A", "B", "7", "", None, "B", "A"])]
    spark.createDataFrame(rows, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    found = sink_object_store(spark, str(tmp_path)).orderBy("c_custkey")
    assert [tuple(r)[:5] for r in found.collect()] == rows and found.columns == sink_rows(spark, str(tmp_path)).columns


def test_unknown_or_empty_exports_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        sink.write(sample(spark), "docx", str(tmp_path / "x"))
    with pytest.raises(ValueError):
        sink.write(sample(spark).select(), "csv", str(tmp_path / "x"))
    with pytest.raises(ValueError):
        write_sql(sample(spark), "live")


def test_sql_statements(spark):
    rows = sorted(r[0] for r in single_inserts(sample(spark), "t", "mysql").collect())
    assert rows[1] == "INSERT INTO `t` (`id`, `texto`, `n`, `b`, `nota`) VALUES (2, ' borde ', 0.5, 0, 'it''s');"
    assert "12345678.5, 1, NULL);" in rows[0] and "NULL, NULL, '');" in rows[2]
    for row_id in ("row_id", None):
        batches = insert_batches(generate(spark, 1234, ["edad"], with_id=True), "t", row_id=row_id).collect()
        assert sum(b["statement"].count("\n(") for b in batches) == 1234
        assert all(b["statement"].count("\n(") <= 500 and b["statement"].endswith(");") for b in batches)


def test_plain_numbers(spark):
    df = spark.createDataFrame([(1e7,), (1.5e10,), (0.1,), (1e-4,), (-2.5e8,), (1e300,)], "x double")
    assert [r[0] for r in df.select(plain_number(df["x"])).collect()] == ["10000000.0", "15000000000.0", "0.1", "0.0001", "-250000000.0", "1.0E300"]


def test_jdbc_options(monkeypatch):
    monkeypatch.setenv("MYSQL_HOST", "db1")
    monkeypatch.setenv("MYSQL_USER", "u")
    assert jdbc.options({"db_type": "mysql", "database": "d"}) == {"url": "jdbc:mysql://db1:3306/d", "user": "u"}
    assert jdbc.options({"db_type": "mysql", "database": "d", "use_env_vars": False})["url"] == "jdbc:mysql://localhost:3306/d"
    assert jdbc.options({"db_type": "sqlserver", "host": "h", "database": "d"})["url"] == "jdbc:sqlserver://h:1433;databaseName=d"
    assert jdbc.options({"db_type": "sqlite", "sqlite_path": "x.db"})["url"] == "jdbc:sqlite:x.db"
    assert "table_schema = 'shop'" in jdbc.table_list_query({"db_type": "mysql", "database": "shop"})
    by = jdbc.query_options({"db_type": "mysql", "database": "d", "query": "SELECT 1 AS a;"}, partitionColumn="a", numPartitions="4")
    assert by["dbtable"] == "(SELECT 1 AS a) AS q" and by["numPartitions"] == "4" and "query" not in by
    assert "table_schema = 'o''x'" in jdbc.table_list_query({"db_type": "postgresql", "schema": "o'x"})
    for bad in ({"db_type": "oracle", "database": "d"}, {"db_type": "postgresql"}):
        with pytest.raises(ValueError):
            jdbc.options(bad)


def test_scratch_folder_follows_the_session(spark):
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
