from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veladura.operators.generate import generate_over
from veladura.operators.mask import mask_text
from veladura.sinks import folders
from veladura.streaming import streams


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(500).selectExpr("id", "concat('ip 10.0.0.', cast(id % 250 as string)) AS t")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.read_table_stream(spark, str(tmp_path / "in"), "part", rows.schema, max_files=1)
    streams.run_to_files(streams.stream_mask(stream, "t"), str(tmp_path / "mask"), str(tmp_path / "c1"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "mask")).collect())) == sorted(map(tuple, mask_text(rows, "t").collect()))
    streams.run_to_files(streams.stream_generate(stream, "id", ["nombre", "uuid"], ["id"]), str(tmp_path / "gen"), str(tmp_path / "c2"))
    batch = generate_over(rows, "id", ["nombre", "uuid"], keep=["id"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "gen")).collect())) == sorted(map(tuple, batch.collect()))


def test_tables_may_be_files_or_folders(spark, tmp_path):
    """A table in one file, and one in a folder of several; other tables of the folder are not read."""
    rows = spark.range(300).selectExpr("id", "concat('ip 10.0.0.', cast(id % 250 as string)) AS t")
    for at, n in (("several", 4), ("one", 1)):
        rows.repartition(n).write.parquet(str(tmp_path / at / "docs.parquet"))
        rows.selectExpr("-id AS id", "t").write.parquet(str(tmp_path / at / "other.parquet"))
    whole = tmp_path / "one" / "docs.parquet"
    next(whole.glob("part-*")).rename(tmp_path / "one" / "docs-0.parquet")
    for at in ("several", "one"):
        stream = streams.read_table_stream(spark, str(tmp_path / at), "docs", rows.schema)
        streams.run_to_files(stream, str(tmp_path / f"{at}-out"), str(tmp_path / f"{at}-state"))
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / f"{at}-out")).collect())) == sorted(map(tuple, rows.collect()))


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp, t string"
    for i, when in enumerate(["2024-01-01 10:00:00", "2024-01-02 10:00:00", "2024-01-02 10:05:00", "2024-01-01 10:30:00", "2024-01-02 10:10:00"]):
        row = spark.createDataFrame([(when, "a@b.co")], "ts string, t string").selectExpr("cast(ts as timestamp) AS ts", "t")
        row.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        part = max((tmp_path / "in").glob("part-*"), key=lambda p: p.stat().st_mtime_ns)
        part.rename(part.with_name(f"e{i}.parquet"))
    stream = streams.read_table_stream(spark, str(tmp_path / "in"), "e", spark.createDataFrame([], schema).schema, max_files=1)
    counts = streams.stream_pii_counts(stream, "t", "ts").select(F.col("window.start").cast("string").alias("w"), "type", "n")
    streams.run_keyed(counts, str(tmp_path / "out"), str(tmp_path / "c"), ["w", "type"], every=2)
    got = {r["w"]: r["n"] for r in streams.keyed_state(spark, str(tmp_path / "out"), ["w", "type"]).collect()}
    # a batch drops what was late at the end of the batch before the last: the fourth file does not count
    assert got == {"2024-01-01 10:00:00": 1, "2024-01-02 10:00:00": 3}


def test_keyed_state_is_bounded(spark, tmp_path):
    """A hundred batches over seven keys leave two states and the batches since the one before; batches may be repeated."""
    path, wanted = str(tmp_path / "state"), {}
    with pytest.raises(ValueError):
        streams.keyed_state(spark, path, ["k"])
    for i in range(100):
        rows = [(i % 7, "a", i), ((i * 3) % 7, "b", -i)]
        wanted |= {(k, t): n for k, t, n in rows}
        batch = spark.createDataFrame(rows, "k int, t string, n int").coalesce(1)
        streams.upsert(batch, i, path, ["k", "t"])
        if i in (4, 9, 57):
            streams.upsert(batch, i, path, ["k", "t"])
        if i in (4, 10, 58, 99):
            assert {(r["k"], r["t"]): r["n"] for r in streams.keyed_state(spark, path, ["k", "t"]).collect()} == wanted
    left = folders.names(spark, path)
    assert left == ["b" + f"{i:010d}" for i in range(90, 100)] + ["s0000000089", "s0000000099"]
    # A batch that a finished state holds is passed over, also when its own table is gone.
    streams.upsert(spark.createDataFrame([(0, "a", 1)], "k int, t string, n int"), 50, path, ["k", "t"])
    assert folders.names(spark, path) == left


def test_rate_rows(spark):
    assert streams.rate_rows(spark, 5).isStreaming
