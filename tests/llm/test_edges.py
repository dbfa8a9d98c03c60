"""Null, empty, repeated, very long texts, empty tables and clashing extra columns, for every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veladura.llm import decontam, exactsub, jaccard, lm, merkle, quality, secrets, spm, tokencount, wavelet

LONG = "All work and no play makes a dull day. " * 3000
ROWS = [(1, None), (2, ""), (3, "one two three four five six"), (3, "one two three four five six"), (None, "no id here"), (4, "one two three four five six"), (5, LONG), (6, " \n\t "), (7, "x")]
CLASHING = ["t", "n", "h", "first", "c", "key", "word", "label", "class", "digest", "size", "place", "words", "parts", "th", "kept", "score", "y", "x", "text_", "__range", "__copy", "__leak", "copy_id", "Near_Key", "leak_id", "leak_digest", "row", "near_key_"]


@pytest.fixture(scope="module")
def table(spark):
    frame = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    return frame.select("*", F.lit("en").alias("lang"), F.lit("src").alias("source"), F.length("text").cast("bigint").alias("n_chars"), *(F.lit("?").alias(c) for c in CLASHING))


OPERATORS = {
    "secrets": (secrets.find_secrets, len(ROWS)),
    "tokens": (tokencount.token_counts, len(ROWS)),
    "pieces": (spm.encode, len(ROWS)),
    "lm": (lm.scores, len(ROWS)),
    "suffix": (exactsub.without_repeats, len(ROWS)),
    "wavelet": (wavelet.round_trip, len(ROWS)),
    "quality": (lambda d: quality.score(d, quality.CONSTANT), len(ROWS)),
    "leaks": (lambda d: decontam.leaks(d, d.select(F.lit(9).alias("item_id"), F.lit("one two three four five six").alias("text")).limit(1)), 2),
    "jaccard": (jaccard.near_duplicates, len(ROWS)),
    "merkle": (merkle.edited_pairs, len(ROWS)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_of_odd_tables(spark, table, name):
    run, wanted = OPERATORS[name]
    assert run(table).count() == wanted
    assert run(table.where("1 = 0")).count() == 0


def test_values_of_odd_rows(table):
    by_id = lambda df: {r.doc_id: r for r in df.collect()}
    found = by_id(jaccard.near_duplicates(table))
    assert [found[k].component_id for k in (1, 2, 3, 4, 5, 6, 7)] == [1, 2, 3, 3, 5, 6, 7] and found[None].component_id is None
    assert [found[k].n_shingles for k in (1, 2, 3, 6, 7)] == [0, 0, 2, 0, 1]
    counts = by_id(tokencount.token_counts(table))
    assert (counts[1].n_tokens, counts[2].n_tokens, counts[7].n_tokens) == (0, 0, 1)
    kept = by_id(exactsub.without_repeats(table))
    assert kept[5].n_removed == len(LONG) and kept[5].n_spans == 1 and bytes(kept[5].kept) == b"" and kept[3].n_removed == 0
    prints = by_id(merkle.edited_pairs(table))
    assert prints[1].fingerprint == prints[2].fingerprint and prints[3].near_next == 1.0
    assert {r.item_id for r in decontam.leaks(table, table.select(F.lit(9).alias("item_id"), F.lit("one two three four five six").alias("text"))).collect()} == {9}


def test_stages_keep_columns(spark, table, tmp_path):
    spark.createDataFrame([(1, 1, 0), (3, 1, 0), (7, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "benchmark text that nobody holds, of some words")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame in (table, table.where("1 = 0")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, str(tmp_path))
            assert out.columns == frame.columns
            assert out.count() <= frame.count()
        assert corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).count() == frame.count()
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.STAGES[1][1](spark, table, str(tmp_path)).collect()) == [0, 1, 2, 3, 5, 6, 7]


def test_rows_decide_not_ids(spark):
    """Of two texts under one id only the copy goes; equal rows and rows without an id leave one of each text; leaks go by text."""
    own, other, third = ("one two three four five six seven", "a text of its own that nobody else has", "something quite different stands in here")
    rows = [(1, own), (5, own), (5, other), (6, third), (6, third), (None, own), (None, "no id and alone here today"), (None, "no id and alone here today"), (7, None), (7, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(((r.doc_id, r.text) for r in jaccard.keep_one(frame).collect()), key=str)
    assert kept == sorted([(1, own), (5, other), (6, third), (None, "no id and alone here today"), (7, None), (7, None)], key=str)
    found = {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(frame).collect()}
    assert found == {(1, 1), (5, 1), (5, 5), (6, 6), (None, 1), (None, None), (7, 7)}
    items = spark.createDataFrame([(1, own)], "item_id bigint, text string")
    left = sorted(((r.doc_id, r.text) for r in decontam.remove_leaks(frame, items).collect()), key=str)
    assert left == sorted([r for r in rows if r[1] != own], key=str)
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(frame, items).collect()} == {(1, 1), (5, 1), (None, 1)}
