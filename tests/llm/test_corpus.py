"""Fingerprints, decontamination, quality, and the pipeline over the smallest tables."""

from __future__ import annotations

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veladura.llm import decontam, merkle, quality, queries, secrets
from veladura.llm.common import documents

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


def test_next_rows_and_likeness(spark):
    texts = [f"Line {i} of it.\nSame line here.\n\nEnd {i}, really." * (1 + i % 3) for i in range(40)] + ["", "😀é"]
    rows = [(7 * i - 100, t) for i, t in enumerate(texts)]
    got = sorted(merkle.edited_pairs(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect(), key=lambda r: r.doc_id)
    for k, r in enumerate(got):
        own, following = texts[k], texts[(k + 1) % len(texts)]
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (rows[k][0], len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint == r.edited_fingerprint) == (own == edited) and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) >= (own == edited)


def test_changed_paragraphs(spark):
    a = "One two three.\nFour five six.\n\nSeven eight nine."
    frame = spark.createDataFrame([(a, a.replace("five", "5")), (a, a), (a, "Other.")], "a string, b string").select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    assert [r.c for r in frame.select(merkle.changed_paragraphs(F.col("a"), F.col("b")).alias("c")).collect()] == [[1], [], [0]]


ITEM = "If Anna has 12 apples and gives 5 kg of them to Bob, how many apples does Anna keep today?"


def test_reparameterised_questions(spark):
    docs = [
        (1, f"Well. {ITEM.replace('Anna', 'Carla').replace('12', '99').replace('5 kg', '7 lb').replace('Bob', 'Dora')} yes"), (2, f"so {ITEM}"), (3, "how many apples does a tree keep today"), (4, None), (5, "some tiny one here"),
    ]
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, ITEM), (2, "tiny one"), (3, None)], "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id, r.same_values) for r in got} == {(1, 1, False), (2, 1, True), (5, 2, True)}
    # Slots that contradict each other: the same person of the item under two names.
    torn = ITEM.replace("does Anna", "does Eve").replace("Anna has", "Carla has")
    whole = decontam.leaks(spark.createDataFrame([(1, f"so {torn}")], "doc_id bigint, text string"), spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")).collect()
    assert all(r.n_matched < r.n_windows for r in whole)


TRAIN = "A train with 12 cars and 5 engines left Paris with 30 boxes and 8 crates for Berlin."


def met(spark, item, *texts):
    """Per text (n_matched, n_windows, same_values), None where it is not reported."""
    got = decontam.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    return [{r.doc_id: (r.n_matched, r.n_windows, r.same_values) for r in got}.get(k) for k in range(len(texts))]


def test_occurrences_hold_on_their_own(spark):
    first, other = (TRAIN.replace("12", a).replace("5", b).replace("30", c).replace("8 c", f"{d} c") for a, b, c, d in (("10", "7", "20", "9"), ("7", "7", "7", "7")))
    got = met(spark, TRAIN, TRAIN, first, f"{TRAIN} {first}", other, f"{first} {other} {TRAIN}", f"{first} {other}")
    assert got == [(11, 11, True), (11, 11, False), (11, 11, True), (11, 11, False), (11, 11, True), (11, 11, False)]


def test_context_and_case_do_not_hide_a_copy(spark):
    short = "What is the capital of France?"
    assert met(spark, short, f"Well. {short}", f"Q: {short}", f'He asked, "{short}', short.lower(), short.upper(), "Q: What is the capital of Spain?") == [(1, 1, True)] * 5 + [(1, 1, False)]
    assert met(spark, TRAIN, f"Q: {TRAIN}", TRAIN.lower(), TRAIN.upper(), TRAIN.title(), TRAIN.replace(" ", "\n")) == [(11, 11, True)] * 5
    numbers = "Add 1 2 3 4 5 6 7 8 9 10 and 11 12 13 14 15 16"
    assert met(spark, numbers, f"so {numbers.lower()}", numbers.replace("1", "3"))[0][2]


def test_passages_against_brute_force(spark):
    """Each cut of a long item is reported if RUN words in a row are verbatim or the share of its windows is reached."""
    import random

    draw = random.Random(5)
    item = [f"{draw.choice('abcdefgh')}{draw.choice(['ta', 'ro', 'mi'])}{k}x" for k in range(300)]
    cuts = [(draw.randrange(200), n) for n in (8, 12, 13, 14, 20, 60, 94, 100)]
    texts = [f"Well, {' '.join(item[a : a + n])} and so on" for a, n in cuts] + [f"{' '.join(item[a : a + 12])} but {' '.join(item[a + 12 : a + 24])}" for a, _ in cuts[:2]]
    windows = lambda w: {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
    wanted = []
    for text in texts:
        words = text.replace(",", "").lower().split()
        row = any(words[k : k + 13] == item[j : j + 13] for k in range(len(words) - 12) for j in range(288))
        n = len(windows(words) & windows(item))
        wanted.append((n, 293, True) if row or n >= 0.3 * 293 else None)
    assert met(spark, " ".join(item), *texts) == wanted and None in wanted


@needs_tables
def test_leaks_against_brute_force(spark):
    import re

    docs, items = documents(spark, FOLDER), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    cut = lambda t: re.findall(r"\w+", t.lower())
    windows = lambda t: {tuple(w[k : k + 8]) for w in [cut(t)] for k in range(len(w) - 7)}
    held = {r.item_id: windows(r.text) for r in items.collect()}
    wanted = {(d.doc_id, i) for d in docs.collect() for w in [windows(d.text)] for i, x in held.items() if x and len(w & x) >= 0.5 * len(x)}
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()} == wanted


@needs_tables
def test_held_out_accuracy(spark):
    folder = FOLDER.replace("0.001", "0.01")
    got = queries.QUERIES["op7_quality_ranking"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 30 and sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_ranking_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    model = quality.fit(docs, spark.createDataFrame([(1, 1), (3, 0), (2, None)], "doc_id bigint, quality int"), F.lit(True))
    assert {r.score for r in quality.score(docs, model).collect()} == {1.0}


@needs_tables
def test_pipeline_against_its_parts(spark):
    from test_repeats import classes

    docs = {r.doc_id: r.text for r in documents(spark, FOLDER).collect()}
    model = quality.fit(documents(spark, FOLDER), spark.read.parquet(f"{FOLDER}/labels.parquet"), F.lit(True))
    import numpy as np

    good = {i: t for i, t in docs.items() if model.scores(np.array([quality.features(t)]))[0] >= 0.3}
    single = {i for i, (_, c) in classes(list(good.items())).items() if c == i}
    leaked = {r.doc_id for r in decontam.leaks(documents(spark, FOLDER), spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(got) == single - leaked
    assert all(r.round_trip for r in got.values())
    plain = {i for i in got if not secrets.Worklist(docs[i]).run().found}
    assert 0 < len(plain) <= len(got)


def test_table_of_grams_leaves_few_places(spark, monkeypatch):
    """A table of a fixed size tells most words apart from an item's, and every window of an item passes it."""
    monkeypatch.setattr(decontam, "BYTES_LEAST", 1 << 13)
    monkeypatch.setattr(decontam, "BYTES_MOST", 1 << 13)
    windows = [(8, [f"w{(8 * i + j) * 7919 % 10007}x" for j in range(8)]) for i in range(100)]
    table = decontam.item_grams(spark.createDataFrame(windows, "size int, v array<string>"), 8)
    assert len(table) == 1 << 13 and max(table) < 128 and sum(x.bit_count() for x in table) < 0.15 * 7 * len(table)
    texts = spark.createDataFrame([(i, "z " * i + " ".join(v)) for i, (_, v) in enumerate(windows)], "i int, mark string")
    found = texts.select("i", F.transform(decontam.candidates(F.col("mark"), 8, table), lambda x: x["at"]).alias("at")).collect()
    assert len(found) == 100 and all(r.i in r.at for r in found)
