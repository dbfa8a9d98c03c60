from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from veladura.llm import exactsub, induced, jaccard


def naive(data: bytes, depth: int):
    order = sorted(range(len(data)), key=lambda i: data[i:])

    def common(a, b):
        k = 0
        while k < depth and max(a, b) + k < len(data) and data[a + k] == data[b + k]:
            k += 1
        return k

    return [data[i : i + depth] for i in order], [0, *(common(a, b) for a, b in zip(order, order[1:], strict=False))][: len(data)]


@pytest.mark.parametrize("held", [3, 1 << 20])
def test_induced_order(monkeypatch, held):
    monkeypatch.setattr(induced.Queue.__init__, "__defaults__", (held,))
    draw = random.Random(held)
    for _ in range(400):
        letters, n = draw.choice([b"ab", b"abc", b"a", b"abcdefgh", b"\x00\xff"]), draw.randint(0, 60)
        data = bytes(draw.choice(letters) for _ in range(n))
        data = data[:20] * draw.randint(0, 3) + data
        depth = draw.choice([3, 5, 8, 200])
        places, common = induced.suffixes(np.frombuffer(data, np.uint8), depth)
        assert sorted(places.tolist()) == list(range(len(data)))
        assert ([data[i : i + depth] for i in places], common.tolist()) == naive(data, depth)


def removed(texts: list[bytes], length: int):
    counts = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(t), sum(gone), sum(g and not p for g, p in zip(gone, b"\0" + gone, strict=False)), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("hot", [10, 4000])
def test_substrings_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(exactsub, "HOT", hot)
    draw = random.Random(2)
    words = [("é" if draw.random() < 0.1 else "") + f"w{draw.randrange(4000):x}" for _ in range(4000)]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    shared, short = [prose(120) for _ in range(3)], prose(65)
    texts = [f"{prose(draw.randint(5, 60))} {draw.choice(shared)[draw.randint(0, 90) :]} {prose(draw.randint(5, 60))}" for _ in range(40)]
    texts += [prose(20) + short + prose(20) for _ in range(30)] + [texts[0]] * 3 + ["a" * 1000, "b" * 399, "b" * 400, "c" * 400, "c" * 400, "Heer " * 200, "", None, texts[5] * 2, shared[0] * 2 + shared[1]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in exactsub.without_repeats(frame).collect())
    assert got == [(i, *x) for i, x in enumerate(removed([(t or "").encode() for t in texts], 400))]


def classes(rows):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    label = {i: i for i in sets}
    names = sorted(sets)
    links = [(a, b) for k, a in enumerate(names) for b in names[:k] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_components_against_brute_force(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base, passage = [draw.choice(words) for _ in range(200)], [draw.choice(words) for _ in range(60)]
    texts = []
    for _ in range(70):
        copy = list(base)
        for _ in range(draw.randint(0, 8)):
            copy[draw.randrange(200)] = draw.choice(words)
        texts.append(" ".join(copy))
    texts += [" ".join(passage + [draw.choice(words) for _ in range(draw.randint(0, 25))]) for _ in range(60)]
    texts += [" ".join([draw.choice(words) for _ in range(200)] + passage) for _ in range(40)]
    texts += ["a b", "A  b", "a b c", "", "  ", None, "x", "a b c d e", "a b c d e f"] + [texts[3]] * 20
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == classes(rows)


def test_lists_are_shuffled_and_written_once(spark, monkeypatch):
    """Before, counts of shingles and their rows were shuffled apart, and the heads of classes written a second time."""
    tokens = spark.range(200).selectExpr("id AS doc_id", "id % 150 AS t")
    shared = jaccard._shared(tokens)
    assert shared._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.doc_id, r.t, r.df) for r in shared.collect()} == {(i, i % 150, 2) for i in range(200) if i % 150 < 50}
    columns = {}
    monkeypatch.setattr(jaccard, "written", lambda df, name, real=jaccard.written, **o: columns.setdefault(name, df.columns) and real(df, name, **o))
    rows = [(i, " ".join(f"w{i % 3}x{k}" for k in range(30))) for i in range(9)]
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i % 3 for i in range(9)}
    assert [n for n, c in columns.items() if "head" in c] == ["jaccard-heads"]
