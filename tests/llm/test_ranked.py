"""Ranked search against scoring every document, with few documents to a shard, ties, copies and odd rows."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest

from veladura.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans({chr(b): chr(b + 32) for b in range(65, 91)})


def brute(docs, items):
    counts = [collections.Counter(TERM.findall((t or "").translate(FOLD))) for _, t in docs]
    lengths = [sum(c.values()) for c in counts]
    n, total, df = sum(x > 0 for x in lengths), sum(lengths), collections.Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), c, length in zip(docs, counts, lengths, strict=True):
            m = 100 - 90 + (90 * length * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(TERM.findall((text or "").translate(FOLD))) if c[t])
            if s > 0:
                scores.append((-s, doc is not None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scores)[:10], 1)]
    return sorted(out, key=repr)


def corpus():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Größe", "É", "naïve", "x1"]
    docs = [(draw.randrange(10**6), " ".join(draw.choices(words, k=draw.randrange(1, 40), weights=[1 / (i + 1) for i in range(len(words))]))) for _ in range(600)]
    docs += [(10**6 + i, "one hot copy of w1 and w2") for i in range(200)] + [(7, "w5 w6")] * 15 + [(8, None), (9, ""), (None, "w5 w6 w7"), (None, "w5 w6 w7"), (10, "., !"), (11, "w3 " * 5000)]
    items = [(i, " ".join(draw.choices(words, k=draw.randrange(1, 12)))) for i in range(25)] + [(25, "hot COPY"), (25, "hot COPY"), (26, None), (27, ""), (28, "absent"), (None, "w1 w1 größe"), (29, "GRÖSSE GröSSe grÖße w5")]
    return docs, items


@pytest.mark.parametrize("shard_docs, block_terms, opened", [(1 << 16, 500_000, 64), (37, 40, 1)])
def test_search_against_brute_force(spark, monkeypatch, shard_docs, block_terms, opened):
    for name, value in (("SHARD_DOCS", shard_docs), ("BLOCK_TERMS", block_terms), ("OPENED_FIRST", opened)):
        monkeypatch.setattr(ranked, name, value)
    docs, items = corpus()
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id bigint, text string, score int, shard int").repartition(3)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, rank int")
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in ranked.ranked(frame, asked).collect()]
    assert sorted(got, key=repr) == brute(docs, items)
    assert ranked.ranked(frame.where("1 = 0"), asked).count() == 0 and ranked.ranked(frame, asked.where("1 = 0")).count() == 0


def test_range_maxima():
    draw = np.random.default_rng(1)
    sizes = [1, 2, 3, 50, 128]
    docs = np.concatenate([np.sort(draw.choice(200, s, replace=False)) for s in sizes]).astype(np.int32)
    impacts = draw.integers(1, 20, len(docs)).astype(np.int32)
    starts = np.cumsum([0, *sizes])
    shard = ranked.Shard(np.arange(200), np.arange(len(sizes)), starts, docs, impacts)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        pairs = [(low, high) for low in range(a, b) for high in range(low + 1, b + 1)]
        low, high = np.array(pairs).T
        assert shard.largest(low, high).tolist() == [x + int(impacts[x:y].argmax()) for x, y in pairs]


def test_few_intervals_are_opened():
    """A document far above the others is found without looking at all."""
    n = 5000
    impacts = np.full(2 * n, 10, np.int32)
    impacts[[1234, n + 1234]] = 1000
    shard = ranked.Shard(np.arange(n), np.arange(2), np.array([0, n, 2 * n]), np.tile(np.arange(n, dtype=np.int32), 2), impacts)
    calls = []
    plain = shard.largest
    shard.largest = lambda low, high: calls.append(len(low)) or plain(low, high)
    assert shard.best([(0, 1), (1, 1)], top=1) == [(2000, 1234)]
    assert sum(calls) <= 8
