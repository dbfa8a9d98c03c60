"""Graph search: recall against brute force, exact scores, copies, odd vectors, several shards and query blocks."""

from __future__ import annotations

import numpy as np
import pytest

from veladura.llm import neighbours


def rows_of(got):
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


@pytest.mark.parametrize("even", [True, False])
def test_recall_and_order(spark, monkeypatch, even):
    for name, value in (("SHARD_ROWS", 700), ("BLOCK_CELLS", 400), ("BATCH", 128)):
        monkeypatch.setattr(neighbours, name, value)
    draw = np.random.default_rng(4)
    vectors = draw.normal(size=(20, 16))[draw.integers(0, 20, 2000)] + draw.normal(size=(2000, 16)) * 0.4
    if even:
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[500:900] = vectors[500]
    frame = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>, score double")
    got = rows_of(neighbours.nearest(neighbours.graphs(frame), frame.where("vec_id % 20 = 0")).collect())
    assert set(got) == set(range(0, 2000, 20))
    hits = 0
    for q, found in got.items():
        scores = vectors @ vectors[q]
        order = [i for i in np.lexsort((np.arange(2000), -np.round(scores, 12))) if i != q][:20]
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s - scores[i]) < 1e-9 for _, i, s in found) and [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(order))
    assert hits / (20 * len(got)) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (20, [1.0, 0.0, 0.0]), (21, [3.0, 4.0, 0.0]), (40, [1e300, -1.0]), (None, [0.5, 0.5]), (60, [-1.0, 2.0]), (60, [-1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = neighbours.nearest(neighbours.graphs(frame), frame.where("vec_id % 20 = 0")).collect()
    found = {q: [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 20, 40)}
    assert found[0] == [(1, 40, 1e300), (2, None, 0.5), (3, 1, 0.5), (4, 2, 0.5), (5, 60, -1.0), (6, 60, -1.0)]
    assert found[20] == [(1, 21, 3.0)]
    assert [i for _, i, _ in found[40]] == [0, None, 1, 2, 60, 60]
    assert sum(r.query_id == 60 for r in got) == 10
    shards = neighbours.graphs(frame)
    assert neighbours.nearest(shards, frame.where("1 = 0")).count() == 0 and neighbours.nearest(neighbours.graphs(frame.where("1 = 0")), frame).count() == 0


def test_layers_are_prefixes():
    draw = np.random.default_rng(2)
    graph = neighbours.Graph.build(np.arange(3000), draw.normal(size=(3000, 8)))
    sizes = [len(x) for x in graph.layers]
    assert sizes[0] == 3000 and sizes == sorted(sizes, reverse=True) and len(sizes) > 1
    for k, links in enumerate(graph.layers):
        assert links.shape[1] == (2 if k == 0 else 1) * neighbours.LINKS and links.max() < sizes[k]
        assert all(len(set(r[r >= 0].tolist())) == (r >= 0).sum() and i not in r for i, r in enumerate(links))
    again = neighbours.Graph.read(8, *graph.cells())
    assert all((a == b).all() for a, b in zip(graph.layers, again.layers, strict=True)) and (again.members == graph.members).all()
