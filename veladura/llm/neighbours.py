"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

Vectors are dealt into shards of at most SHARD_ROWS. A shard's graph has layers; a node's highest layer falls
geometrically, and nodes are numbered by falling layer, so each layer is a prefix of the nodes and its neighbours one flat
array of n x width places (-1: none). Nodes are inserted layer by layer from the top, in batches: a search of the layers
above gives the entry points, a beam search of the layer the candidates (with those of the batch itself), of which those
are linked that are nearer to the node than to a neighbour already chosen; reverse links are pruned by the same rule.
All searches run in step over a batch of queries, so a step is a few array operations.

Nearness is the inner product, which is no distance; so graphs are built over vectors lengthened by one component that
makes all norms of a shard equal, where both orders agree. Equal vectors of a shard are one node with several ids.

Every shard answers every query; the results of all shards are merged by score. Queries come in blocks of about
BLOCK_CELLS components, each broadcast. Scores are inner products of the original vectors in double precision.

Rows: vectors that are null, empty, zero or hold null or non-finite components take no part; only vectors of one length
are compared; repeated rows are candidates each and queries each; a query's own row and all others with its id are no
candidates of it; null ids are candidates, first in ties; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veladura.llm.common import shipped, written

TOP = 20
SHARD_ROWS, SHARD_CELLS = 8192, 1 << 23
LINKS = 16
BUILD_WIDTH, SEARCH_WIDTH, DESCENT_WIDTH = 64, 128, 8
BATCH = 1024
BLOCK_CELLS = 1 << 21
NULL_ID = -(2**63)
GRAPH_SCHEMA = "dim int, ids binary, members binary, vectors binary, sizes binary, links binary"
GRAPH_OPTIONS = {"compression": "none", "parquet.block.row.count.limit": "2"}


def takes_part(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(frame: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    shipped(frame.sparkSession)
    return frame.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(takes_part(F.col("vector")))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    ids = np.array([NULL_ID if x is None else x for x in batch.column("id").to_pylist()], np.int64)
    lists = batch.column("vector")
    values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return ids, [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, likeness), best first, -1 where there are fewer: the width best nodes that each query meets, from its entries (-1: none)."""
    b, n = len(queries), len(links)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True
    nodes = np.full((b, width), -1, np.int32)
    likeness = np.full((b, width), -np.inf, np.float32)
    opened = np.ones((b, width), bool)
    active, near = np.arange(b), entries[:, :width]
    while len(active):
        near = np.where(near < 0, n, near)
        new = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        score = np.matmul(vectors[np.minimum(near, n - 1)], queries[active][:, :, None])[:, :, 0]
        score[~new] = -np.inf
        all_scores = np.concatenate([likeness[active], score], axis=1)
        best = np.argpartition(-all_scores, width - 1, axis=1)[:, :width]
        likeness[active] = np.take_along_axis(all_scores, best, 1)
        nodes[active] = np.take_along_axis(np.concatenate([nodes[active], near.astype(np.int32)], axis=1), best, 1)
        opened[active] = np.take_along_axis(np.concatenate([opened[active], ~new], axis=1), best, 1)
        waiting = np.where(opened[active], -np.inf, likeness[active])
        at = waiting.argmax(axis=1)
        more = waiting[np.arange(len(active)), at] > -np.inf
        active, at = active[more], at[more]
        opened[active, at] = True
        near = links[nodes[active, at]]
    order = np.argsort(-likeness, axis=1, kind="stable")
    likeness = np.take_along_axis(likeness, order, 1)
    return np.where(np.isneginf(likeness), -1, np.take_along_axis(nodes, order, 1)), likeness


def chosen(vectors: np.ndarray, base: np.ndarray, found: np.ndarray, most: int) -> np.ndarray:
    """Of the candidates of each base vector (-1: none, best need not be first) at most so many: those nearer to it than to one chosen before, then the nearest others."""
    around = vectors[np.maximum(found, 0)]
    likeness = np.matmul(around, base[:, :, None])[:, :, 0]
    likeness[found < 0] = -np.inf
    order = np.argsort(-likeness, axis=1, kind="stable")
    found, likeness = np.take_along_axis(found, order, 1), np.take_along_axis(likeness, order, 1)
    around = np.take_along_axis(around, order[:, :, None], 1)
    mutual = np.matmul(around, around.transpose(0, 2, 1))
    again = np.tril(found[:, :, None] == found[:, None, :], -1).any(axis=2)
    found = np.where(again, -1, found)
    shadowed, count = found < 0, np.zeros(len(found), np.int64)
    kept = np.zeros(found.shape, bool)
    for j in range(found.shape[1]):
        kept[:, j] = ~shadowed[:, j] & (count < most)
        count += kept[:, j]
        shadowed |= kept[:, j, None] & (mutual[:, j, :] >= likeness)
    rank = np.argsort(np.where(found < 0, 2, np.where(kept, 0, 1)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(found, rank, 1)
    return out if out.shape[1] == most else np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _linked_back(vectors: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
    """Adds the reverse of the links of new nodes; full lists are chosen anew."""
    width = links.shape[1]
    start, end = np.nonzero(links[new] >= 0)
    source, target = new[start], links[new[start], end]
    order = np.lexsort((-np.einsum("ij,ij->i", vectors[source], vectors[target]), target))
    source, target = source[order], target[order]
    first = np.flatnonzero(np.diff(target, prepend=-1))
    place = np.arange(len(target)) - np.repeat(first, np.diff(first, append=len(target)))
    # More than a list's width of new links to one node: the nearest are its candidates.
    near = place < width
    targets = target[first]
    row = np.searchsorted(targets, target[near])
    arriving = np.full((len(targets), width), -1, np.int32)
    arriving[row, place[near]] = source[near]
    arriving[(arriving[:, :, None] == links[targets][:, None, :]).any(axis=2)] = -1
    both = np.concatenate([links[targets], arriving], axis=1)
    over = (both >= 0).sum(axis=1) > width
    fits = both[~over]
    links[targets[~over]] = np.take_along_axis(fits, np.argsort(fits < 0, axis=1, kind="stable")[:, :width], 1)
    for k in range(0, int(over.sum()), BATCH):
        some = targets[over][k : k + BATCH]
        links[some] = chosen(vectors, vectors[some], both[over][k : k + BATCH], width)


def build_layers(vectors: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Flat neighbour arrays of every layer, lowest first; vectors of equal norm, layer k holds the first sizes[k] of them."""
    layers: list[np.ndarray] = [np.zeros((0, 0), np.int32)] * len(sizes)
    for k in reversed(range(len(sizes))):
        n, width = sizes[k], 2 * LINKS if k == 0 else LINKS
        links = np.full((n, width), -1, np.int32)
        done = sizes[k + 1] if k + 1 < len(sizes) else 0
        if done:
            links[:done, :LINKS] = layers[k + 1]
        while done < n:
            # While few nodes stand, batches are small: a batch sees its own nodes, but not the links they make.
            new = np.arange(done, min(n, done + min(BATCH, max(64, done))))
            own = vectors[new] @ vectors[new].T
            np.fill_diagonal(own, -np.inf)
            near = min(LINKS * 2, len(new) - 1)
            parts = [new[np.argpartition(-own, near - 1, axis=1)[:, :near]].astype(np.int32)] if near else []
            if done:
                entries = descend(vectors, layers[k + 1 :], vectors[new])
                parts.append(beam(vectors, links[:done], vectors[new], entries if len(entries[0]) else np.zeros((len(new), 1), np.int32), BUILD_WIDTH)[0])
            if parts:
                links[new, :LINKS] = chosen(vectors, vectors[new], np.concatenate(parts, axis=1), LINKS)
                _linked_back(vectors, links, new)
            done = new[-1] + 1
        layers[k] = links
    return layers


def descend(vectors: np.ndarray, upper: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """Entry nodes of each query for the layer below the given ones."""
    entries = np.zeros((len(queries), 1 if upper else 0), np.int32)
    for links in reversed(upper):
        entries = beam(vectors, links, queries, entries, DESCENT_WIDTH)[0]
    return entries


class Graph:
    """A shard: nodes in order of falling layer, their ids, and the layers."""

    def __init__(self, ids: np.ndarray, members: np.ndarray, vectors: np.ndarray, layers: list[np.ndarray]):
        """ids: of all nodes' rows; members: where each node's ids begin, and the end."""
        self.ids, self.members, self.vectors, self.layers = ids, members, vectors, layers
        self.even = self.evened(vectors)

    @staticmethod
    def evened(vectors: np.ndarray) -> np.ndarray:
        """Scaled vectors with one more component, so that all have one norm."""
        scaled = vectors / np.abs(vectors).max()
        squares = np.einsum("ij,ij->i", scaled, scaled)
        return np.column_stack([scaled, np.sqrt(squares.max() - squares)]).astype(np.float32)

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> Graph:
        vectors = vectors + 0.0
        _, first, node = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8)))[:, 0], return_index=True, return_inverse=True)
        n, draw = len(first), np.random.default_rng(len(vectors))
        level = np.floor(-np.log(1 - draw.random(n)) / math.log(LINKS)).astype(np.int64)
        order = np.lexsort((draw.random(n), -level))
        number = np.empty(n, np.int64)
        number[order] = np.arange(n)
        own = number[node]
        rows = np.lexsort((ids, own))
        members = np.searchsorted(own[rows], np.arange(n + 1))
        sizes = [int((level >= k).sum()) for k in range(int(level.max()) + 1)]
        nodes = vectors[first[order]]
        return cls(ids[rows], members, nodes, build_layers(cls.evened(nodes), sizes))

    def search(self, ids: np.ndarray, queries: np.ndarray, top: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query place, id, score) of the best top rows met for each query, without those of the query's own id."""
        asked = np.column_stack([queries / np.abs(queries).max(axis=1, keepdims=True), np.zeros(len(queries))]).astype(np.float32)
        entries = descend(self.even, self.layers[1:], asked)
        nodes, _ = beam(self.even, self.layers[0], asked, entries if entries.shape[1] else np.zeros((len(asked), 1), np.int32), max(width, top + 1))
        score = (self.vectors[np.maximum(nodes, 0)] * queries[:, None, :]).sum(axis=2)
        score[nodes < 0] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, : top + 1]
        nodes, score = np.take_along_axis(nodes, best, 1), np.take_along_axis(score, best, 1)
        # A node's ids in order: more than top and the own one are never needed.
        sizes = np.diff(self.members)
        deep = int(min(sizes.max(), top + 1))
        place = np.minimum(self.members[:-1, None] + np.arange(deep), len(self.ids) - 1)[np.maximum(nodes, 0)]
        given = (np.arange(deep) < sizes[np.maximum(nodes, 0)][:, :, None]) & (nodes >= 0)[:, :, None]
        found = self.ids[place]
        given &= found != ids[:, None, None]
        falling = np.where(given, -score[:, :, None], np.inf).reshape(len(ids), -1)
        found = found.reshape(len(ids), -1)
        order = np.lexsort((found, falling))[:, :top]
        found, falling = np.take_along_axis(found, order, 1), np.take_along_axis(falling, order, 1)
        query, at = np.nonzero(np.take_along_axis(given.reshape(len(ids), -1), order, 1))
        return query, found[query, at], -falling[query, at]

    def cells(self) -> list[bytes]:
        sizes = np.array([len(x) for x in self.layers], "<i8")
        return [self.ids.astype("<i8").tobytes(), self.members.astype("<i8").tobytes(), self.vectors.astype("<f8").tobytes(), sizes.tobytes(), b"".join(x.astype("<i4").tobytes() for x in self.layers)]

    @classmethod
    def read(cls, dim: int, ids, members, vectors, sizes, links) -> Graph:
        flat, at, layers = np.array(np.frombuffer(links, "<i4")), 0, []
        for k, n in enumerate(np.frombuffer(sizes, "<i8").tolist()):
            width = 2 * LINKS if k == 0 else LINKS
            layers.append(flat[at : at + n * width].reshape(n, width))
            at += n * width
        return cls(np.array(np.frombuffer(ids, "<i8")), np.array(np.frombuffer(members, "<i8")), np.array(np.frombuffer(vectors, "<f8")).reshape(-1, dim), layers)


def graphs(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per shard with its graph as flat arrays, written to the shared folder."""
    frame = _vectors(vectors, id_col, vector_col)
    shards = math.ceil(frame.count() / SHARD_ROWS)
    most_rows, most_cells = SHARD_ROWS, SHARD_CELLS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []

        def row() -> pa.RecordBatch:
            graph = Graph.build(np.array(ids, np.int64), np.array(held))
            return pa.RecordBatch.from_arrays([pa.array([len(held[0])], pa.int32()), *(pa.array([x], pa.binary()) for x in graph.cells())], ["dim", "ids", "members", "vectors", "sizes", "links"])

        for batch in batches:
            for i, v in zip(*_arrays(batch), strict=True):
                if held and (len(v) != len(held[0]) or len(held) >= most_rows or (len(held) + 1) * len(v) > most_cells):
                    yield row()
                    ids, held = [], []
                ids.append(i)
                held.append(np.array(v))
        if held:
            yield row()

    # Dealt in turn, not by a key: no vector or id can make a shard hot. Vectors of one length stand together.
    dealt = frame.repartition(max(1, shards)).sortWithinPartitions(F.size("vector"))
    return written(dealt.mapInArrow(build, GRAPH_SCHEMA), "neighbour-graphs", **GRAPH_OPTIONS)


def nearest(shards: DataFrame, queries: DataFrame, top: int = TOP, width: int = SEARCH_WIDTH, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for each query, of all shards."""
    spark = shards.sparkSession
    asked = written(_vectors(queries, id_col, vector_col), "neighbour-queries")
    cells = asked.agg(F.sum(F.size("vector"))).first()[0] or 0
    blocks = math.ceil(cells / BLOCK_CELLS)
    results = None
    for block in range(blocks):
        table = asked.where(F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)) == block).toArrow().combine_chunks()
        if not table.num_rows:
            continue
        ids, vectors = _arrays(table.to_batches()[0])
        lengths = np.array([len(v) for v in vectors])
        parts = {int(d): (np.flatnonzero(lengths == d), ids[lengths == d], np.array([v for v in vectors if len(v) == d])) for d in np.unique(lengths)}
        shared = spark.sparkContext.broadcast(parts)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cells in zip(*batch.columns, strict=True):
                    dim = cells[0].as_py()
                    if dim not in shared.value:
                        continue
                    graph = Graph.read(dim, *(c.as_buffer() for c in cells[1:]))
                    places, own, wanted = shared.value[dim]
                    for k in range(0, len(own), BATCH):
                        query, found, score = graph.search(own[k : k + BATCH], wanted[k : k + BATCH], top, width)
                        yield pa.RecordBatch.from_arrays([pa.array(places[k + query], pa.int64()), pa.array(found, mask=found == NULL_ID), pa.array(score)], ["slot", "vec_id", "score"])

        names = spark.createDataFrame(pa.table({"slot": pa.array(np.arange(len(ids))), "query_id": pa.array(ids, mask=ids == NULL_ID)}))
        order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_first("vec_id"))
        merged = shards.mapInArrow(search, "slot bigint, vec_id bigint, score double").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        found = written(merged.join(F.broadcast(names), "slot").select("query_id", "rank", "vec_id", "score"), "neighbour-found")
        results = found if results is None else results.unionByName(found)
    return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double") if results is None else results
