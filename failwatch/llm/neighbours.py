"""Approximate nearest neighbours by inner product: one HNSW graph per shard.

Vectors are dealt to shards of about ``SHARD_ROWS`` distinct vectors whose norms differ by a
factor of two at most. In each shard vectors are scaled by the largest norm and get one
coordinate more, so that all have norm 1; then the nearest by angle is the one of largest inner
product. As norms are alike, the added coordinate does not drown the others. Graphs are built and
searched in double precision. The graph is hierarchical: a node's level
is drawn from its hash, each layer is a flat array of neighbour numbers, links are chosen by the
diversity rule and pruned by it. Nodes are added in blocks that search the graph so far
together, which gives numpy whole arrays to work on. The graph is stored as a table, a row per
node with its neighbour arrays.

Every query goes to every shard, in slices of ``QUERY_SLICE`` queries; each shard's nearest,
scored in double precision on the original vectors, are merged. Equal vectors are one node,
which keeps its k + 1 smallest ids: more can not be among k results, and none is lost.

Edge cases: a vector that is null, empty or zero, or holds a null or non-finite component, takes
no part. Vectors of another dimension are a space of their own. A null vec_id takes no part.
Rows that repeat are one. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from failwatch.llm.words import mix
from failwatch.storage import materialize

SHARD_ROWS = 8192
QUERY_SLICE = 50_000
LINKS = 16
BREADTH_BUILD = 64
BREADTH_SEARCH = 128
BLOCK = 256
#: Nodes of a query that are opened in one step.
OPENED = 4
QUERY_BATCH = 256


def search_layer(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and similarities of the best ``breadth`` nodes met, best first, -1 where none.

    All queries take their steps together; a query rests when its best nodes are all opened."""
    b, width = len(queries), links.shape[1]
    ids = np.full((b, breadth), -1, np.int64)
    sims = np.full((b, breadth), -np.inf)
    opened = np.zeros((b, breadth), bool)
    seen = np.zeros((b, len(x) + 1), bool)
    first = entries[:, :breadth]
    ids[:, : first.shape[1]] = first
    sims[:, : first.shape[1]] = np.einsum("bmd,bd->bm", x[first], queries)
    np.put_along_axis(seen, first, True, axis=1)
    rows = np.arange(b)
    while len(rows):
        free = (ids[rows] >= 0) & ~opened[rows]
        chosen = free & (np.cumsum(free, axis=1) <= OPENED)
        going = chosen.any(axis=1)
        rows, chosen = rows[going], chosen[going]
        if not len(rows):
            break
        opened[rows] |= chosen
        at, column = np.nonzero(chosen)
        slot = np.cumsum(chosen, axis=1)[at, column] - 1
        near = np.full((len(rows), OPENED, width), -1, np.int64)
        near[at, slot] = links[ids[rows[at], column]]
        near = np.sort(near.reshape(len(rows), -1), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[rows[:, None], near]] = -1
        seen[rows[:, None], near] = True
        seen[:, -1] = False
        found = np.einsum("bmd,bd->bm", x[near], queries[rows])
        found[near < 0] = -np.inf
        all_ids = np.concatenate([ids[rows], near], axis=1)
        all_sims = np.concatenate([sims[rows], found], axis=1)
        all_opened = np.concatenate([opened[rows], np.zeros(near.shape, bool)], axis=1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :breadth]
        ids[rows] = np.take_along_axis(all_ids, order, axis=1)
        sims[rows] = np.take_along_axis(all_sims, order, axis=1)
        opened[rows] = np.take_along_axis(all_opened, order, axis=1)
    ids[np.isneginf(sims)] = -1
    return ids, sims


def choose_links(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, count: int) -> np.ndarray:
    """Of candidates, best first, those nearer to the node than to any chosen before.

    Left places are filled with the best of the others."""
    b, c = ids.shape
    vectors = x[ids]
    between = vectors @ vectors.transpose(0, 2, 1)
    chosen = np.zeros((b, c), bool)
    number = np.zeros(b, np.int64)
    for i in range(c):
        rival = np.where(chosen, between[:, i], -np.inf).max(axis=1)
        take = (ids[:, i] >= 0) & (number < count) & (sims[:, i] > rival)
        chosen[:, i] = take
        number += take
    rank = np.where(chosen, 0, 1) + np.where(ids >= 0, 0, 2)
    order = np.argsort(rank, axis=1, kind="stable")[:, :count]
    out = np.take_along_axis(ids, order, axis=1)
    if c < count:
        out = np.concatenate([out, np.full((b, count - c), -1, np.int64)], axis=1)
    return out


def _add_back(x: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
    """Link the neighbours of new nodes back; full lists are chosen anew."""
    width = links.shape[1]
    near = links[new]
    target, source = near.ravel(), np.repeat(new, width)
    source, target = source[target >= 0], target[target >= 0]
    fresh = ~(links[target] == source[:, None]).any(axis=1)
    source, target = source[fresh], target[fresh]
    if not len(target):
        return
    sims = np.einsum("md,md->m", x[source], x[target])
    order = np.lexsort((-sims, target))
    source, target = source[order], target[order]
    nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
    # Of very many new links to one node the nearest are enough to choose from.
    place = np.arange(len(target)) - np.repeat(first, counts)
    kept = place < 2 * width
    extra = np.full((len(nodes), min(int(counts.max()), 2 * width)), -1, np.int64)
    extra[np.repeat(np.arange(len(nodes)), counts)[kept], place[kept]] = source[kept]
    for i in range(0, len(nodes), BLOCK):
        part = nodes[i : i + BLOCK]
        ids = np.concatenate([links[part], extra[i : i + BLOCK]], axis=1)
        sims = np.einsum("bmd,bd->bm", x[ids], x[part])
        sims[ids < 0] = -np.inf
        order = np.argsort(-sims, axis=1, kind="stable")
        links[part] = choose_links(x, np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1), width)


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled by the largest norm, with the coordinate that makes all norms 1."""
    scale = np.abs(vectors).max()
    scaled = vectors / scale
    norms = np.linalg.norm(scaled, axis=1)
    scaled, norms = scaled / norms.max(), norms / norms.max()
    return np.column_stack([scaled, np.sqrt(np.maximum(1 - norms**2, 0))])


def draw_levels(count: int) -> np.ndarray:
    """Levels of nodes 0 to count - 1, highest first: geometric, by hash."""
    uniform = (mix(np.arange(1, count + 1, dtype=np.uint64)) >> np.uint64(11)) / 2.0**53
    return np.sort((-np.log(np.maximum(uniform, 1e-18)) / math.log(LINKS)).astype(np.int64))[::-1]


def build_graph(x: np.ndarray, levels: np.ndarray) -> list[np.ndarray]:
    """Neighbour arrays of every layer, lowest first; nodes are ordered by level, highest first."""
    layers: list[np.ndarray] = []
    for level in range(int(levels[0]), -1, -1):
        count = int((levels >= level).sum())
        above = int((levels > level).sum())
        width = 2 * LINKS if level == 0 else LINKS
        links = np.full((count, width), -1, np.int64)
        start = min(count, max(BLOCK, above))
        for i in range(0, start, BLOCK):
            part = np.arange(i, min(i + BLOCK, start))
            sims = x[part] @ x[:start].T
            sims[np.arange(len(part)), part] = -np.inf
            order = np.argsort(-sims, axis=1, kind="stable")[:, :BREADTH_BUILD]
            best = np.take_along_axis(sims, order, axis=1)
            links[part] = choose_links(x, np.where(np.isneginf(best), -1, order), best, width)
        _add_back(x, links, np.arange(start))
        for i in range(start, count, BLOCK):
            part = np.arange(i, min(i + BLOCK, count))
            ids, sims = search_layer(x[:i], links[:i], x[part], _descend(x, layers, x[part]), BREADTH_BUILD)
            own = x[part] @ x[part].T
            own[np.arange(len(part)), np.arange(len(part))] = -np.inf
            ids = np.concatenate([ids, np.tile(part, (len(part), 1))], axis=1)
            sims = np.concatenate([sims, own], axis=1)
            ids[np.isneginf(sims)] = -1
            order = np.argsort(-sims, axis=1, kind="stable")[:, :BREADTH_BUILD]
            links[part] = choose_links(x, np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1), width)
            _add_back(x, links, part)
        layers.insert(0, links)
    return layers


def _descend(x: np.ndarray, layers: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """Entry nodes for the layer below ``layers``: the nearest found in them from the top down."""
    entries = np.zeros((len(queries), 1), np.int64)
    for links in reversed(layers):
        ids, _ = search_layer(x[: len(links)], links, queries, entries, 8)
        entries = np.where(ids >= 0, ids, ids[:, :1])[:, :4] if ids.shape[1] > 1 else ids
        # An entry must not stand twice in the list.
        entries = entries[:, :1] if (ids[:, :4] < 0).any() else entries
    return entries


def search_graph(x: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, breadth: int) -> np.ndarray:
    """Numbers of the best nodes found for every query, -1 where none."""
    ids, _ = search_layer(x, layers[0], queries, _descend(x, layers[1:], queries), breadth)
    return ids


def _valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0)


def _octave(vector: Column) -> Column:
    """The norm as a power of two, rounded; scaled first, so that no square over- or underflows."""
    largest = F.array_max(F.transform(vector, F.abs))
    squares = F.aggregate(vector, F.lit(0.0), lambda total, x: total + (x / largest) * (x / largest))
    return F.round(F.log2(largest) + F.log2(squares) / 2).cast("int")


def nodes(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """shard, ids (the k + 1 smallest of equal vectors) and vector of every distinct vector."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & _valid(F.col("vector")))
    smallest = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("rank", F.dense_rank().over(smallest)).where(F.col("rank") <= k + 1)
    distinct = materialize(few.groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), "distinct-vectors")
    distinct = distinct.withColumn("dim", F.size("vector")).withColumn("octave", _octave(F.col("vector")))
    ranges = distinct.groupBy("dim", "octave").agg(F.ceil(F.count("*") / shard_rows).alias("shards"))
    # One row per dimension and octave, of which double precision has about two thousand.
    return distinct.join(F.broadcast(ranges), ["dim", "octave"]).select(
        F.struct("dim", "octave", F.pmod(F.xxhash64("vector"), "shards").alias("number")).alias("shard"), "ids", "vector"
    )


_INDEX = "shard struct<dim:int,octave:int,number:bigint>, node bigint, ids array<bigint>, vector array<double>, levels bigint, links array<array<int>>"


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Graph rows of each shard; the rows of a shard come together."""
    held: list[pa.RecordBatch] = []
    key = None

    def out():
        table = pa.Table.from_batches(held).combine_chunks()
        vectors = _matrix(table["vector"].combine_chunks())
        levels = draw_levels(len(vectors))
        layers = build_graph(unit_vectors(vectors), levels)
        arrays = [[layer[i].tolist() for layer in layers[: levels[i] + 1]] for i in range(len(vectors))]
        return pa.record_batch(
            [table["shard"].combine_chunks(), pa.array(np.arange(len(vectors))), table["ids"].combine_chunks(), table["vector"].combine_chunks(),
             pa.array(levels + 1), pa.array(arrays, pa.list_(pa.list_(pa.int32())))],
            ["shard", "node", "ids", "vector", "levels", "links"],
        )

    for batch in batches:
        keys = batch["shard"].to_pylist()
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if held and keys[start] != key:
                    yield out()
                    held = []
                key = keys[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield out()


def build_index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The stored graphs: one row per node."""
    table = materialize(nodes(vectors, k, shard_rows), "vectors")
    shards = table.select("shard").distinct().count()
    spread = table.repartition(max(1, 4 * shards), "shard").sortWithinPartitions("shard", F.col("ids")[0], "vector")
    return materialize(spread.mapInArrow(_shards, _INDEX), "graph")


def search(index: DataFrame, queries: DataFrame, k: int, breadth: int = BREADTH_SEARCH) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of every query but itself."""
    asked = queries.select(F.col("vec_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))
    asked = materialize(asked.where(F.col("query_id").isNotNull() & _valid(F.col("vector"))).distinct(), "queries")
    slices = max(1, math.ceil(asked.count() / QUERY_SLICE))
    slice_of = F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("bigint")
    shards = index.select("shard").distinct()
    count = shards.count()
    none = F.lit(None)
    # One row per shard, so this is queries times shards.
    routed = asked.join(F.broadcast(shards), F.size("vector") == F.col("shard.dim")).select(
        "shard", slice_of.alias("slice"), F.lit(1).alias("kind"), "query_id", none.cast("bigint").alias("node"),
        none.cast("array<bigint>").alias("ids"), "vector", none.cast("array<array<int>>").alias("links"),
    )
    graph = index.select(
        "shard", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(slices)])).alias("slice"), F.lit(0).alias("kind"),
        none.cast("bigint").alias("query_id"), "node", "ids", "vector", "links",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, graph, ready = None, [], None
        for batch in batches:
            marks = list(zip(batch["shard"].to_pylist(), batch["slice"].to_pylist(), batch["kind"].to_pylist()))
            start = 0
            for i in range(1, len(marks) + 1):
                if i < len(marks) and marks[i] == marks[start]:
                    continue
                shard, part, kind = marks[start]
                if (shard, part) != key:
                    key, graph, ready = (shard, part), [], None
                rows = batch.slice(start, i - start)
                start = i
                if kind == 0:
                    graph.append(rows)
                    continue
                ready = ready or _Graph(graph)
                graph = []
                for at in range(0, rows.num_rows, QUERY_BATCH):
                    yield ready.answer(rows.slice(at, QUERY_BATCH), k, breadth)

    work = graph.union(routed).repartition(max(1, 4 * count * slices), "shard", "slice").sortWithinPartitions("shard", "slice", "kind", "node", "query_id")
    found = work.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


class _Graph:
    """A shard's stored graph in flat arrays."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.vectors = _matrix(table["vector"].combine_chunks())
        self.ids = table["ids"].to_pylist()
        links = table["links"].to_pylist()
        self.layers = []
        for level in range(len(links[0])):
            self.layers.append(np.array([x[level] for x in links if len(x) > level], np.int64))
        self.unit = unit_vectors(self.vectors)

    def answer(self, rows: pa.RecordBatch, k: int, breadth: int) -> pa.RecordBatch:
        vectors = _matrix(rows["vector"])
        scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        queries = np.column_stack([scaled, np.zeros(len(scaled))])
        # One more than asked for: the query itself may be among them.
        found = search_graph(self.unit, self.layers, queries, max(breadth, k + 1))
        out = ([], [], [])
        for i, query in enumerate(rows["query_id"].to_pylist()):
            near = found[i][found[i] >= 0]
            scores = self.vectors[near] @ vectors[i]
            own = sorted((-s, v) for n, s in zip(near.tolist(), scores.tolist()) for v in self.ids[n] if v != query)[:k]
            out[0].extend([query] * len(own))
            out[1].extend(v for _, v in own)
            out[2].extend(-s for s, _ in own)
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds)], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Index all vectors and search for the queries."""
    return search(build_index(vectors, k), queries, k)
