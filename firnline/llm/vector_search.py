"""Nearest vectors by inner product: one navigable small-world graph per shard.

Vectors are dealt to shards by length, a band holding lengths within a factor of two,
and at random within a band. Each shard becomes one hierarchical graph
(HNSW) kept as flat arrays: node i's neighbours on a level are row i of an integer
matrix. Every query is searched in every shard and the shards' results are merged, so
recall does not depend on how the vectors were dealt.

Building and searching go in step: a batch of nodes or queries walks the graph
together, each step one matrix operation for all of them. A batch of new nodes sees
the graph as it was before the batch and, exactly, the batch itself.

Inner product is turned into distance between vectors of one length: each vector of a
shard gets one more component that lifts it to the longest one's length, and a query
gets zero there, which leaves all its products as they were. Within a band the lift is
small beside the vector, and vectors are scaled by the band and queries to unit length,
so no length, however extreme, drowns the others or leaves the range of a float. Scales
do not change an order; the scores returned are products of the original vectors.

Equal vectors are one node with its smallest ids; more ids than a query can return,
and one for the query itself, can never be in a result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut

#: Links of a node above the lowest level, and on it; candidates kept while building.
LINKS, LOW_LINKS, BUILD_WIDTH = 16, 32, 64
BATCH = 256
#: Queries that one task searches in one shard, about.
QUERY_BLOCK = 1 << 14


@dataclass
class Graph:
    """Vectors, one neighbour matrix per level (-1: no link), and the node where
    searches begin."""

    vectors: np.ndarray
    neighbours: list[np.ndarray]
    entry: int = 0


def _top(ids: np.ndarray, scores: np.ndarray, done: np.ndarray, width: int):
    """The best ``width`` candidates of each row, best first."""
    if scores.shape[1] > width:
        part = np.argpartition(-scores, width - 1, axis=1)[:, :width]
        ids, scores, done = (np.take_along_axis(x, part, 1) for x in (ids, scores, done))
    order = np.argsort(-scores, axis=1, kind="stable")
    return tuple(np.take_along_axis(x, order, 1) for x in (ids, scores, done))


def walk(graph: Graph, level: int, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one level for all queries in step: ids and products of the
    ``width`` best nodes met from the start nodes, -1 where fewer were met."""
    n = len(queries)
    links = graph.neighbours[level]
    scores = np.einsum("nkd,nd->nk", graph.vectors[start], queries)
    scores = np.where(start >= 0, scores, -np.inf)
    ids, done = start, start < 0
    met = np.zeros((n, len(graph.vectors) + 1), bool)
    met[np.arange(n)[:, None], start] = True
    ids, scores, done = _top(ids, scores, done, width)
    active = np.arange(n)
    while len(active):
        # The two best open candidates of each query are expanded at once.
        open_scores = np.where(done[active], -np.inf, scores[active])
        pick = np.argsort(-open_scores, axis=1)[:, :2]
        value = np.take_along_axis(open_scores, pick, 1)
        going = np.isfinite(value[:, 0])
        active, pick, value = active[going], pick[going], value[going]
        if not len(active):
            break
        nodes = np.where(np.isfinite(value), ids[active[:, None], pick], -1)
        done[active[:, None], pick] = True
        found = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(active), -1)
        found = np.sort(found, axis=1)
        fresh = found >= 0
        fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
        fresh &= ~met[active[:, None], found]
        met[active[:, None], found] = True
        row, column = np.nonzero(fresh)
        products = np.full(found.shape, -np.inf, np.float32)
        products[row, column] = np.einsum("nd,nd->n", graph.vectors[found[row, column]], queries[active[row]])
        found = np.where(fresh, found, -1)
        merged = _top(np.concatenate([ids[active], found], 1), np.concatenate([scores[active], products], 1), np.concatenate([done[active], ~fresh], 1), width)
        if merged[0].shape[1] > ids.shape[1]:
            pad = merged[0].shape[1] - ids.shape[1]
            ids = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1)
            scores = np.pad(scores, ((0, 0), (0, pad)), constant_values=-np.inf)
            done = np.pad(done, ((0, 0), (0, pad)), constant_values=True)
        ids[active], scores[active], done[active] = merged
    return ids, scores


def diverse(vectors: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, best first, those nearer to the row's node than to any
    candidate chosen before; then the best of the rest, up to ``most``."""
    own = vectors[ids]
    between = np.einsum("nid,njd->nij", own, own)
    valid = np.isfinite(scores)
    chosen = np.zeros(ids.shape, bool)
    closest = np.full(ids.shape, -np.inf, np.float32)
    for j in range(ids.shape[1]):
        take = valid[:, j] & (scores[:, j] > closest[:, j]) & (chosen.sum(axis=1) < most)
        chosen[:, j] = take
        closest = np.where(take[:, None], np.maximum(closest, between[:, j]), closest)
    rank = np.where(chosen, 0, np.where(valid, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
    order = np.argsort(rank, axis=1)[:, :most]
    kept = np.take_along_axis(np.where(valid, ids, -1), order, 1)
    return np.pad(kept, ((0, 0), (0, most - kept.shape[1])), constant_values=-1)


def _link_back(graph: Graph, level: int, nodes: np.ndarray, most: int) -> None:
    """Give the neighbours of new nodes the link back, dropping the least diverse."""
    links = graph.neighbours[level]
    source = np.repeat(nodes, links.shape[1])
    target = links[nodes].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    hit, begin, count = np.unique(target, return_index=True, return_counts=True)
    for low in range(0, len(hit), BATCH):
        part = slice(low, low + BATCH)
        width = int(count[part].max())
        extra = np.full((len(hit[part]), width), -1)
        for i, (b, c) in enumerate(zip(begin[part], count[part])):
            extra[i, :c] = source[b : b + c]
        pool = np.sort(np.concatenate([links[hit[part]], extra], axis=1), axis=1)
        double = np.zeros(pool.shape, bool)
        double[:, 1:] = pool[:, 1:] == pool[:, :-1]
        scores = np.einsum("nkd,nd->nk", graph.vectors[pool], graph.vectors[hit[part]])
        scores = np.where((pool >= 0) & ~double, scores, -np.inf).astype(np.float32)
        ids, scores, _ = _top(pool, scores, double, pool.shape[1])
        room = np.isfinite(scores).sum(axis=1) <= most
        plain = np.pad(np.where(np.isfinite(scores), ids, -1), ((0, 0), (0, most)), constant_values=-1)[:, :most]
        links[hit[part]] = plain
        if (~room).any():
            links[hit[part][~room]] = diverse(graph.vectors, ids[~room], scores[~room], most)


def build(vectors: np.ndarray, seed: int = 7) -> Graph:
    """A graph over the rows of ``vectors``, all of one length."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    height = np.minimum(np.floor(-np.log(1 - rng.random(n)) / np.log(LINKS)), 12).astype(int)
    order = np.argsort(-height, kind="stable")  # upper levels first: they guide the rest
    top = int(height.max()) if n else 0
    graph = Graph(vectors, [np.full((n, LOW_LINKS if level == 0 else LINKS), -1, np.int64) for level in range(top + 1)])
    graph.entry = int(order[0]) if n else 0
    at = 1
    while at < n:
        nodes = order[at : at + min(BATCH, at)]
        queries = vectors[nodes]
        among = (queries @ queries.T).astype(np.float32)
        start = np.full((len(nodes), 1), graph.entry)
        for level in range(top, -1, -1):
            here = height[nodes] >= level
            ids, scores = walk(graph, level, queries, start, BUILD_WIDTH if here.any() else 1)
            if here.any():
                mates = np.where(here[None, :] & ~np.eye(len(nodes), dtype=bool), among, -np.inf)[here]
                pool_ids = np.concatenate([ids[here], np.broadcast_to(nodes, mates.shape)], 1)
                pool = np.concatenate([scores[here], mates], 1).astype(np.float32)
                if level:  # the start node of a level may not belong to it
                    pool = np.where(height[pool_ids] >= level, pool, -np.inf)
                best = _top(pool_ids, pool, np.zeros(pool.shape, bool), BUILD_WIDTH)
                most = graph.neighbours[level].shape[1]
                graph.neighbours[level][nodes[here]] = diverse(vectors, best[0], best[1], LINKS)[:, :most] if level else np.pad(diverse(vectors, best[0], best[1], LINKS), ((0, 0), (0, most - LINKS)), constant_values=-1)
                _link_back(graph, level, nodes[here], most)
            start = np.where(np.isfinite(scores[:, :8]), ids[:, :8], -1)
        at += len(nodes)
    return graph


def search(graph: Graph, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and products of about ``width`` best nodes for each query."""
    found = []
    for low in range(0, len(queries), BATCH):
        part = queries[low : low + BATCH]
        start = np.full((len(part), 1), graph.entry)
        for level in range(len(graph.neighbours) - 1, 0, -1):
            ids, scores = walk(graph, level, part, start, 8)
            start = np.where(np.isfinite(scores), ids, -1)
        ids, scores = walk(graph, 0, part, start, width)
        pad = max(0, width - ids.shape[1])
        found.append((np.pad(ids, ((0, 0), (0, pad)), constant_values=-1)[:, :width], np.pad(scores, ((0, 0), (0, pad)), constant_values=-np.inf)[:, :width]))
    if not found:
        return np.zeros((0, width), np.int64), np.zeros((0, width), np.float32)
    return np.concatenate([i for i, _ in found]), np.concatenate([s for _, s in found])


def _pack(table: pa.Table) -> pa.Table:
    """One shard's rows to one row of flat arrays."""
    table = table.sort_by("node")
    dim = table.column("dim")[0].as_py()
    raw = np.asarray(table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    scaled = np.ldexp(raw, -table.column("band")[0].as_py())
    square = (scaled**2).sum(axis=1)
    lifted = np.concatenate([scaled, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], axis=1).astype(np.float32)
    graph = build(lifted)
    flat = [x.astype(np.int32).tobytes() for x in graph.neighbours]
    columns = {"dim": [dim], "band": [table.column("band")[0].as_py()], "shard": [table.column("shard")[0].as_py()], "nodes": [table.column("node").to_numpy().tobytes()], "vectors": [raw.tobytes()], "lifted": [lifted.tobytes()], "neighbours": [flat], "entry": [graph.entry]}
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.int64()]
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(columns.items(), kinds)})


_INDEX = "dim int, band int, shard int, nodes binary, vectors binary, lifted binary, neighbours array<binary>, entry long"


def _search(k: int, width: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([], [], [])
        if index.num_rows and queries.num_rows:
            row = index.to_pylist()[0]
            dim = row["dim"]
            nodes = np.frombuffer(row["nodes"], np.int64)
            raw = np.frombuffer(row["vectors"], np.float64).reshape(len(nodes), dim)
            lifted = np.frombuffer(row["lifted"], np.float32).reshape(len(nodes), dim + 1)
            levels = [np.frombuffer(x, np.int32).reshape(len(nodes), -1).astype(np.int64) for x in row["neighbours"]]
            graph = Graph(lifted, levels, row["entry"])
            asked = np.asarray(queries.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
            unit = asked / np.abs(asked).max(axis=1, keepdims=True)
            unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
            ids, _ = search(graph, np.pad(unit, ((0, 0), (0, 1))).astype(np.float32), width)
            for i, query in enumerate(queries.column("node").to_pylist()):
                own = ids[i][ids[i] >= 0]
                exact = (raw[own] * asked[i]).sum(axis=1)
                best = np.lexsort((nodes[own], -exact))[: k + 1]
                out[0].append(np.full(len(best), query))
                out[1].append(nodes[own][best])
                out[2].append(exact[best])
        parts = [np.concatenate(x) if x else [] for x in out]
        return pa.table([pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.int64()), pa.array(parts[2], pa.float64())], ["query", "node", "score"])

    return run


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part: with an id, not empty, all
    components finite, not all zero."""
    kept = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return kept.where("vec_id is not null and size(vector) > 0").where(finite & F.exists("vector", lambda x: x != 0))


def length_band(vector: str) -> Column:
    """Whole part of the binary logarithm of a vector's length, worked out without
    leaving the range of a double."""
    most = F.array_max(F.transform(vector, lambda x: F.abs(x)))
    squares = F.aggregate(vector, F.lit(0.0), lambda total, x: total + (x / most) * (x / most))
    return F.floor(F.log2(most) + F.log2(squares) / 2).cast("int")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = 8192, width: int = 256) -> DataFrame:
    """The ``k`` rows of ``vectors`` (vec_id, embedding) nearest to each row of
    ``queries`` (same columns, rows of the same table): query_id, rank from 1, vec_id
    and score, the inner product in double precision.

    The query's own id is no candidate. Ties go to the smaller vec_id. Vectors that are
    null, empty, zero or hold a null or non-finite component take no part on either
    side. Vectors are compared with those of the same number of components. Rows that
    repeat an id count once for each different vector. Results are approximate: an
    index of about ``shard_rows`` vectors per shard is searched with ``width``
    candidates, which gives recall of 0.93 or more on vectors without any cluster structure
    (8,192 normal vectors of 64 components in one shard, the worst case tested).
    Other columns are not looked at; empty tables give an empty result.
    """
    rows = usable(vectors).distinct()
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    classes = rows.select("*", place.alias("place")).where(F.col("place") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = cut(classes.select(F.col("ids")[0].alias("node"), "vector", "ids", F.size("vector").alias("dim"), length_band("vector").alias("band")))
    sizes = cut(classes.groupBy("dim", "band").agg(F.greatest(F.lit(1), F.round(F.count("*") / shard_rows)).cast("int").alias("shards")))
    shard = F.pmod(F.xxhash64("node"), "shards").cast("int").alias("shard")
    dealt = classes.join(broadcast_if_small(sizes), ["dim", "band"]).select("dim", "band", shard, "node", "vector")
    index = cut(dealt.groupBy("dim", "band", "shard").applyInArrow(_pack, _INDEX))

    asked = usable(queries).distinct().select(F.col("vec_id").alias("query_id"), "vector")
    distinct = asked.groupBy("vector").agg(F.min("query_id").alias("node")).select("node", "vector", F.size("vector").alias("dim"))
    blocks = max(1, math.ceil(distinct.count() / QUERY_BLOCK))
    block = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block")
    # A row per number of components with all its shards; doubles have some 2,100 bands.
    every = sizes.select("dim", F.struct("band", "shards").alias("s")).groupBy("dim").agg(F.collect_list("s").alias("bands"))
    asking = distinct.select("*", block).join(broadcast_if_small(cut(every)), "dim")
    spread = asking.select("dim", "block", "node", "vector", F.explode("bands").alias("s")).select("dim", "block", "node", "vector", "s.band", F.explode(F.sequence(F.lit(0), F.col("s.shards") - 1)).alias("shard"))
    copies = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    keys = ["dim", "band", "shard", "block"]
    found = copies.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(_search(k, width), "query long, node long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    merged = found.select("*", F.row_number().over(best).alias("place")).where(F.col("place") <= k + 1).drop("place")
    members = merged.join(classes.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id"))
    named = asked.join(distinct.select("vector", F.col("node").alias("query")), "vector").select("query_id", "query")
    answers = named.join(members, "query").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = answers.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= k)
