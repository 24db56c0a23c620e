"""Approximate nearest neighbours by inner product: an HNSW graph for each shard, shard results merged.

Vectors of one length are dealt to shards of at most SHARD_ROWS distinct vectors (fewer of
very long ones, SHARD_BYTES). A shard's graph is built by insertion, layer by layer from
the top: a node's level comes from a hash of its id; a batch of nodes, never larger than
what is in the layer, descends through the finished layers and searches its own with a
beam; the beam's nodes and the batch's own are thinned by the diversity rule to DEGREE
links, reverse links are added, and lists that grow too long are thinned by the same rule.
Graphs are flat arrays: level 0 has 32 neighbours a node, each upper level 16. For inner
products a coordinate is added that makes all vectors of a shard equally long, so that
near means large product.

A search goes down the levels with a beam for many queries at once. Every shard is
searched for every query of its length; a graph is sent once for QUERY_ROWS queries.
Results are merged by exact products in double precision.

Equal vectors are one node: its copies (at most k + 1, the least ids) come back in the
merge, which is exact because ties go to the lesser id.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
take no part. Vectors of different lengths have no product: each length is an index of its
own, and a query finds candidates of its length. With fewer candidates than k all are
returned. An empty table gives no rows. Of repeated ids with equal vectors one counts.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import ODD, mix
from .skew import salted_join
from .staging import Staging

SHARD_ROWS = 8192
SHARD_BYTES = 64 << 20
QUERY_ROWS = 32_768
QUERY_BYTES = 32 << 20
TOGETHER = 1024
DEGREE = 16
BUILD_BEAM = 40
BEAM = 128
UPPER_BEAM = 8
EXPAND = 4
CHUNK = 256


def _diverse(near: np.ndarray, sims: np.ndarray, v: np.ndarray, degree: int) -> np.ndarray:
    """For each row of candidates, nearest first (-1: none), up to `degree` that are nearer to the row's node than to any one chosen; then the nearest of the rest."""
    out = np.full((len(near), degree), -1, np.int32)
    for a in range(0, len(near), CHUNK):
        ids, s = near[a : a + CHUNK], sims[a : a + CHUNK]
        rows, width = ids.shape
        x = v[ids]  # -1 takes some vector; it is never chosen
        between = np.einsum("rid,rjd->rij", x, x, optimize=True)
        chosen = np.zeros((rows, width), bool)
        n = np.zeros(rows, np.int64)
        for j in range(width):
            rival = np.where(chosen, between[:, j, :], -np.inf).max(axis=1)
            take = (ids[:, j] >= 0) & (n < degree) & (s[:, j] > rival)
            chosen[take, j] = True
            n += take
        order = np.argsort(np.where(ids >= 0, np.where(chosen, 0, 1), 2) * width + np.arange(width), axis=1)[:, :degree]
        out[a : a + CHUNK, : order.shape[1]] = np.take_along_axis(ids, order, axis=1)
    return out


def _beam(q: np.ndarray, v: np.ndarray, graph: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The best `beam` nodes found for each query, from start nodes (-1: none), nearest first; EXPAND nodes are opened at a step."""
    n_q, width = len(q), min(beam, start.shape[1])
    rows_of = np.arange(n_q)[:, None]
    seen = np.zeros((n_q, len(v) + 1), bool)  # the last place is for -1
    seen[:, -1] = True
    ids = np.full((n_q, beam), -1, np.int32)
    sims = np.full((n_q, beam), -np.inf, np.float32)
    ids[:, :width] = start[:, :width]
    sims[:, :width] = np.where(ids[:, :width] >= 0, np.einsum("qwd,qd->qw", v[ids[:, :width]], q), -np.inf)
    seen[rows_of, ids] = True
    done = ids < 0
    live = np.flatnonzero(~done.all(axis=1))
    while len(live):
        at = rows_of[: len(live)]
        best = np.argpartition(np.where(done[live], np.inf, -sims[live]), EXPAND - 1, axis=1)[:, :EXPAND]
        opened = ~done[live[:, None], best]
        done[live[:, None], best] = True
        near = graph[ids[live[:, None], best]]
        near = np.where(opened[:, :, None], near, -1).reshape(len(live), -1)
        near[seen[live[:, None], near]] = -1
        near.sort(axis=1)  # the same node from two lists counts once
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near = -np.sort(-near, axis=1)
        near = near[:, : max(1, int((near >= 0).sum(axis=1).max()))]
        fresh = near >= 0
        seen[live[:, None], near] = True
        r, c = np.nonzero(fresh)
        got = np.full(near.shape, -np.inf, np.float32)
        got[r, c] = np.einsum("ed,ed->e", v[near[r, c]], q[live[r]])
        all_sims = np.concatenate([sims[live], got], axis=1)
        order = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        sims[live] = all_sims[at, order]
        ids[live] = np.concatenate([ids[live], near], axis=1)[at, order]
        done[live] = np.concatenate([done[live], ~fresh], axis=1)[at, order]
        live = live[~done[live].all(axis=1)]
    order = np.argsort(-sims, axis=1, kind="stable")
    return ids[rows_of, order], sims[rows_of, order]


def _descend(q: np.ndarray, v: np.ndarray, layers: list[np.ndarray], entry: np.ndarray) -> np.ndarray:
    """Start nodes for the layer below `layers` (from the top)."""
    start = np.repeat(entry[None, :UPPER_BEAM].astype(np.int32), len(q), axis=0)
    for graph in layers:
        start, _ = _beam(q, v, graph, start, UPPER_BEAM)
    return start


def _insert(v: np.ndarray, nodes: np.ndarray, degree: int, upper: list[np.ndarray], entry: np.ndarray) -> np.ndarray:
    """A layer's neighbour lists (for all of v, -1 for none), its nodes inserted in batches in the order given."""
    graph = np.full((len(v), degree), -1, np.int32)
    used = np.zeros(len(v), np.int64)
    links, n = max(degree // 2, 1), 0
    while n < len(nodes):
        batch = nodes[n : n + min(TOGETHER, max(n, 32))]
        own = v[batch] @ v[batch].T
        np.fill_diagonal(own, -np.inf)
        k = min(BUILD_BEAM, len(batch) - 1)
        top = np.argpartition(-own, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(batch), 0), int)
        ids, sims = batch[top].astype(np.int32), np.take_along_axis(own, top, axis=1)
        if n:
            start = _descend(v[batch], v, upper, entry)
            if not upper:
                start = np.repeat(nodes[None, : min(n, UPPER_BEAM)], len(batch), axis=0).astype(np.int32)
            found, near = _beam(v[batch], v, graph, start, BUILD_BEAM)
            ids, sims = np.concatenate([found, ids], axis=1), np.concatenate([near, sims], axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        chosen = _diverse(np.where(np.isfinite(sims), ids, -1), sims, v, links)
        source, target = np.repeat(batch, chosen.shape[1]), chosen.ravel()
        have = target >= 0
        source, target = source[have], target[have]
        graph[batch, : chosen.shape[1]] = chosen
        used[batch] = (chosen >= 0).sum(axis=1)
        _link_back(graph, used, v, target, source)
        n += len(batch)
    return graph


def _link_back(graph: np.ndarray, used: np.ndarray, v: np.ndarray, target: np.ndarray, source: np.ndarray) -> None:
    """source joins target's list; a list that would overflow is thinned with what comes."""
    degree = graph.shape[1]
    there = (graph[target] == source[:, None]).any(axis=1)
    target, source = target[~there], source[~there]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    place = np.arange(len(target)) - np.searchsorted(target, target) + used[target]
    fits = place < degree
    graph[target[fits], place[fits]] = source[fits]
    over = np.unique(target[~fits])
    if len(over):
        row = np.searchsorted(over, target[~fits])
        extra = place[~fits] - degree
        wide = np.full((len(over), degree + int(extra.max()) + 1), -1, np.int32)
        wide[:, :degree] = graph[over]
        wide[row, degree + extra] = source[~fits]
        sims = np.concatenate([np.where(w >= 0, np.einsum("rwd,rd->rw", v[w], v[o]), -np.inf) for w, o in ((wide[k : k + CHUNK], over[k : k + CHUNK]) for k in range(0, len(over), CHUNK))])
        rank = np.argsort(-sims, axis=1, kind="stable")[:, : degree + degree // 2]
        graph[over] = _diverse(np.take_along_axis(wide, rank, axis=1), np.take_along_axis(sims, rank, axis=1), v, degree)
    used[target] = (graph[target] >= 0).sum(axis=1)


def build(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    """A shard's graph and vectors as one blob."""
    v = vectors.astype(np.float32)
    long = (v * v).sum(axis=1)
    v = np.concatenate([v, np.sqrt(np.maximum(long.max() - long, 0))[:, None]], axis=1) / np.sqrt(long.max())
    u = (mix(ids.astype(np.uint64) * ODD) >> np.uint64(11)).astype(np.float64) / 2.0**53
    level = np.minimum((-np.log(np.maximum(u, 2.0**-53)) / np.log(DEGREE)).astype(int), 12)
    order = np.argsort(-level, kind="stable")  # nodes of upper layers come first in lower ones
    entry, layers = order[:UPPER_BEAM], []
    parts = {"ids": ids, "vectors": vectors.astype(np.float64), "entry": entry.astype(np.int32), "top": level.max(keepdims=True)}
    for k in range(int(level.max()), -1, -1):
        nodes = order[: int((level >= k).sum())]
        graph = _insert(v, nodes, DEGREE if k else 2 * DEGREE, layers, entry)
        layers.append(graph)
        parts[f"nodes_{k}"], parts[f"layer_{k}"] = nodes.astype(np.int32), graph[nodes]
    raw = io.BytesIO()
    np.savez(raw, **parts)
    return raw.getvalue()


class Graph:
    def __init__(self, blob: bytes):
        parts = np.load(io.BytesIO(blob))
        self.ids, self.vectors, self.entry = parts["ids"], parts["vectors"], parts["entry"]
        self.v, self.layers = self.vectors.astype(np.float32), []
        for k in range(int(parts["top"][0]), -1, -1):
            layer = parts[f"layer_{k}"]
            graph = np.full((len(self.v), layer.shape[1]), -1, np.int32)
            graph[parts[f"nodes_{k}"]] = layer
            self.layers.append(graph)

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, inner product in doubles) of up to k nodes for each query."""
        out = []
        for a in range(0, len(queries), TOGETHER):
            exact_q = queries[a : a + TOGETHER]
            q = exact_q.astype(np.float32)
            found, _ = _beam(q, self.v, self.layers[-1], _descend(q, self.v, self.layers[:-1], self.entry), max(BEAM, k))
            found = found[:, : k + 4]  # a few more, since singles may round
            rows, cols = np.nonzero(found >= 0)
            nodes = found[rows, cols]
            exact = (self.vectors[nodes] * exact_q[rows]).sum(axis=1)
            rank = np.lexsort((self.ids[nodes], -exact, rows))
            rows, nodes, exact = rows[rank], nodes[rank], exact[rank]
            keep = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(q)))[rows] < k
            out.append((rows[keep] + a, self.ids[nodes[keep]], exact[keep]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def nearest(df: DataFrame, is_query: str = "vec_id % 20 = 0", k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows where the SQL condition `is_query` (over vec_id) holds, against all rows."""
    spark = df.sparkSession
    staging = Staging(spark, "hnsw")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    rows = rows.distinct().withColumn("dims", F.size("v").cast("long"))
    classes = staging.table(rows.groupBy("v", "dims").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    # one search for each distinct query vector
    asked = rows.where(is_query)
    queries = staging.table(asked.groupBy("v", "dims").agg(F.min("vec_id").alias("query")), "queries")
    # one row a length: how many shards it has, and how many groups of queries
    most = F.least(F.lit(shard_rows), F.greatest(F.lit(256), F.floor(SHARD_BYTES / (8 * F.col("dims")))))
    each = F.least(F.lit(QUERY_ROWS), F.greatest(F.lit(256), F.floor(QUERY_BYTES / (8 * F.col("dims")))))
    sizes = classes.groupBy("dims").agg(F.ceil(F.count("*") / most).alias("shards")).join(queries.groupBy("dims").agg(F.ceil(F.count("*") / each).alias("groups")), "dims")
    sizes = staging.table(sizes, "sizes")

    def make(table: pa.Table) -> pa.Table:
        order = table.column("rep").to_numpy().argsort()
        ids = table.column("rep").to_numpy()[order]
        return pa.table({"dims": table.column("dims")[:1], "shard": table.column("shard")[:1], "blob": pa.array([build(ids, _matrix(table.column("v"))[order])], pa.binary())})

    placed = salted_join(classes, sizes, ["dims"]).select("dims", F.pmod(F.xxhash64("rep"), F.col("shards")).alias("shard"), "rep", "v")
    index = staging.table(placed.groupBy("dims", "shard").applyInArrow(make, "dims long, shard long, blob binary"), "index")

    def until(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    dealt = salted_join(queries, sizes, ["dims"]).select("dims", "query", "v", F.pmod(F.xxhash64("query"), F.col("groups")).alias("part"), until("shards").alias("shard"))
    copies = index.join(sizes, "dims").select("dims", "shard", "blob", until("groups").alias("part"))

    def find(graph: pa.Table, some: pa.Table) -> pa.Table:
        if not graph.num_rows or not some.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        row, ids, exact = Graph(graph.column("blob")[0].as_py()).search(_matrix(some.column("v")), k + 1)
        return pa.table({"query": some.column("query").to_numpy()[row], "rep": ids, "score": exact})

    found = copies.groupBy("dims", "shard", "part").cogroup(dealt.groupBy("dims", "shard", "part")).applyInArrow(find, "query long, rep long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    merged = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).drop("_r")
    # copies of found vectors: the k + 1 least ids of each
    many = classes.where("n > 1").select("rep", F.col("v").alias("_v"))
    least = Window.partitionBy("rep").orderBy("vec_id")
    members = rows.join(many, F.col("v") == F.col("_v")).select("rep", "vec_id").withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= k + 1)
    members = members.groupBy("rep").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    wide = merged.join(members, "rep", "left").select("query", "score", F.explode(F.coalesce("ids", F.array("rep"))).alias("vec_id"))
    mine = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = wide.withColumn("_r", F.row_number().over(mine)).where(F.col("_r") <= k + 1).select("query", "vec_id", "score")
    askers = asked.join(queries.withColumnRenamed("v", "_v"), F.col("v") == F.col("_v")).select(F.col("vec_id").alias("query_id"), "query")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = askers.join(lists, "query").where("vec_id <> query_id").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
