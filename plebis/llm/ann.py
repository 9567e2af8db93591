"""Operator 2: approximate nearest neighbours.

Vectors are dealt by hash into shards of bounded size.  Each shard becomes a
directed graph: a greedy search over what is linked so far proposes neighbours
for a new vector, and pruning with a relaxed distance keeps those that no kept
neighbour is much nearer to, so that edges point in many directions; the reverse
edges are added and pruned alike.  A beam search then walks each shard's graph
for every query, in blocks of queries, and the shards' finds are merged.

Graphs are built and walked in numpy, many vectors in step; a shard's graph is
one row of a few MB whatever the corpus, and a task holds one shard and one block
of queries.

Equal vectors are one node that knows its smallest ids, as many as any query can
need, so a vector with a third of all rows is no hot spot.  What is found is
scored anew in double precision on the original vectors.

Defined results.  Vectors that are null, of length zero, or hold null or
non-finite numbers take no part.  Vectors of another length than the most
frequent one take no part either.  Ties go to the smaller id.  With fewer
candidates than asked for, all are returned.  Rows with a null id take no part.
Repeated rows count once each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plebis.llm.common import durable, table

SHARD, DEGREE, BEAM, SEARCH_BEAM, ALPHA, BLOCK = 4096, 28, 48, 96, 1.2, 512


def unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Walks for many queries in step: at each step every query opens its nearest
    node that is not open yet.  Returns the beams (nodes, distances), nearest
    first; -1 and infinity where a beam is not full."""
    n, m = len(x), len(queries)
    nodes = np.full((m, beam), -1)
    dist = np.full((m, beam), np.inf, np.float32)
    opened = np.ones((m, beam), bool)
    nodes[:, 0], opened[:, 0] = entry, False
    dist[:, 0] = 2 - 2 * (queries @ x[entry])
    seen = np.zeros((m, n), bool)
    seen[:, entry] = True
    live = np.arange(m)
    while len(live):
        here = np.where(opened[live], np.inf, dist[live])
        pick = here.argmin(axis=1)
        going = np.isfinite(here[np.arange(len(live)), pick])
        live, pick = live[going], pick[going]
        if not len(live):
            break
        opened[live, pick] = True
        near = graph[nodes[live, pick]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], np.where(near >= 0, near, entry)] = True
        d = 2 - 2 * np.einsum("qkd,qd->qk", x[near], queries[live])
        d = np.where(fresh, d, np.inf).astype(np.float32)
        all_nodes = np.concatenate([nodes[live], np.where(fresh, near, -1)], axis=1)
        all_dist = np.concatenate([dist[live], d], axis=1)
        all_open = np.concatenate([opened[live], ~fresh], axis=1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        nodes[live] = np.take_along_axis(all_nodes, order, axis=1)
        dist[live] = np.take_along_axis(all_dist, order, axis=1)
        opened[live] = np.take_along_axis(all_open, order, axis=1)
    return nodes, dist


def prune(x: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each vector, of its candidates (-1: none) at most ``degree``: the
    nearest is kept and strikes out all that it is nearer to, by the factor
    alpha, than the vector is; then the nearest of the rest, and so on."""
    m = len(own)
    valid = (candidates >= 0) & (candidates != own[:, None])
    d = np.where(valid, 2 - 2 * np.einsum("qkd,qd->qk", x[candidates], x[own]), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    candidates, d = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(d, order, axis=1)
    same = np.sort(candidates, axis=1)
    if (same[:, 1:] == same[:, :-1]).any():  # a candidate counts once
        first = np.argsort(candidates, axis=1, kind="stable")
        ranked = np.take_along_axis(candidates, first, axis=1)
        repeat = np.zeros_like(ranked, bool)
        repeat[:, 1:] = ranked[:, 1:] == ranked[:, :-1]
        np.put_along_axis(d, first, np.where(repeat, np.inf, np.take_along_axis(d, first, axis=1)), axis=1)
    vectors = x[candidates]
    alive = np.isfinite(d)
    kept = np.full((m, degree), -1)
    at = np.arange(m)
    for k in range(degree):
        best = np.where(alive, d, np.inf).argmin(axis=1)
        some = alive[at, best]
        if not some.any():
            break
        kept[some, k] = candidates[at, best][some]
        between = np.maximum(0, 2 - 2 * np.einsum("qkd,qd->qk", vectors, vectors[at, best]))
        alive &= ~(some[:, None] & (alpha * between <= d))
        alive[at, best] = False
    return kept


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 2) -> tuple[np.ndarray, int]:
    """The pruned graph of unit vectors and the node where searches begin."""
    n = len(x)
    graph = np.full((n, degree), -1)
    entry = int((x @ x.mean(axis=0)).argmax())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    done = 1
    while done < n:
        batch = order[done : done + min(max(16, done // 2), 512)]
        found, _ = beam_search(x, graph, entry, x[batch], beam)
        # Those added together do not see each other in the graph yet.
        mates = np.argsort(-(x[batch] @ x[batch].T), axis=1)[:, : min(len(batch), 9)]
        graph[batch] = prune(x, batch, np.concatenate([found, batch[mates]], axis=1), degree, alpha)
        sources, targets = np.repeat(batch, degree), graph[batch].ravel()
        sources, targets = sources[targets >= 0], targets[targets >= 0]
        by_target = np.argsort(targets, kind="stable")
        targets, sources = targets[by_target], sources[by_target]
        receivers, starts = np.unique(targets, return_index=True)
        ends = np.append(starts[1:], len(targets))
        width = int((ends - starts).max())
        for low in range(0, len(receivers), 256):
            part = slice(low, low + 256)
            more = np.full((len(receivers[part]), width), -1)
            for r, (a, b) in enumerate(zip(starts[part], ends[part], strict=True)):
                more[r, : b - a] = sources[a:b]
            own = graph[receivers[part]]
            more[(more[:, :, None] == own[:, None, :]).any(axis=2)] = -1  # linked already
            both = np.concatenate([own, more], axis=1)
            room = (both >= 0).sum(axis=1) <= degree
            kept = prune(x, receivers[part], both, degree, alpha)
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)[:, :degree]
            graph[receivers[part]] = np.where(room[:, None], packed, kept)
        done += len(batch)
    return bridged(x, graph, entry).astype(np.int32), entry


def bridged(x: np.ndarray, graph: np.ndarray, entry: int) -> np.ndarray:
    """The graph with more edges, so that every node can be reached: pruning may
    leave outliers without an edge towards them."""
    while True:
        reached = np.zeros(len(x), bool)
        reached[entry] = True
        front = np.array([entry])
        while len(front):
            front = np.unique(graph[front])
            front = front[(front >= 0) & ~reached[front]]
            reached[front] = True
        lost, known = np.flatnonzero(~reached), np.flatnonzero(reached)
        if not len(lost):
            return graph
        lost = lost[:256]
        nearest = known[(x[lost] @ x[known].T).argmax(axis=1)]
        nearest, first = np.unique(nearest, return_index=True)
        more = np.full((len(x), 1), -1)
        more[nearest, 0] = lost[first]
        graph = np.concatenate([graph, more], axis=1)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (id, v) that take part, v as array<double>."""
    v = F.transform(vectors[vector], lambda e: e.cast("double"))
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda a, e: a + e * e)
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.select(vectors[key].cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows = rows.where(fine).where((size(F.col("v")) > 0) & (size(F.col("v")) < F.lit(float("inf"))))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    return rows.join(F.broadcast(lengths.select("d")), F.size("v") == F.col("d")).select("id", "v")


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """One row (v, ids) a distinct vector with its k + 1 smallest ids, found first
    within slices of each vector's rows."""
    slice_ = F.pmod(F.xxhash64("id"), F.lit(64))
    part = Window.partitionBy("h", "v", slice_).orderBy("id")
    whole = Window.partitionBy("h", "v").orderBy("id")
    least = (
        rows.withColumn("h", F.xxhash64("v"))
        .withColumn("nth", F.row_number().over(part))
        .where(F.col("nth") <= k + 1)
        .withColumn("nth", F.row_number().over(whole))
        .where(F.col("nth") <= k + 1)
    )
    return least.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("v", "ids")


def index(nodes: DataFrame, n_shards: int) -> DataFrame:
    """One row a shard: its vectors, their ids and its graph, packed."""
    shard = F.pmod(F.xxhash64(F.lit(5), F.col("ids")[0]), F.lit(n_shards)).cast("int")

    def pack(table_: pa.Table) -> pa.Table:
        n = table_.num_rows
        table_ = table_.take(pa.array(np.argsort([i[0] for i in table_.column("ids").to_pylist()], kind="stable")))
        x = np.array(table_.column("v").to_pylist(), np.float64).reshape(n, -1)
        graph, entry = build(unit(x))
        ids = table_.column("ids").to_pylist()
        return pa.table(
            {
                "shard": table_.column("shard").slice(0, 1),
                "entry": pa.array([entry], pa.int32()),
                "x": pa.array([x.tobytes()], pa.binary()),
                "graph": pa.array([graph.tobytes()], pa.binary()),
                "ids": pa.array([ids], pa.list_(pa.list_(pa.int64()))),
            }
        )

    return (
        nodes.select(shard.alias("shard"), "v", "ids")
        .groupBy("shard")
        .applyInArrow(pack, "shard int, entry int, x binary, graph binary, ids array<array<long>>")
    )


def search(shards: DataFrame, queries: DataFrame, n_shards: int, n_blocks: int, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """queries (id, v) against every shard: rows (query_id, vec_id, score), up to
    k a query and shard."""
    blocks = (
        queries.groupBy(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(n_blocks)).alias("block"))
        .agg(F.collect_list(F.struct("id", "v")).alias("queries"))
        .select("queries", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"))
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                asked, entry, raw, edges, ids = (batch.column(c)[row].as_py() for c in range(5))
                ids_of = ids
                n = len(ids_of)
                x = np.frombuffer(raw, np.float64).reshape(n, -1)
                graph = np.frombuffer(edges, np.int32).reshape(n, -1).astype(np.int64)
                q_ids = [a["id"] for a in asked]
                q = np.array([a["v"] for a in asked], np.float64)
                found, _ = beam_search(unit(x), graph, entry, unit(q), min(beam, max(n, 1)))
                x_norm, q_norm = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
                out: tuple[list, list, list] = ([], [], [])
                for i, nodes in enumerate(found):
                    nodes = nodes[nodes >= 0]
                    scores = (x[nodes] * q[i]).sum(axis=1) / (x_norm[nodes] * q_norm[i])
                    best = sorted((-s, v) for s, node in zip(scores.tolist(), nodes.tolist(), strict=True) for v in ids_of[node] if v != q_ids[i])
                    for s, v in best[:k]:
                        out[0].append(q_ids[i])
                        out[1].append(v)
                        out[2].append(-s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())],
                    names=["query_id", "vec_id", "score"],
                )

    # By merge: neither side may be broadcast, as the blocks are as many times larger than the
    # queries, which an estimate goes by, as there are shards.
    return (
        shards.hint("merge").join(blocks, "shard")
        .select("queries", "entry", "x", "graph", "ids")
        .mapInArrow(walk, "query_id long, vec_id long, score double")
    )


def nearest(vectors: DataFrame, asked: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For rows that fulfil ``asked`` (a condition on the column id) the k nearest
    others: query_id, rank, vec_id, score (cosine)."""
    rows = usable(vectors, key, vector).distinct().transform(durable)
    nodes = distinct_vectors(rows, k).transform(durable)
    n_shards = max(1, math.ceil(nodes.count() / SHARD))
    queries = rows.where(asked)
    n_blocks = max(1, math.ceil(queries.count() / BLOCK))
    found = search(index(nodes, n_shards), queries, n_shards, n_blocks, k)
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def op2_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
