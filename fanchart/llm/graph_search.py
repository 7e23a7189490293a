"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard.

A shard's distinct vectors become a graph: from random edges, every vector is searched for greedily from the medoid,
and the vectors visited on the way are its candidate neighbours; relaxed pruning keeps the nearest candidate and drops
those that are nearer to it, by the factor alpha, than to the vector, and so on, so that the edges kept are diverse.
Reversed edges are added and pruned alike. A first pass uses alpha 1, a second one ``ALPHA``. Queries walk the graph
with a beam: the ``WIDTH`` nearest unexpanded vectors of a list of ``LIST`` are expanded until none is left.

Largest inner product becomes least distance by one more dimension that brings all vectors of a shard to one length.
Equal vectors are one node that stands for all their ids. Scores are inner products of the original vectors in double
precision. All vectors are indexed; shards and query blocks are bounded, lists per query are merged over the shards.

Defined results: null and zero vectors, vectors with null or non-finite components or of another length than the
longest, and rows without id take no part; candidates with a query's own id are left out; a repeated query is answered
once (of different vectors under one id the least asks), repeated candidate rows are found as often; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanchart.llm.common import table
from fanchart.llm.vectors import blocks, in_blocks, lists, matrix, merged, to_all, usable
from fanchart.sources.materialize import materialized

K = 20
SHARD_ROWS, QUERY_BLOCK = 1024, 1024
DEGREE, ALPHA, BUILD_LIST, LIST, WIDTH = 32, 1.2, 40, 64, 4
#: Candidates of one node that a pruning step looks at, nearest first.
PRUNED = 96
FAR = np.float32(np.inf)


def beam(points: np.ndarray, edges: np.ndarray, starts: np.ndarray, targets: np.ndarray, size: int, width: int, visits: bool = False):
    """(nodes, distances) of the ``size`` nearest found for each target; with ``visits``, also of all expanded nodes.

    ``edges`` is (n, degree) padded with n; ``points`` has a row n that is never near.
    """
    n, m = len(points) - 1, len(targets)
    lines = np.arange(m)[:, None]
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True
    node = np.full((m, size), n, np.int64)
    dist = np.full((m, size), FAR, np.float32)
    open_ = np.zeros((m, size), bool)
    first = np.unique(starts)[:size]
    node[:, : len(first)] = first
    dist[:, : len(first)] = ((points[first][None] - targets[:, None]) ** 2).sum(-1)
    open_[:, : len(first)] = True
    seen[:, first] = True
    gone: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    active = np.arange(m)
    while len(active):
        d = np.where(open_[active], dist[active], FAR)
        pick = np.argpartition(d, min(width, size - 1), axis=1)[:, :width]
        row = lines[: len(active)]
        live = np.isfinite(d[row, pick])
        near = np.where(live, node[active[:, None], pick], n)
        if visits:
            gone.append((active, near, np.where(live, dist[active[:, None], pick], FAR)))
        open_[active[:, None], pick] = False
        fresh = edges[near].reshape(len(active), -1)
        fresh = np.sort(fresh, axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
        fresh[seen[active[:, None], fresh]] = n
        seen[active[:, None], fresh] = True
        r, c = np.nonzero(fresh < n)
        far = np.full(fresh.shape, FAR, np.float32)
        diff = points[fresh[r, c]] - targets[active[r]]
        far[r, c] = np.einsum("ij,ij->i", diff, diff)
        all_node = np.concatenate([node[active], fresh], axis=1)
        all_dist = np.concatenate([dist[active], far], axis=1)
        all_open = np.concatenate([open_[active], np.isfinite(far)], axis=1)
        best = np.argpartition(all_dist, size - 1, axis=1)[:, :size]
        node[active], dist[active], open_[active] = all_node[row, best], all_dist[row, best], all_open[row, best]
        active = active[open_[active].any(axis=1)]
    if not visits:
        return node, dist
    count = np.zeros(m, np.int64)
    for a, near, _ in gone:
        count[a] += near.shape[1]
    vn, vd = np.full((m, count.max(initial=1)), n, np.int64), np.full((m, count.max(initial=1)), FAR, np.float32)
    at = np.zeros(m, np.int64)
    for a, near, d in gone:
        w = at[a][:, None] + np.arange(near.shape[1])
        vn[a[:, None], w], vd[a[:, None], w] = near, d
        at[a] += near.shape[1]
    return vn, vd


def prune(points: np.ndarray, who: np.ndarray, node: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Diverse neighbours of the nodes ``who`` from candidates ``node`` (padded with n): (len(who), degree), padded."""
    n = len(points) - 1
    node = np.sort(np.where(node == who[:, None], n, node), axis=1)
    node[:, 1:][node[:, 1:] == node[:, :-1]] = n
    d = ((points[node] - points[who][:, None]) ** 2).sum(-1)
    d[node == n] = FAR
    order = np.argsort(d, axis=1, kind="stable")[:, :PRUNED]
    node, d = np.take_along_axis(node, order, 1), np.take_along_axis(d, order, 1)
    near = points[node]
    out = np.full((len(who), degree), n, np.int64)
    line = np.arange(len(who))
    for k in range(degree):
        first = np.argmin(d, axis=1)
        live = np.isfinite(d[line, first])
        if not live.any():
            break
        out[live, k] = node[line[live], first[live]]
        to = ((near - near[line, first][:, None]) ** 2).sum(-1)
        d[live[:, None] & (alpha * alpha * to <= d)] = FAR
        d[line, first] = FAR
    return out


def build(points: np.ndarray, degree: int = DEGREE, seed: int = 7, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(edges, starts) of the graph over all rows of ``points`` but the last, which is padding."""
    n = len(points) - 1
    rng = np.random.default_rng(seed)
    degree = max(1, min(degree, n - 1))
    edges = rng.integers(0, n, (n + 1, degree))
    edges[n] = n
    middle = points[:n].mean(axis=0)
    starts = np.array([np.argmin(((points[:n] - middle) ** 2).sum(-1))])
    for alpha in (1.0, ALPHA):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            who = order[i : i + batch]
            node, _ = beam(points, edges, starts, points[who], min(BUILD_LIST, n), WIDTH, visits=True)
            edges[who] = prune(points, who, np.concatenate([node, edges[who]], axis=1), alpha, degree)
            back = edges[who]
            src, dst = np.repeat(who, degree), back.ravel()
            src, dst = src[dst < n], dst[dst < n]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            own, start, count = np.unique(dst, return_index=True, return_counts=True)
            extra = np.full((len(own), count.max(initial=1)), n, np.int64)
            extra[np.repeat(np.arange(len(own)), count), np.arange(len(dst)) - np.repeat(start, count)] = src
            edges[own] = prune(points, own, np.concatenate([edges[own], extra], axis=1), alpha, degree)
    return edges, starts


def lengthened(x: np.ndarray) -> np.ndarray:
    """Rows with one more component so that all have one length, and a padding row far away."""
    square = (x * x).sum(axis=1)
    last = np.sqrt(np.maximum(square.max(initial=0) - square, 0))
    out = np.concatenate([x, last[:, None]], axis=1)
    scale = np.sqrt(square.max(initial=0)) or 1.0
    return np.concatenate([out / scale, np.full((1, out.shape[1]), 1e6)]).astype(np.float32)


GRAPH = "shard long, ids binary, vectors binary, edges binary, starts binary"


def _build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """A shard's graph over its distinct vectors; ids of equal vectors stand together, smallest first."""
    x, ids = matrix(rows["embedding"], np.float64), rows["vec_id"].to_numpy()
    order = np.lexsort((ids, *x.T[::-1]))
    x, ids = x[order], ids[order]
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]).any(axis=1)
    edges, starts = build(lengthened(x[first]))
    row = {"shard": key[0].as_py(), "ids": ids.tobytes(), "vectors": x.tobytes(), "edges": edges.astype(np.int32).tobytes(), "starts": starts.tobytes()}
    return pa.table({k: [v] for k, v in row.items()})


def search_shard(x: np.ndarray, ids: np.ndarray, edges: np.ndarray, starts: np.ndarray, q: np.ndarray, k: int):
    """(query number, vec_id, score) of the nearest found, more than k per query where vectors are equal."""
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]).any(axis=1)
    distinct, start = x[first], np.append(np.flatnonzero(first), len(x))
    size = np.sqrt((distinct * distinct).sum(axis=1).max()) or 1.0
    target = np.concatenate([q / size, np.zeros((len(q), 1))], axis=1).astype(np.float32)
    node, _ = beam(lengthened(distinct), edges, starts, target, min(max(LIST, k + 1), len(distinct)), WIDTH)
    r, c = np.nonzero(node < len(distinct))
    hit = node[r, c]
    # a node's smallest ids stand for all that could be among the k best, besides the rows of the query's own id
    own = int(np.unique(ids, return_counts=True)[1].max())
    count = np.minimum(start[hit + 1] - start[hit], k + own)
    r, row = np.repeat(r, count), np.repeat(start[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return r, ids[row], np.einsum("ij,ij->i", q[r], x[row])


def _search(key: tuple[pa.Scalar, ...], graphs: pa.Table, queries: pa.Table) -> pa.Table:
    if not graphs.num_rows or not queries.num_rows:
        return pa.table({"query_id": pa.array([], pa.int64()), "shard": pa.array([], pa.int64()), "best": pa.array([], pa.list_(pa.struct([("low", pa.float64()), ("vec_id", pa.int64())])))})
    g = {c: graphs[c][0].as_py() for c in ("ids", "vectors", "edges", "starts")}
    ids, starts = np.frombuffer(g["ids"], np.int64), np.frombuffer(g["starts"], np.int64)
    x = np.frombuffer(g["vectors"], np.float64).reshape(len(ids), -1)
    distinct = 1 + int((x[1:] != x[:-1]).any(axis=1).sum())
    edges = np.frombuffer(g["edges"], np.int32).reshape(distinct + 1, -1).astype(np.int64)
    query_ids = queries["vec_id"].to_numpy()
    r, vec, score = search_shard(x, ids, edges, starts, matrix(queries["embedding"], np.float64), K)
    other = vec != query_ids[r]
    return lists(r[other], vec[other], -score[other], query_ids, key[0].as_py(), K, np.float64)


def neighbours(vectors: DataFrame, every: int) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score; queries are the ids divisible by ``every``."""
    v = materialized(usable(vectors, nonzero=True), "graph-vectors")
    asked = materialized(v.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "graph-queries")
    shards, parts = blocks(v, SHARD_ROWS), blocks(asked, QUERY_BLOCK)
    graphs = materialized(in_blocks(v, "shard", shards).groupBy("shard").applyInArrow(_build, GRAPH), "graphs")
    left = to_all(graphs, "part", parts).groupBy("shard", "part")
    right = to_all(in_blocks(asked, "part", parts), "shard", shards).groupBy("shard", "part")
    found = left.cogroup(right).applyInArrow(_search, "query_id long, shard long, best array<struct<low:double,vec_id:long>>")
    return merged(found, K, shards, "double")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), 20)
