"""What the vector searches share: usable vectors, shards, blocks of queries, merging of shards' results."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, nonzero: bool = False) -> DataFrame:
    """(vec_id, embedding as doubles): rows with an id whose vector has the table's dimension and finite components only."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & e.isNotNull() & fine & (F.size(e) > 0))
    if nonzero:
        v = v.where(F.exists(e, lambda x: x != 0))
    dim = v.agg(F.max(F.size(e))).first()[0] or 0
    return v.where(F.size(e) == dim).select("vec_id", e.cast("array<double>").alias("embedding"))


def blocks(rows: DataFrame, size: int) -> int:
    """Blocks of about ``size`` rows."""
    return max(1, math.ceil(rows.count() / size))


def in_blocks(rows: DataFrame, name: str, n: int) -> DataFrame:
    return rows.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(n)))


def to_all(rows: DataFrame, name: str, n: int) -> DataFrame:
    """Every row to each of ``n`` blocks: shards meet all blocks of the stated queries."""
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def matrix(column: pa.ChunkedArray, kind) -> np.ndarray:
    c = column.combine_chunks()
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1).astype(kind)


def merged(found: DataFrame, k: int, shards: int, score: str) -> DataFrame:
    """(query_id, shard, best: array of (low = -score, vec_id)) -> query_id, rank, vec_id, score: the k best per query.

    Lists are merged in two steps of about sqrt(shards) lists each.
    """
    fold = max(1, math.isqrt(shards))
    best = F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best")
    half = found.groupBy("query_id", F.pmod("shard", F.lit(fold)).alias("fold")).agg(best)
    whole = half.groupBy("query_id").agg(best)
    out = whole.select("query_id", F.posexplode("best").alias("i", "hit"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.low")).cast(score).alias("score"))


def lists(query: np.ndarray, vec: np.ndarray, low: np.ndarray, ids: np.ndarray, shard: int, k: int, kind) -> pa.Table:
    """One row per query with its k best (low, vec_id) of this shard; ``query`` numbers rows of ``ids``."""
    order = np.lexsort((vec, low, query))
    query, vec, low = query[order], vec[order], low[order]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    query, vec, low = query[keep], vec[keep], low[keep]
    own, start = np.unique(query, return_index=True)
    offsets = pa.array(np.append(start, len(query)).astype(np.int32))
    best = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(low.astype(kind)), pa.array(vec)], ["low", "vec_id"]))
    return pa.table({"query_id": ids[own], "shard": np.full(len(own), shard, np.int64), "best": best})
