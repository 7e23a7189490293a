"""Exact top-k inner products over a bit-sliced index.

A shard's quantised attributes are bitmaps over its rows, one per attribute and bit. For a block of queries, the
products with the queries' components are sums of attribute slices: each slice, complemented where the component is
negative and masked where the component's bit is 0, enters a carry-save adder at its weight. The sum is again a list
of slices. From the most significant slice downward the rows are narrowed to the k-th largest sum; a bit-sliced
comparison then takes all rows that may reach it. The lowest ``DROP`` attribute bits stay out of the slices, so the
rows near the boundary are resolved on the exact integers, ties by id.

Shards and query blocks are bounded; lists of k per query are merged over the shards.

Defined results: vectors that are null, hold null or non-finite components, lack an id or have another length than the
longest take no part; candidates with a query's own id are left out, so repeated rows of a query are not its answers;
a repeated query is answered once (of different vectors under one id the least asks), repeated
candidate rows are found as often; an empty table gives no rows. Components are exact up to |256 x| < 2**26.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanchart.llm.common import table
from fanchart.llm.vectors import blocks, in_blocks, lists, matrix, merged, to_all, usable
from fanchart.sources.materialize import materialized

K, SCALE, DROP = 5, 256, 2
SHARD_ROWS, QUERY_BLOCK = 1024, 256


def bitmap(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words."""
    words = -(-flags.shape[-1] // 64)
    packed = np.zeros((*flags.shape[:-1], words * 8), np.uint8)
    bits = np.packbits(flags, axis=-1, bitorder="little")
    packed[..., : bits.shape[-1]] = bits
    return packed.view(np.uint64)


class Adder:
    """Sums bitmaps by weight; at most two wait at each weight."""

    def __init__(self):
        self.wait: list[list[np.ndarray]] = []

    def add(self, x: np.ndarray, weight: int) -> None:
        while True:
            while len(self.wait) <= weight:
                self.wait.append([])
            here = self.wait[weight]
            if len(here) < 2:
                here.append(x)
                return
            a, b = here
            odd = a ^ b
            carry = (a & b) | (odd & x)
            here[:] = [odd ^ x]
            x, weight = carry, weight + 1

    def slices(self, like: np.ndarray) -> list[np.ndarray]:
        """The sum's bits, least first."""
        out, weight = [], 0
        while weight < len(self.wait):
            here = self.wait[weight]
            if len(here) == 2:
                a, b = here
                here[:] = [a ^ b]
                self.add(a & b, weight + 1)
            out.append(here[0] if here else np.zeros_like(like))
            weight += 1
        return out


def approximate(queries: np.ndarray, rows: np.ndarray, drop: int, like: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Slices of a lower estimate of every sum (up to a constant per query) and, per query, how far it may lie below."""
    low = rows.min(axis=0)
    coarse = (rows - low) >> drop
    bits = [int(m).bit_length() for m in coarse.max(axis=0)]
    size, negative, adder = np.abs(queries), queries < 0, Adder()
    full = ~np.uint64(0)
    for d in range(rows.shape[1]):
        sign = np.where(negative[:, d], full, np.uint64(0))[:, None]
        digits = [(w, np.where((size[:, d] >> w) & 1, full, np.uint64(0))[:, None]) for w in range(int(size[:, d].max()).bit_length())]
        digits = [(w, m) for w, m in digits if m.any()]
        for j in range(bits[d]):
            column = bitmap((coarse[:, d] >> j & 1).astype(bool))[None, :] ^ sign
            for w, mask in digits:
                adder.add(column & mask, w + j)
    # |q| times the dropped part of an attribute: below 2**drop for each unit
    slack = -(-size.sum(axis=1) * ((1 << drop) - 1) // (1 << drop))
    return adder.slices(like), slack


def kth_largest(slices: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """Per query the k-th largest sum among the given rows (0 if there are fewer)."""
    sure, tied, value = np.zeros_like(among), among.copy(), np.zeros(len(among), np.int64)
    for i in range(len(slices) - 1, -1, -1):
        high = tied & slices[i]
        enough = np.bitwise_count(sure | high).sum(axis=1) >= k
        value |= enough.astype(np.int64) << i
        sure = np.where(enough[:, None], sure, sure | high)
        tied = np.where(enough[:, None], high, tied & ~slices[i])
    return value


def at_least(slices: list[np.ndarray], among: np.ndarray, value: np.ndarray) -> np.ndarray:
    above, same = np.zeros_like(among), among.copy()
    for i in range(len(slices) - 1, -1, -1):
        bit = np.where((value >> i) & 1, ~np.uint64(0), np.uint64(0))[:, None]
        above |= same & slices[i] & ~bit
        same &= ~(slices[i] ^ bit)
    return above | same


def top_rows(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, drop: int = DROP):
    """(query number, row number, exact score) of all rows that may be among each query's k best."""
    among = bitmap(query_ids[:, None] != ids[None, :])
    slices, slack = approximate(queries, rows, drop, among)
    least = np.maximum(kth_largest(slices, among, k) - slack, 0)
    chosen = at_least(slices, among, least)
    flags = np.unpackbits(chosen.view(np.uint8), axis=1, bitorder="little", count=len(ids))
    q, r = np.nonzero(flags)
    return q, r, np.einsum("ij,ij->i", queries[q], rows[r])


def _search(key: tuple[pa.Scalar, ...], rows: pa.Table, queries: pa.Table) -> pa.Table:
    if not rows.num_rows or not queries.num_rows:
        return pa.table({"query_id": pa.array([], pa.int64()), "shard": pa.array([], pa.int64()), "best": pa.array([], pa.list_(pa.struct([("low", pa.int64()), ("vec_id", pa.int64())])))})
    ids, query_ids = rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
    q, r, score = top_rows(matrix(queries["q"], np.int64), query_ids, matrix(rows["q"], np.int64), ids, K)
    return lists(q, ids[r], -score, query_ids, key[0].as_py(), K, np.int64)


def exact_search(vectors: DataFrame, every: int) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score; queries are the ids divisible by ``every``."""
    v = usable(vectors).select("vec_id", F.transform("embedding", lambda x: F.floor(x * float(SCALE)).cast("long")).alias("q"))
    asked = v.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("q").alias("q"))
    v, asked = materialized(v, "sliced-rows"), materialized(asked, "sliced-queries")
    shards, parts = blocks(v, SHARD_ROWS), blocks(asked, QUERY_BLOCK)
    rows = to_all(in_blocks(v, "shard", shards), "part", parts).groupBy("shard", "part")
    queries = to_all(in_blocks(asked, "part", parts), "shard", shards).groupBy("shard", "part")
    found = rows.cogroup(queries).applyInArrow(_search, "query_id long, shard long, best array<struct<low:long,vec_id:long>>")
    return merged(found, K, shards, "long")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search(table(spark, sf_dir, "embeddings"), 50)


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= {K}
"""
