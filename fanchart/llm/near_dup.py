"""Near duplicates by a multi-index Hamming join over MinHash signatures, confirmed on full shingle sets.

A signature has ``K`` symbols of 32 bits, each the minimum of one hash over a document's shingles; two sets of
similarity s differ in a symbol with probability 1 - s. All pairs within ``RADIUS`` differing symbols are found:
the signature is cut into ``CHUNKS`` chunks, so by the pigeonhole principle some chunk has at most
RADIUS // CHUNKS errors, and every way to leave out that many symbols of a chunk is a bucket key. A pair of
similarity 0.8, the pipeline's threshold, lies beyond the radius with a probability of about 6e-5, one of 0.85, that of
``op2_near_dup``, with 9e-7; nothing else is lost.

Equal sets are one class before anything is joined. Within a bucket members are first compared with its least
member only; links found there give provisional components, and only members of different components are compared
with each other, in blocks of ``BLOCK`` members on signatures held next to the keys. So a group of thousands of near
copies costs links in proportion to its size. Candidate links are confirmed on the full sets: each class with its
closest bucket head first, then the pairs that still lie between different components.

Defined results: words, sets and links as in ``op2_near_dup``; texts with fewer than five words have their whole
sequence as one shingle; null, empty and wordless texts have an empty set and are linked with nothing; rows without
doc_id take no part (component null, kept); rows of one doc_id are one node; an empty table gives no rows. Only
``doc_id`` and ``text`` are read. Shingles are 64-bit hashes: sets are as exact as those are free of collisions.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fanchart.llm.common import map_rows, table
from fanchart.llm.graph import components
from fanchart.sources.materialize import materialized

WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
K, CHUNKS, RADIUS = 36, 9, 17
#: Members of one block of a large bucket, and from how many members on a bucket is large.
BLOCK, LARGE = 384, 32
#: Shingles that one product of a block's incidence matrix takes.
SLICE = 4096

U = np.uint64
_rng = np.random.default_rng(20240611)
#: Random odd multipliers and byte values of the hashes; any fixed ones do.
BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
TURN = _rng.integers(1, 2**63, K, dtype=np.uint64) * U(2) + U(1)
PLACE = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BREAK = np.zeros(256, bool)
BREAK[[32, 9, 10, 11, 12, 13]] = True


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(1)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, BASE, np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word of a UTF-8 text, in order."""
    b = LOWER[np.frombuffer(text, np.uint8)]
    word = ~BREAK[b]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.arange(len(b)) - starts[np.cumsum(first) - 1]
    longest = max(int(at.max(where=word, initial=0)) + 1, 64)
    at[~word] = 0
    value = BYTES[b] * _powers(1 << (longest - 1).bit_length())[at]
    value[~word] = 0
    return scramble(np.add.reduceat(value, starts))


def shingles(text: bytes) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    w = word_hashes(text)
    n = len(w)
    if n >= WORDS:
        s = sum((w[i : n - WORDS + 1 + i] * PLACE[i] for i in range(1, WORDS)), w[: n - WORDS + 1] * PLACE[0])
        return np.unique(scramble(s))
    return scramble(np.array([(w * PLACE[:n]).sum() + U(n)], np.uint64)) if n else w


def signature(s: np.ndarray) -> np.ndarray:
    """The upper halves of the minima of K multiplicative hashes."""
    low = np.full(K, 2**64 - 1, np.uint64)
    for i in range(0, len(s), 2048):
        part = s[None, i : i + 2048] * TURN[:, None]
        part ^= part >> U(29)
        part *= BASE
        np.minimum(low, part.min(axis=1), out=low)
    return (low >> U(32)).astype(np.uint32)


def _describe(batch: pa.RecordBatch) -> dict:
    n, d1, d2, sig = [], [], [], []
    for text in batch["text"].to_pylist():
        s = shingles((text or "").encode())
        n.append(len(s))
        d1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
        d2.append(int(scramble(s ^ BASE).sum(dtype=np.uint64).view(np.int64)))
        sig.append(signature(s).tobytes())
    return {"doc_id": batch["doc_id"], "n_shingles": pa.array(n, pa.int64()), "d1": pa.array(d1, pa.int64()), "d2": pa.array(d2, pa.int64()), "sig": pa.array(sig, pa.binary())}


def bucket_keys(sigs: np.ndarray) -> np.ndarray:
    """(n, keys): a key for each chunk and each choice of symbols that may be wrong in it."""
    width, out = K // CHUNKS, []
    errors = RADIUS // CHUNKS
    for c in range(CHUNKS):
        for v, kept in enumerate(combinations(range(c * width, (c + 1) * width), width - errors)):
            key = np.full(len(sigs), c * 1000 + v + 1, np.uint64)
            for i in kept:
                key = scramble(key * BASE + sigs[:, i])
            out.append(key)
    return np.stack(out, axis=1)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, K)


def _keys(batch: pa.RecordBatch) -> dict:
    keys = bucket_keys(_signatures(batch["sig"])).view(np.int64)
    return {"key": keys.ravel(), "rep": np.repeat(batch["rep"].to_numpy(), keys.shape[1])}


def _close(batch: pa.RecordBatch) -> dict:
    d = (_signatures(batch["sa"]) != _signatures(batch["sb"])).sum(axis=1)
    near = d <= RADIUS
    return {"a": batch["a"].to_numpy()[near], "b": batch["b"].to_numpy()[near], "d": d[near].astype(np.int32)}


def whole_groups(batches, columns: tuple[str, ...]):
    """Tables of whole groups from batches sorted by ``columns``; the last group of a batch may go on in the next."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if rest is not None and rest.num_rows:
            t = pa.concat_tables([rest, t])
        same = np.logical_and.reduce([(v := t[c].to_numpy()) == v[-1] for c in columns])
        whole = t.num_rows - int(same.sum())
        rest = t.slice(whole)
        if whole:
            yield t.slice(0, whole)
    if rest is not None and rest.num_rows:
        yield rest


def _across(batches):
    """Close pairs of different components; batches are sorted by key."""
    for t in whole_groups(batches, ("key",)):
        yield from _pairs(t)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    value, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.float32)
    for i in range(0, int(shared.sum()), SLICE):
        a, b = np.searchsorted(column, (i, i + SLICE))
        part = np.zeros((n, SLICE), np.float32)
        part[row[a:b], column[a:b] - i] = 1
        out += part @ part.T
    size = np.array([len(s) for s in sets])
    out[np.arange(n), np.arange(n)] = size
    return out.astype(np.int64)


def _block_links(batches, percent: int):
    """Links that join components, of each block pair of a large bucket; batches are sorted by (key, i, j)."""
    for t in whole_groups(batches, ("key", "i", "j")):
        key, i, j = (t[c].to_numpy() for c in ("key", "i", "j"))
        cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        for a, b in zip(cut, np.append(cut[1:], len(key))):
            part = t.slice(a, b - a)
            rep, root, block = (part[c].to_numpy() for c in ("rep", "root", "block"))
            if (root == root[0]).all():
                continue
            sets = [shingles(zlib.decompress(x)) for x in part["packed"].to_pylist()]
            both, size = intersections(sets), np.array([len(s) for s in sets])
            near = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (root[:, None] != root[None, :])
            near &= (block[:, None] != block[None, :]) | (i[a] == j[a])
            x, y = np.nonzero(np.triu(near, 1))
            joined = {}

            def find(r):
                while joined.get(r, r) != r:
                    r = joined[r]
                return r

            kept = []
            for k, (u, v) in enumerate(zip(root[x].tolist(), root[y].tolist())):
                u, v = find(u), find(v)
                if u != v:
                    joined[max(u, v)] = min(u, v)
                    kept.append(k)
            if kept:
                yield pa.RecordBatch.from_pydict({"a": rep[x[kept]], "b": rep[y[kept]]})


def _pairs(t: pa.Table):
    key, rep, root = (t[c].to_numpy() for c in ("key", "rep", "root"))
    sig = _signatures(t["sig"].combine_chunks())
    for shift in range(1, len(key)):
        group = key[shift:] == key[:-shift]
        if not group.any():
            break
        at = np.flatnonzero(group & (root[shift:] != root[:-shift]))
        d = (sig[at] != sig[at + shift]).sum(axis=1)
        at, d = at[d <= RADIUS], d[d <= RADIUS]
        if len(at):
            x, y = rep[at], rep[at + shift]
            yield pa.RecordBatch.from_pydict({"a": np.minimum(x, y), "b": np.maximum(x, y), "d": d.astype(np.int32)})


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets that span several components, with their component."""
    r = roots.select(F.col("id").alias("rid"), F.col("root").alias("rroot"))
    m = members.join(r, F.col("rep") == F.col("rid"), "left").select("key", "rep", "n", F.coalesce("rroot", "rep").alias("root"))
    split = m.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(F.col("key").alias("k"))
    return m.join(split, F.col("key") == F.col("k")).drop("k")


def across(members: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, d): close pairs of members of one bucket below ``LARGE`` that lie in different components.

    ``members`` (key, head, n, rep) has the buckets of at least two, ``roots`` (id, root) the components so far.
    Pairs with a bucket's head are not made here, they are known.
    """
    m = _rooted(members.where((F.col("n") >= 3) & (F.col("n") < LARGE) & (F.col("rep") != F.col("head"))), roots)
    s = sets.select(F.col("rep").alias("sid"), "sig")
    m = m.join(s, F.col("rep") == F.col("sid")).select("key", "rep", "root", "sig")
    dealt = m.repartition("key").sortWithinPartitions("key", "rep")
    return dealt.mapInArrow(_across, "a long, b long, d int").groupBy("a", "b").agg(F.min("d").alias("d"))


def across_large(members: DataFrame, roots: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b): confirmed links that join components within buckets of ``LARGE`` members or more."""
    m = _rooted(members.where(F.col("n") >= LARGE), roots)
    m = m.withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    m = m.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", F.col("rep").alias("of"), "root")
    m = m.join(texts, F.col("of") == F.col("rep")).select("key", "i", "j", "block", "rep", "root", "packed")
    dealt = m.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    return dealt.mapInArrow(lambda batches: _block_links(batches, percent), "a long, b long")


def _pack(batch: pa.RecordBatch) -> dict:
    return {"rep": batch["rep"], "packed": pa.array([zlib.compress((t or "").encode(), 1) for t in batch["text"].to_pylist()], pa.binary())}


def _confirm(batch: pa.RecordBatch, percent: int) -> dict:
    # texts arrive by their second id, so that one changes rarely
    kept, last = [], (None, None)
    for k, (b, ta, tb) in enumerate(zip(batch["b"].to_pylist(), batch["ta"].to_pylist(), batch["tb"].to_pylist())):
        if last[0] != b:
            last = (b, shingles(zlib.decompress(tb)))
        x = shingles(zlib.decompress(ta))
        both = len(np.intersect1d(last[1], x, assume_unique=True))
        if 100 * both >= percent * (len(last[1]) + len(x) - both):
            kept.append(k)
    return {"a": batch["a"].take(pa.array(kept, pa.int64())), "b": batch["b"].take(pa.array(kept, pa.int64()))}


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    ta = texts.select(F.col("rep").alias("ra"), F.col("packed").alias("ta"))
    tb = texts.select(F.col("rep").alias("rb"), F.col("packed").alias("tb"))
    both = pairs.select("a", "b").join(ta, F.col("a") == F.col("ra")).join(tb, F.col("b") == F.col("rb")).select("a", "b", "ta", "tb")
    return map_rows(both, _confirm, "a long, b long", percent)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, kept; one row per row."""
    base = materialized(map_rows(docs.select("doc_id", "text"), _describe, "doc_id long, n_shingles long, d1 long, d2 long, sig binary"), "near-base")
    part = base.where("doc_id IS NOT NULL AND n_shingles > 0")
    sets = materialized(part.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "near-sets")
    keys = map_rows(sets.select("rep", "sig"), _keys, "key long, rep long")
    heads = keys.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "k")
    members = materialized(keys.join(heads, F.col("key") == F.col("k")).select("key", "head", "n", "rep"), "near-members")
    stars = members.where("rep <> head").groupBy(F.col("head").alias("a"), F.col("rep").alias("b")).agg(F.count("*").alias("seen"))
    sa = sets.select(F.col("rep").alias("ia"), F.col("sig").alias("sa"))
    sb = sets.select(F.col("rep").alias("ib"), F.col("sig").alias("sb"))
    star = stars.join(sa, F.col("a") == F.col("ia")).join(sb, F.col("b") == F.col("ib")).select("a", "b", "sa", "sb")
    star = materialized(map_rows(star, _close, "a long, b long, d int"), "near-star")
    provisional = components(star)
    pairs = materialized(star.unionByName(across(members, provisional, sets)), "near-pairs")

    large = members.where(F.col("n") >= LARGE).select(F.col("rep").alias("id"))
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(large).distinct()
    found = docs.select(F.col("doc_id").alias("rep"), "text").join(ids, F.col("rep") == F.col("id"), "left_semi")
    texts = materialized(map_rows(found, _pack, "rep long, packed binary").groupBy("rep").agg(F.first("packed").alias("packed")), "near-texts")

    closest = F.row_number().over(W.partitionBy("b").orderBy("d", "a")) == 1
    best = materialized(pairs.withColumn("best", closest).where("best").select("a", "b"), "near-best")
    links = materialized(confirm(best, texts, percent), "near-links")
    roots = materialized(components(links), "near-roots")
    ra, rb = roots.select(F.col("id").alias("ia"), F.col("root").alias("xa")), roots.select(F.col("id").alias("ib"), F.col("root").alias("xb"))
    open_ = pairs.select("a", "b").join(best.select(F.col("a").alias("pa"), F.col("b").alias("pb")), (F.col("a") == F.col("pa")) & (F.col("b") == F.col("pb")), "left_anti")
    open_ = open_.join(ra, F.col("a") == F.col("ia"), "left").join(rb, F.col("b") == F.col("ib"), "left").where("coalesce(xa, a) <> coalesce(xb, b)").select("a", "b")
    inside = members.where(F.col("n") < LARGE).join(ids, F.col("rep") == F.col("id"), "left_semi")
    more = open_.unionByName(across(inside, roots, sets).select("a", "b")).distinct()
    links = links.unionByName(confirm(more, texts, percent)).unionByName(across_large(members, roots, texts, percent))

    # classes of equal sets, and rows of one doc_id, hang together as well
    named = part.select("doc_id", "d1", "d2", "n_shingles").join(sets.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("n_shingles").alias("en"), "rep"), (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n_shingles") == F.col("en")))
    same = named.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    final = components(links.unionByName(same)).select("id", "root")
    out = base.select("doc_id", "n_shingles").join(final, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
