"""Audit of how sources of one language differ in their words, by count-level bitmaps.

Each language keeps the terms found in at least ``MIN_DOCS`` of its documents. A source's smoothed share p of a term depends on the
term's count alone, so a source is a set of levels: for every count the set of the terms that have it there. Two
sources meet by intersecting levels: the size of an intersection, multiplied by the two levels' |p - q|, is one joint
cell, and the cells add up to the distance. Terms that a source lacks are its level of count 0, the complement of all
others.

Term sets are stored as compressed bitmaps are: levels that hold at least one in ``DENSE`` of a block's terms are
bitsets, met by AND and popcount, rarer levels are lists of term ids, looked up in the other source. A source has at
most ``DENSE`` bitsets, however many counts occur.

Terms are dealt to blocks of about ``BLOCK`` and sources to tiles of ``TILE``; a task meets two tiles in one block and
returns one partial sum per pair of sources, so neither a language nor a source meets in one task. Words are counted
per task before they are shuffled.

Defined results: null text, lang and source are the empty string; a language without kept terms has distance 0 between
its sources and no terms; a source alone in its language has no pairs; repeated rows are documents of their own; an
empty table gives no rows. p is exact integer arithmetic. Only ``text``, ``lang`` and ``source`` are read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fanchart.llm.common import table
from fanchart.sources.materialize import materialized

MIN_DOCS, TOP = 30, 50
SCALE, SMOOTH = 1_000_000_000, 5
BLOCK, TILE, DENSE = 512, 64, 64
#: Terms that a task counts before it hands them on.
FLUSH = 400_000
# letters A-Z, a-z and everything beyond ASCII, on UTF-8 bytes; bytes.lower() changes A-Z only
terms_of = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+").findall


def _counted(batches):
    """(lang, source, term, docs, count), summed in the task."""
    docs: dict[tuple, Counter] = defaultdict(Counter)
    counts: dict[tuple, Counter] = defaultdict(Counter)

    def flush():
        for (lang, source), c in counts.items():
            d, n = docs[lang, source], len(c)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * n, pa.string()), "source": pa.array([source] * n, pa.string()), "term": pa.array(list(c), pa.binary()).cast(pa.string()),
                "docs": pa.array([d[t] for t in c], pa.int64()), "count": pa.array(list(c.values()), pa.int64()),
            })
        docs.clear()
        counts.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
            found = Counter(terms_of(text.lower()))
            c = counts[lang, source]
            held -= len(c)
            c.update(found)
            docs[lang, source].update(found.keys())
            held += len(c)
            if held > FLUSH:
                yield from flush()
                held = 0
    yield from flush()


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), exact; null without terms."""
    big = lambda c: c.cast("decimal(20,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * big(count + SMOOTH)
    return F.lit(1) + F.call_function("div", top, F.nullif(big(total + SMOOTH * terms), F.lit(0).cast("decimal(20,0)")))


class Levels:
    """One source's terms of a block by count."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, shares: np.ndarray, zero: int, seen: int):
        of = np.zeros(seen, np.int64)
        of[ids] = counts
        self.share = np.full(seen, zero, np.int64)
        self.share[ids] = shares
        # the complement of all counts is the level of count 0
        level, at, size = np.unique(of, return_inverse=True, return_counts=True)
        dense = size * DENSE >= seen
        number = np.cumsum(dense) - 1
        self.dense = dense[at]
        bits = np.zeros((int(dense.sum()), -(-seen // 64) * 64), bool)
        here = np.flatnonzero(self.dense)
        bits[number[at[here]], here] = True
        self.bits = np.packbits(bits, axis=1).view(np.uint64)
        self.sparse = np.flatnonzero(~self.dense)
        self.of_bits = np.zeros(len(bits), np.int64)
        self.of_bits[number[at[here]]] = self.share[here]
        self.zero = zero

    def distance(self, other: Levels, unseen: int) -> int:
        cells = np.bitwise_count(self.bits[:, None, :] & other.bits[None, :, :]).sum(axis=2, dtype=np.int64)
        total = int((cells * np.abs(self.of_bits[:, None] - other.of_bits[None, :])).sum())
        total += int(np.abs(self.share[self.sparse] - other.share[self.sparse]).sum())
        rest = other.sparse[self.dense[other.sparse]]
        total += int(np.abs(self.share[rest] - other.share[rest]).sum())
        return total + unseen * abs(self.zero - other.zero)


def _meet(t: pa.Table) -> pa.Table:
    """Partial distances of all pairs of two tiles; rows without a term tell a source's share of absent terms."""
    lang, i, j = (t[c][0].as_py() for c in ("lang", "i", "j"))
    size = int(t["size"].to_numpy().max())
    named = t["term"].combine_chunks().dictionary_encode()
    seen = len(named.dictionary)
    ids = named.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    number, counts, shares = (t[c].to_numpy() for c in ("number", "count", "share"))
    order = np.lexsort((ids, number))
    ids, number, counts, shares = ids[order], number[order], counts[order], shares[order]
    cut = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    levels = {}
    for a, b in zip(cut.tolist(), np.append(cut[1:], len(number)).tolist()):
        # the row without a term comes first
        levels[int(number[a])] = Levels(ids[a + 1 : b], counts[a + 1 : b], shares[a + 1 : b], int(shares[a]), seen)
    left = [n for n in levels if n // TILE == i]
    right = [n for n in levels if n // TILE == j]
    found = [(a, b, levels[a].distance(levels[b], size - seen)) for a in left for b in right if i != j or a < b]
    return pa.table({
        "lang": pa.array([lang] * len(found), pa.string()), "a": pa.array([x[0] for x in found], pa.int64()),
        "b": pa.array([x[1] for x in found], pa.int64()), "part": pa.array([x[2] for x in found], pa.int64()),
    })


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(text, lang, source) -> lang, source, part, item, value, rank."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = plain.mapInArrow(_counted, "lang string, source string, term string, docs long, count long")
    # one exchange serves the sums per source and those per language
    summed = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("count").alias("count"))
    term = W.partitionBy("lang", "term")
    summed = summed.withColumns({"all_docs": F.sum("docs").over(term), "all": F.sum("count").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
    kept = materialized(summed.where(F.col("all_docs") >= min_docs).select("lang", "source", "term", "count", "all", "first"), "divergence-kept")

    languages = kept.groupBy("lang").agg(F.count(F.when(F.col("first"), 1)).alias("terms"), F.sum("count").alias("all_n"))
    sums = kept.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(F.sum("count").alias("n"))
    groups = plain.groupBy("lang", "source").agg(F.lit(1).alias("one")).join(languages.withColumnRenamed("lang", "ll"), F.col("lang") == F.col("ll"), "left")
    groups = groups.join(sums, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    # a window over the sources of one language
    number = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    groups = groups.select("lang", "source", zero("n"), zero("terms"), zero("all_n"), number.cast("long").alias("number"))
    tiles = F.floor(F.max("number").over(W.partitionBy("lang")) / TILE) + 1
    groups = groups.withColumn("absent", F.coalesce(share(F.lit(0), F.col("n"), F.col("terms")), F.lit(0)).cast("long"))
    groups = materialized(groups.withColumns({"tiles": tiles, "blocks": F.greatest(F.ceil(F.col("terms") / block), F.lit(1))}), "divergence-groups")

    g = groups.withColumnsRenamed({"lang": "gl", "source": "gs"})
    present = kept.join(g, (F.col("lang") == F.col("gl")) & (F.col("source") == F.col("gs")))
    present = present.withColumn("share", share(F.col("count"), F.col("n"), F.col("terms")))
    in_block = F.pmod(F.xxhash64("term"), F.col("blocks"))
    sizes = present.where("first").groupBy(F.col("lang").alias("bl"), in_block.alias("bb")).agg(F.count("*").alias("size"))
    absent = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    absent = absent.join(sizes, (F.col("lang") == F.col("bl")) & (F.col("block") == F.col("bb")), "left")
    columns = ["lang", "block", "number", "tiles", "term", "count", "share", "size"]
    rows = absent.select("lang", "block", "number", "tiles", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("count"), F.col("absent").alias("share"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    rows = rows.unionByName(present.select("lang", in_block.alias("block"), "number", "tiles", "term", "count", F.col("share").cast("long"), F.lit(0).cast("long").alias("size")).select(columns))
    tile = F.floor(F.col("number") / TILE)
    rows = rows.withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.select("lang", "block", F.least(tile, "u").alias("i"), F.greatest(tile, "u").alias("j"), "number", "term", "count", "share", "size")
    met = rows.groupBy("lang", "block", "i", "j").applyInArrow(_meet, "lang string, a long, b long, part long")
    distance = met.groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
    both = distance.unionByName(distance.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = lambda c, l, s: groups.select(F.col("lang").alias(l), F.col("number").alias(c), F.col("source").alias(s))
    pairs = both.join(name("na", "la", "source"), (F.col("lang") == F.col("la")) & (F.col("a") == F.col("na")))
    pairs = pairs.join(name("nb", "lb", "item"), (F.col("lang") == F.col("lb")) & (F.col("b") == F.col("nb"))).select("lang", "source", "item", "value")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    excess = F.col("share") - share(F.col("all"), F.col("all_n"), F.col("terms"))
    words = present.where(F.col("count") > 0).select("lang", "source", F.col("term").alias("item"), excess.cast("long").alias("value")).where(F.col("value") > 0)
    words = words.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return out(pairs, "pair").unionByName(out(words, "term"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
tf AS (SELECT lang, source, term, count(*) AS c, count(DISTINCT r) AS df FROM w GROUP BY ALL),
kept AS (SELECT lang, term, sum(c)::HUGEINT AS every FROM tf GROUP BY ALL HAVING sum(df) >= {MIN_DOCS}),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(every)::HUGEINT AS n FROM kept GROUP BY 1),
grp AS (SELECT DISTINCT lang, source FROM d),
cell AS (
  SELECT g.lang, g.source, k.term, k.every, coalesce(t.c, 0)::HUGEINT AS c, v.v, v.n AS every_n, sum(coalesce(t.c, 0)) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS n
  FROM grp g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN tf t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
p AS (SELECT *, 1 + ({SCALE}::HUGEINT * (c + {SMOOTH})) // (n + {SMOOTH} * v) AS p, 1 + ({SCALE}::HUGEINT * (every + {SMOOTH})) // (every_n + {SMOOTH} * v) AS q FROM cell),
met AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN met m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= {TOP}
"""
