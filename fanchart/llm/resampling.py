"""Importance resampling towards a target distribution over hashed word n-grams, with segments deduplicated.

Features are the runs of one to three words of a text, hashed into ``BUCKETS`` buckets. Newlines separate words, so
they cut a text into lines whose inner n-grams depend on the line alone: every distinct line is kept once, its
features are computed once, and they count as often as the line occurs. N-grams that cross a line border are found
per document and added separately. From the bucket counts of corpus and target each bucket has an integer gain; a
document's weight is the sum of the gains over its features, made of the weights of its lines and of its crossing
n-grams. A Gumbel number from the document's id joins it, and the documents of highest score are drawn.

Lines are grouped with partial counts, so a line found everywhere does not meet in one task. Weights go back to documents
by line digests: lines that make up more than one in ``HOT`` line occurrences, at most ``HOT`` of them, are
broadcast, the others are joined. Ranks come from sorted ranges and their sizes.

The CRC-32 of an n-gram is put together from registers of its words: a register is linear over GF(2), so moving it
past another word's bytes is four table look-ups, whatever the text.

Defined results: null and empty texts have no words and no features, weight 0; a null doc_id is the empty string in
the Gumbel number; repeated rows are documents of their own with equal scores, drawn next to each other; an empty
corpus gives no rows, an empty target has T = 0. Lines are named by 128 bits of hashes. Only ``doc_id`` and ``text``
are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fanchart.llm.common import table
from fanchart.operators.ranking import numbered
from fanchart.sources.materialize import materialized

BUCKETS = 10_000
#: Documents with fewer words are not drawn.
MIN_WORDS = 20
PERCENT = 5
SEED = 42
#: Lines above one in HOT occurrences take the broadcast side of a join.
HOT = 2000
#: Bytes of text worked on at once; a longer text is taken alone, whole.
PART = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
ONES = np.uint32(0xFFFFFFFF)
#: Words up to this length go through the tables.
SHORT = 64


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The table of one byte's step, and [length, byte of the register, value]: the register after that many zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(0xEDB88320) ^ (step >> np.uint32(1)), step >> np.uint32(1)).astype(np.uint32)
    past = np.empty((SHORT + 1, 4, 256), np.uint32)
    past[0] = np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None]
    for i in range(SHORT):
        past[i + 1] = step[past[i] & 255] ^ (past[i] >> np.uint32(8))
    return step, past.reshape(-1)


STEP, PAST = _crc_tables()


def _advance(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Registers moved past ``by`` zero bytes each."""
    short = np.minimum(by, SHORT)
    at = short * 1024
    y = PAST[at + (x & 255)] ^ PAST[at + 256 + ((x >> np.uint32(8)) & 255)] ^ PAST[at + 512 + ((x >> np.uint32(16)) & 255)] ^ PAST[at + 768 + (x >> np.uint32(24))]
    long = np.flatnonzero(by > SHORT)
    if len(long):
        y[long] = _advance(y[long], by[long] - SHORT)
    return y


def _registers(b: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The CRC register behind each word, from the usual initial value."""
    order = np.argsort(-np.minimum(lens, SHORT + 1), kind="stable")
    s, n = starts[order], lens[order]
    longer = len(n) - np.cumsum(np.bincount(np.minimum(n, SHORT + 1), minlength=SHORT + 2))
    reg = np.full(len(n), ONES, np.uint32)
    for j in range(SHORT):
        k = int(longer[j])
        if not k:
            break
        r = reg[:k]
        reg[:k] = STEP[(r ^ b[s[:k] + j]) & 255] ^ (r >> np.uint32(8))
    for i in range(int(longer[SHORT])):
        reg[i] = np.uint32(zlib.crc32(b[s[i] : s[i] + n[i]].tobytes())) ^ ONES
    out = np.empty_like(reg)
    out[order] = reg
    return out


class Words:
    """The words of consecutive texts in one buffer: start, length, text and line of each."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.b = LOWER[data]
        word = IN_WORD[self.b]
        cut = np.zeros(len(data) + 1, bool)
        cut[bounds] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | cut[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | cut[1:-1]
        self.starts = np.flatnonzero(first)
        self.lens = np.flatnonzero(last) + 1 - self.starts
        self.owner = np.searchsorted(bounds, self.starts, side="right") - 1
        self.line = np.searchsorted(np.flatnonzero(self.b == 10), self.starts)
        self.texts = len(bounds) - 1

    def per_text(self) -> np.ndarray:
        return np.bincount(self.owner, minlength=self.texts)

    def features(self, crossing: bool) -> tuple[np.ndarray, np.ndarray]:
        """(text, bucket) of every n-gram, or of those only that cross a line border."""
        n = len(self.starts)
        if crossing:
            border = np.flatnonzero((self.line[1:] != self.line[:-1]) & (self.owner[1:] == self.owner[:-1]))
            near = np.zeros(n + 3, bool)
            for d in range(-1, 3):
                near[border + d + 1] = True
            at = np.flatnonzero(near[1 : n + 1])
        else:
            at = np.arange(n)
        starts, lens, owner, line = self.starts[at], self.lens[at], self.owner[at], self.line[at]
        whole = _registers(self.b, starts, lens)
        bare = whole ^ _advance(np.full(len(at), ONES, np.uint32), lens)
        spaced = bare ^ _advance(np.full(len(at), STEP[32], np.uint32), lens)
        texts, buckets = [], []

        def add(reg: np.ndarray, keep: np.ndarray) -> None:
            texts.append(owner[: len(reg)][keep])
            buckets.append(((reg ^ ONES) % np.uint32(BUCKETS))[keep])

        if not crossing:
            add(whole, np.ones(len(at), bool))
        reg = whole
        for size in (1, 2):
            m = max(len(at) - size, 0)
            reg = _advance(reg[:m], lens[size:] + 1) ^ spaced[size:]
            keep = (owner[:m] == owner[size:]) & (at[size:] - at[:m] == size)
            add(reg, keep & (line[:m] != line[size:]) if crossing else keep)
        return np.concatenate(texts), np.concatenate(buckets).astype(np.int64)


def _parts(column: pa.Array, size: int = PART) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of consecutive texts, about ``size`` bytes each; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(int(np.searchsorted(ends, ends[at] + size, side="right")) - 1, at + 1)
        yield at, to, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def _packed(texts: np.ndarray, buckets: np.ndarray, n: int) -> pa.Array:
    """Buckets of each text, sorted, as differences of 16 bits."""
    key = np.sort(texts * BUCKETS + buckets)
    owner, value = key // BUCKETS, key % BUCKETS
    step = value.copy()
    step[1:] -= np.where(owner[1:] == owner[:-1], value[:-1], 0)
    ends = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(owner, minlength=n) * 2, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(step.astype("<u2").tobytes())])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of packed features."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    step = np.frombuffer(data, "<u2", count=(int(ends[-1]) - int(ends[0])) // 2, offset=int(ends[0])).astype(np.int64) if data is not None and ends[-1] > ends[0] else np.zeros(0, np.int64)
    sizes = np.diff(ends) // 2
    total = np.cumsum(step)
    first = np.cumsum(sizes) - sizes
    before = np.where(first > 0, total[np.maximum(first, 1) - 1], 0) if len(total) else np.zeros(len(sizes), np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), total - np.repeat(before, sizes)


def _line_features(batches):
    for batch in batches:
        for a, b, data, bounds in _parts(batch["line"]):
            texts, buckets = Words(data, bounds).features(False)
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_pydict({"h1": part["h1"], "h2": part["h2"], "n": part["n"], "features": _packed(texts, buckets, b - a)})


def _crossing(batches):
    for batch in batches:
        for a, b, data, bounds in _parts(batch["text"]):
            words = Words(data, bounds)
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_pydict({
                "row": part["row"], "doc_id": part["doc_id"], "n_words": pa.array(words.per_text(), pa.int64()),
                "features": _packed(*words.features(True), b - a), "h1": part["h1"], "h2": part["h2"],
            })


def _counted(counts: np.ndarray):
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "c": pa.array(counts[at], pa.int64())})


def _count_packed(batches):
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        row, bucket = _unpacked(batch["features"])
        order = np.argsort(bucket, kind="stable")
        np.add.at(counts, bucket[order], batch["n"].to_numpy()[row[order]])
    yield from _counted(counts)


def _count_texts(batches):
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, data, bounds in _parts(batch["text"]):
            counts += np.bincount(Words(data, bounds).features(False)[1], minlength=BUCKETS)
    yield from _counted(counts)


def _weigh(keep: tuple[str, ...], gains):
    def run(batches):
        for batch in batches:
            row, bucket = _unpacked(batch["features"])
            w = np.zeros(batch.num_rows, np.int64)
            np.add.at(w, row, gains.value[bucket])
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in keep} | {"w": pa.array(w, pa.int64())})

    return run


def _dense(counted: DataFrame) -> np.ndarray:
    """Counts of all buckets; their number is a parameter."""
    out = np.zeros(BUCKETS, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("c").alias("c")).collect():
        out[r.bucket] = r.c
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's floored, smoothed log-ratio in thousandths."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000.0 * math.log(((t + 1.0) * s_all) / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _names(line: Column) -> list[Column]:
    return [F.xxhash64(line), F.xxhash64(F.lit(1), line)]


def weights(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, text) and target texts -> doc_id, n_words, n_features, weight; one row per row."""
    spark = docs.sparkSession
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x != "")
    texts = docs.select("doc_id", "text", lines.alias("lines"))
    line = texts.select(F.explode("lines").alias("line")).groupBy("line").agg(F.count("*").alias("n"))
    h1, h2 = _names(F.col("line"))
    distinct = line.select("line", "n", h1.alias("h1"), h2.alias("h2")).mapInArrow(_line_features, "h1 long, h2 long, n long, features binary")
    distinct = materialized(distinct.where(F.length("features") > 0), "resample-lines")

    named = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.transform("lines", lambda x: _names(x)[0]).alias("h1"), F.transform("lines", lambda x: _names(x)[1]).alias("h2"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = materialized(named.mapInArrow(_crossing, f"row long, doc_id {kind}, n_words long, features binary, h1 array<long>, h2 array<long>"), "resample-rows")

    both = distinct.select("n", "features").unionByName(base.select(F.lit(1).cast("long").alias("n"), "features"))
    source = _dense(both.mapInArrow(_count_packed, "bucket int, c long"))
    gain = spark.sparkContext.broadcast(gains(source, _dense(target.select("text").mapInArrow(_count_texts, "bucket int, c long"))))

    weighed = materialized(distinct.mapInArrow(_weigh(("h1", "h2", "n"), gain), "h1 long, h2 long, n long, w long"), "resample-weights")
    total = weighed.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(weighed.where(F.col("n") * HOT > total).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("w").alias("hot")))
    cold = weighed.where(F.col("n") * HOT <= total).select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "w")
    placed = base.select("row", F.explode(F.arrays_zip("h1", "h2")).alias("h")).select("row", "h.h1", "h.h2")
    placed = placed.join(hot, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    parts = [
        base.mapInArrow(_weigh(("row", "doc_id", "n_words"), gain), f"row long, doc_id {kind}, n_words long, w long"),
        placed.where("hot IS NOT NULL").select("row", F.col("hot").alias("w")),
        placed.where("hot IS NULL").join(cold, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2"))).select("row", "w"),
    ]
    rows = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    out = rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("w").alias("weight"))
    n = F.col("n_words")
    features = n + F.greatest(n - 1, F.lit(0)) + F.greatest(n - 2, F.lit(0))
    return out.select("doc_id", "n_words", features.alias("n_features"), "weight")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A floored Gumbel number in thousandths from a digest of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000.0 * F.log(-F.log(u)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, text) and target texts -> doc_id, n_features, weight, score, rank; rank is null for rows not drawn."""
    scored = materialized(weights(docs, target).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "resample-scored")
    able = scored.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    ranked = numbered(able, [F.desc("score"), F.asc("doc_id")], "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWERED + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: The CRC's table of 256 steps is built by its rule; each distinct n-gram is digested once.
SQL = f"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END FROM bits WHERE k < 8),
step AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
words AS MATERIALIZED (
  SELECT 1 AS corpus, row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
  UNION ALL SELECT 0, row_number() OVER (), NULL, {_WORDS} FROM benchmark),
grams AS (
  SELECT corpus, r, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT corpus, r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, range(1, 4) s(n))),
counted AS MATERIALIZED (SELECT corpus, r, g, count(*) AS c FROM grams GROUP BY ALL),
distinct_grams AS (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM counted)),
bucketed AS MATERIALIZED (
  SELECT g, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda a, b: xor(t[xor(a % 256, b) + 1], a // 256))) % 10000 AS bucket
  FROM distinct_grams, step),
per_row AS MATERIALIZED (SELECT corpus, r, bucket, sum(c)::BIGINT AS c FROM counted JOIN bucketed USING (g) GROUP BY ALL),
sums AS (SELECT bucket, sum(c) FILTER (corpus = 1)::BIGINT AS s, sum(c) FILTER (corpus = 0)::BIGINT AS t FROM per_row GROUP BY 1),
whole AS (SELECT coalesce(sum(s), 0)::BIGINT AS s_all, coalesce(sum(t), 0)::BIGINT AS t_all FROM sums),
gain AS (
  SELECT bucket, floor(1000.0::DOUBLE * ln(((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain
  FROM sums, whole),
weight AS (SELECT r, sum(c * gain)::BIGINT AS w FROM per_row JOIN gain USING (bucket) WHERE corpus = 1 GROUP BY 1),
scored AS (
  SELECT doc_id, len(d.w) AS n, coalesce(f.w, 0) AS weight, coalesce(f.w, 0) +
    floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM words d LEFT JOIN weight f USING (r) WHERE d.corpus = 1),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n >= {MIN_WORDS}) AS able FROM scored)
SELECT doc_id, n + greatest(n - 1, 0) + greatest(n - 2, 0) AS n_features, weight, score,
       CASE WHEN n >= {MIN_WORDS} AND place <= able * {PERCENT} // 100 THEN place END AS rank
FROM placed
"""
