"""Drop lines that many documents share, by probing sharded minimal perfect hashes.

A line's key is the line without white space at its ends and with A-Z in lower case, known by a 128-bit digest. One
aggregation counts the documents of every key; keys in enough documents are cut into shards by their digest, and each
shard becomes one row of arrays: the bit levels of a minimal perfect hash over the first digest half, and, at the
hash's slots, the second half as fingerprint, the document count and the largest document. A probe computes its slot
and compares one fingerprint; a line that misses is a line to keep, so rare lines need no entry.

Probes travel as (digest, doc_id) in groups of about ``GROUP`` lines by shard and a salt from the document, so a line
that a third of all documents hold spreads over all groups of its shard. Only the hits go back to the documents, one
list per document.

Defined results: null and empty texts are one empty line; rows without doc_id are not counted and lose nothing;
repeated rows of one doc_id are one document and lose the same lines; of equal lines in the largest document none is
dropped; an empty table gives no rows. Only ``doc_id`` and ``text`` are read, other columns are carried by name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanchart.llm.common import map_rows, table
from fanchart.sources.materialize import materialized

MIN_CHARS, MIN_DOCS = 40, 5
#: White space that is stripped.
BLANK = " \t\n\x0b\x0c\r"
#: Keys of one shard, and lines of one group of probes: an index row and its probes are of like size.
SHARD_KEYS, GROUP = 4096, 16384
#: Slots per key of each hash level.
GAMMA = 2
LEVELS = 40


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The digest of each line's key; None for keys that are too short to drop."""
    out = []
    for line in (text or "").split("\n"):
        key = line.strip(BLANK)
        out.append(xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None)
    return out


def _emit(batch: pa.RecordBatch, min_chars: int) -> dict:
    ids, digests = [], []
    for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
        if doc is not None:
            own = {d for d in line_keys(text, min_chars) if d}
            ids += [doc] * len(own)
            digests += own
    h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return {"h1": pa.array(h[:, 0].copy()), "h2": pa.array(h[:, 1].copy()), "doc_id": pa.array(ids, pa.int64())}


def mixed(key: np.ndarray, level: int) -> np.ndarray:
    x = key ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Levels of bits: a key's slot is the rank of its bit on the first level where no other key shares it."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits, dtype=np.int64) - bits

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The hash and the keys that found no place (equal keys never do)."""
        sizes, bits = [], []
        for level in range(LEVELS):
            if not len(keys):
                break
            size = max(8, GAMMA * len(keys))
            at = (mixed(keys, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            keys = keys[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate([*bits, np.zeros(0, bool)])), keys

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1; a key that was not built in gets any of these."""
        out, todo, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + (mixed(keys[todo], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            out[todo[hit]] = self.rank[at[hit]]
            todo = todo[~hit]
            base += size
            if not len(todo):
                break
        return out


INDEX = "shard long, sizes binary, n_bits long, bits binary, prints binary, docs binary, last binary, rest binary"


def _build(keys: pa.Table) -> pa.Table:
    h1 = keys["h1"].to_numpy().view(np.uint64)
    h2, last, n = keys["h2"].to_numpy(), keys["last_doc"].to_numpy(), keys["n_docs"].to_numpy()
    ph, rest = PerfectHash.build(h1)
    left = np.isin(h1, rest)
    slot, count = ph.slots(h1[~left]), int(ph.bits.sum())
    prints, docs, lasts = np.zeros(count, np.int64), np.zeros(count, np.uint32), np.zeros(count, np.int64)
    prints[slot], docs[slot], lasts[slot] = h2[~left], np.minimum(n[~left], 2**32 - 1), last[~left]
    over = np.stack([h1[left].view(np.int64), h2[left], last[left]], axis=1) if left.any() else np.zeros((0, 3), np.int64)
    row = {
        "shard": keys["shard"][:1], "sizes": [ph.sizes.tobytes()], "n_bits": [len(ph.bits)], "bits": [np.packbits(ph.bits).tobytes()],
        "prints": [prints.tobytes()], "docs": [docs.tobytes()], "last": [lasts.tobytes()], "rest": [over.tobytes()],
    }
    return pa.table(row)


def _probe(lines: pa.Table, index: pa.Table) -> pa.Table:
    none = pa.table({"doc_id": pa.array([], pa.int64()), "h1": pa.array([], pa.int64()), "h2": pa.array([], pa.int64())})
    if not lines.num_rows or not index.num_rows:
        return none
    row = {c: index[c][0].as_py() for c in index.column_names}
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=row["n_bits"]).astype(bool)
    ph = PerfectHash(np.frombuffer(row["sizes"], np.int64), bits)
    prints, last = np.frombuffer(row["prints"], np.int64), np.frombuffer(row["last"], np.int64)
    h1, h2, doc = lines["h1"].to_numpy(), lines["h2"].to_numpy(), lines["doc_id"].to_numpy()
    slot = ph.slots(h1.view(np.uint64))
    found = np.flatnonzero(slot >= 0)
    found = found[prints[slot[found]] == h2[found]]
    drop = np.zeros(len(h1), bool)
    drop[found] = last[slot[found]] != doc[found]
    for a, b, end in np.frombuffer(row["rest"], np.int64).reshape(-1, 3):
        drop |= (h1 == a) & (h2 == b) & (doc != end)
    return pa.table({"doc_id": doc[drop], "h1": h1[drop], "h2": h2[drop]})


def line_index(lines: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, int]:
    """Index rows over keys in at least ``min_docs`` documents, and the number of shards."""
    counts = lines.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
    frequent = materialized(counts.where(F.col("n_docs") >= min_docs), "line-frequent")
    shards = max(1, math.ceil(frequent.count() / SHARD_KEYS))
    index = frequent.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("shard").applyInArrow(_build, INDEX)
    return materialized(index, "line-index"), shards


def dropped_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(of, keys): per document the digests of the lines that it loses."""
    lines = materialized(map_rows(docs.select("doc_id", "text"), _emit, "h1 long, h2 long, doc_id long", min_chars), "lines")
    index, shards = line_index(lines, min_docs)
    salts = max(1, math.ceil(lines.count() / (shards * GROUP)))
    probes = lines.withColumns({"shard": F.pmod("h1", F.lit(shards)), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(salts))})
    copies = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    hits = probes.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(_probe, "doc_id long, h1 long, h2 long")
    return hits.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("h1", "h2")).alias("keys"))


def _keep(batch: pa.RecordBatch, min_chars: int) -> dict:
    n_lines, n_dropped, kept = [], [], []
    for text, keys in zip(batch["text"].to_pylist(), batch["keys"].to_pylist()):
        if not keys:
            n_lines.append((text or "").count("\n") + 1)
            n_dropped.append(0)
            kept.append(text or "")
            continue
        gone = {k["h1"].to_bytes(8, "little", signed=True) + k["h2"].to_bytes(8, "little", signed=True) for k in keys}
        lines = text.split("\n")
        left = [line for line, d in zip(lines, line_keys(text, min_chars)) if d not in gone]
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(left))
        kept.append("\n".join(left))
    return {"row": batch["row"], "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept": pa.array(kept, pa.string()), "no_text": batch["text"].is_null()}


def line_dedup(docs: DataFrame, carry: list[str] | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per row of ``docs``: row (struct of doc_id and the carried columns), n_lines, n_dropped, kept (text), no_text (it was null)."""
    gone = dropped_keys(docs, min_chars, min_docs)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys(["doc_id", *(carry or [])])]).alias("row"), "text", F.col("doc_id").alias("at"))
    joined = packed.join(gone, F.col("at") == F.col("of"), "left").select("row", "text", "keys")
    kind = joined.schema["row"].dataType.simpleString()
    return map_rows(joined, _keep, f"row {kind}, n_lines long, n_dropped long, kept string, no_text boolean", min_chars)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, line, unnest(range(1, len(line) + 1)) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS line FROM documents)),
keyed AS (
  SELECT doc_id, i, line[i] AS line,
         translate(regexp_replace(line[i], '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
often AS (SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
marked AS (SELECT d.doc_id, d.i, d.line, coalesce(d.doc_id <> o.last_doc, false) AS gone FROM keyed d LEFT JOIN often o ON d.k = o.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
