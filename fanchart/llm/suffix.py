"""Remove bytes that repeat an earlier 100-byte string, by refining q-gram buckets with the buckets of later offsets.

Positions that share a q-gram are in one bucket. The bucket of a position at twice the depth is named by its bucket
and that of the position one depth later; the names of one round are reused by the next (1, 2, 4, 8, 16, then 24, 32,
64 and 100 bytes). Names are 64-bit hashes, so tasks agree on them without a global ranking, and two positions with
one name at depth 100 start the same string.

Not every position travels. Of the 77 q-grams (24 bytes) in a 100-byte string, the one with the least name stands for
it; neighbouring strings share it, so about one position in 39 stands for a run of strings. Runs are bucketed by that
q-gram and refined by the names of their first and last string, which cover all bytes of the run (its class):

* the later runs of a class repeat its first run, all their strings are duplicates;
* a bucket with one class is settled;
* first runs of classes in a bucket with several classes are refined further: their strings are named one by one, and
  of strings with one name all but the earliest are duplicates.

Equal strings always lie in one bucket, so nothing is missed. Before each shuffle a task settles what it can: of a
class or string that it holds several times only the earliest travels, and a bucket with more than ``HOT`` classes in
one task is sent on to the last step with a marker that tells the other tasks. So a passage in a third of all
documents travels once per task.

Defined results: null and empty texts have no bytes; rows without doc_id take no part and lose nothing; rows of one
doc_id are one document (a string of it does not repeat itself in its own copy); texts shorter than 100 bytes lose
nothing; an empty table gives no rows. Kept bytes need not be valid UTF-8, so they are binary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanchart.llm.common import map_rows, table
from fanchart.sources.materialize import materialized

DEPTH, Q = 100, 24
#: Strings whose least q-gram is sought together.
SPAN = DEPTH - Q + 1
#: Classes of one bucket that a task sends to the bucket's task.
HOT = 8
#: Bytes named together, and runs that a task holds before it sends them on.
CHUNK, HELD = 1 << 20, 1_000_000
#: Bits of a position within a chunk.
PLACE = 24

U = np.uint64
BYTES = np.random.default_rng(20240612).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
A, B, C = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xBF58476D1CE4E5B9)


def named(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The name of the pair of names (x, y)."""
    z = x * A
    z += y
    z ^= z >> U(32)
    z *= B
    z ^= z >> U(29)
    return z


def deeper(names: np.ndarray, offset: int) -> np.ndarray:
    """Names at a greater depth: each position's name with the name ``offset`` later."""
    return named(names[:-offset], names[offset:])


def depth_names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of all q-grams and of all 100-byte strings of a byte array (of at least 100 bytes)."""
    h = BYTES[data]
    for m in (1, 2, 4, 8):
        h = deeper(h, m)
    grams = deeper(h, Q - 16)
    h = deeper(deeper(h, 16), 32)
    return grams, deeper(h, DEPTH - 64)


def least(v: np.ndarray, span: int) -> np.ndarray:
    """Minima of ``span`` neighbours."""
    width = 1
    while width * 2 <= span:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    return np.minimum(v[: len(v) - (span - width)], v[span - width :]) if span > width else v


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(bucket, class, text number, start, length) of all runs of texts of at least 100 bytes, below 2**24 in sum."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    grams, strings = depth_names(np.frombuffer(b"".join(texts), np.uint8))
    mask = U((1 << PLACE) - 1)
    low = least((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), SPAN)
    valid = np.ones(len(low), bool)
    for e in ends[:-1]:
        valid[e - DEPTH + 1 : e] = False
    at = np.flatnonzero(valid)
    chosen = (low[at] & mask).astype(np.int64)
    first = np.ones(len(at), bool)
    first[1:] = chosen[1:] != chosen[:-1]
    head = np.flatnonzero(first)
    length = np.diff(np.append(head, len(at)))
    start, last = at[head], at[head + length - 1]
    number = np.searchsorted(ends, start, side="right")
    kind = named(named(strings[start], strings[last]), length.astype(np.uint64) * C)
    return grams[chosen[head]].view(np.int64), kind.view(np.int64), number, start - (ends - sizes)[number], length


def pieces(text: bytes, size: int = 1 << 23):
    """(offset, piece) that overlap so that every 100-byte string lies in one; only texts beyond 8 MB have several."""
    for i in range(0, max(len(text) - DEPTH + 1, 1), size):
        yield i, text[i : i + size + DEPTH - 1]


def text_runs(ids: list[int], texts: list[bytes]):
    """Arrays (bucket, class, doc_id, start, length) for chunks of a batch's texts."""
    held: list[tuple[int, int, bytes]] = []
    total = 0

    def flush():
        nonlocal held, total
        bucket, kind, number, start, length = runs_of([t for _, _, t in held])
        doc, base = np.array([d for d, _, _ in held], np.int64), np.array([o for _, o, _ in held], np.int64)
        held, total = [], 0
        return bucket, kind, doc[number], start + base[number], length

    for doc, text in zip(ids, texts):
        for offset, piece in pieces(text):
            if len(piece) >= DEPTH:
                if held and total + len(piece) > CHUNK:
                    yield flush()
                held.append((doc, offset, piece))
                total += len(piece)
    if held:
        yield flush()


#: What a row of runs says: settled as removed bytes [a, b); to be refined in its bucket; a bucket's marker; to be
#: refined string by string. Markers sort first.
GONE, OPEN, MARK, APART = 1, 2, 3, 4
RUNS = "bucket long, kind long, doc_id long, a long, b long, state int"


def _rows(bucket, kind, doc, a, b, state) -> pa.RecordBatch:
    n = len(bucket)
    return pa.RecordBatch.from_pydict({"bucket": bucket, "kind": kind, "doc_id": doc, "a": a, "b": b, "state": np.broadcast_to(np.asarray(state, np.int32), n)})


def joined_intervals(doc: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Touching intervals of one document as one."""
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    new, top = np.ones(len(doc), bool), 0
    if len(doc):
        change = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        base = np.repeat(np.arange(len(change), dtype=np.int64), np.diff(np.append(change, len(doc))))
        lift = int(b.max()) + 1
        reach = np.maximum.accumulate(b + base * lift)
        new[1:] = (a[1:] + base[1:] * lift) > reach[:-1]
        top = np.maximum.reduceat(b, np.flatnonzero(new))
    return doc[new], a[new], top if len(doc) else b


def later(group_first: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows whose (doc, start) is not that of the first row of their group."""
    lead = np.maximum.accumulate(np.where(group_first, np.arange(len(doc)), 0))
    return (doc != doc[lead]) | (start != start[lead])


def settle_runs(bucket, kind, doc, start, length):
    """A task's runs: what it can settle, and what has to travel."""
    order = np.lexsort((start, doc, kind, bucket))
    bucket, kind, doc, start, length = bucket[order], kind[order], doc[order], start[order], length[order]
    new_bucket = np.append(True, bucket[1:] != bucket[:-1])
    new_kind = new_bucket | np.append(True, kind[1:] != kind[:-1])
    gone = later(new_kind, doc, start)
    end = start + length - 1 + DEPTH
    d, a, b = joined_intervals(doc[gone], start[gone], end[gone])
    # settled intervals and hot runs need no bucket any more; they are dealt by their document
    yield _rows(d * 1000003, np.zeros(len(d), np.int64), d, a, b, GONE)
    group = np.cumsum(new_bucket) - 1
    hot = np.bincount(group, weights=new_kind)[group] > HOT
    apart, mark = hot & new_kind, hot & new_bucket
    n = int(mark.sum())
    yield _rows(bucket[mark], np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), MARK)
    yield _rows(doc[apart] * 1000003, bucket[apart], doc[apart], start[apart], start[apart] + length[apart], APART)
    rest = new_kind & ~hot
    yield _rows(bucket[rest], kind[rest], doc[rest], start[rest], start[rest] + length[rest], OPEN)


def _runs(batches):
    held, size = [], 0
    for batch in batches:
        texts = [(t or "").encode() for t in batch["text"].to_pylist()]
        for arrays in text_runs(batch["doc_id"].to_pylist(), texts):
            held.append(arrays)
            size += len(arrays[0])
        if size > HELD:
            yield from settle_runs(*map(np.concatenate, zip(*held)))
            held, size = [], 0
    if held:
        yield from settle_runs(*map(np.concatenate, zip(*held)))


def _refine(batches):
    """Buckets in order, markers first, then by class, document and start; a bucket may go on in the next batch."""
    carry, went_on = None, (False, False)
    for batch in batches:
        bucket, kind, doc, a, b, state = (batch[c].to_numpy() for c in ("bucket", "kind", "doc_id", "a", "b", "state"))
        through = (state == GONE) | (state == APART)
        if through.any():
            yield _rows(kind[through], kind[through], doc[through], a[through], b[through], state[through])
        part = [x[~through] for x in (bucket, kind, doc, a, b, state)]
        if not len(part[0]):
            continue
        sent = np.zeros(len(part[0]), bool)
        if carry is not None:
            if carry[0][0] != part[0][0]:
                went_on = (False, False)  # that bucket is over, with nothing left to say
            sent = np.append(True, sent) if went_on[0] or carry[0][0] != part[0][0] else np.append(False, sent)
            part = [np.concatenate([c, x]) for c, x in zip(carry, part)]
        bucket, kind, doc, a, b, state = part
        new_bucket = np.append(True, bucket[1:] != bucket[:-1])
        new_kind = new_bucket | np.append(True, (kind[1:] != kind[:-1]) | (state[1:] != state[:-1]))
        at = np.flatnonzero(new_bucket)
        group = np.cumsum(new_bucket) - 1
        marked = np.maximum.reduceat(state == MARK, at)
        several = marked | (np.add.reduceat(new_kind.astype(np.int64), at) > 1)
        several[0] |= went_on[0]
        marked[0] |= went_on[1]
        run = state == OPEN
        gone = run & later(new_kind, doc, a)
        yield _rows(bucket[gone], kind[gone], doc[gone], a[gone], b[gone] - 1 + DEPTH, GONE)
        send = run & new_kind & ~sent & several[group]
        yield _rows(bucket[send], kind[send], doc[send], a[send], b[send], np.where(marked[group[send]], APART, OPEN))
        # the next batch needs the first run of the class that the last bucket stands at, and what is known of the bucket
        top = np.flatnonzero(new_kind)[-1:]
        carry, went_on = [x[top].copy() for x in part], (bool(several[-1]), bool(marked[-1]))


def _pack(batch: pa.RecordBatch) -> dict:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    return {"doc_id": batch["doc_id"], "packed": pa.array([pack((t or "").encode()) for t in batch["text"].to_pylist()], pa.binary())}


STRINGS = "bucket long, doc_id long, a long, b long, context binary"


def _strings(batches):
    """Runs to be refined: with their bytes for their bucket, or string by string, each named string once per task."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        nonlocal held, size
        if held:
            name, doc, at = map(np.concatenate, zip(*held))
            held, size = [], 0
            order = np.lexsort((at, doc, name))
            name, doc, at = name[order], doc[order], at[order]
            gone = later(np.append(True, name[1:] != name[:-1]), doc, at)
            # what this task can settle goes on as intervals, with a context of no bytes
            d, a, b = joined_intervals(doc[gone], at[gone], at[gone] + DEPTH)
            yield pa.RecordBatch.from_pydict({"bucket": d, "doc_id": d, "a": a, "b": b, "context": pa.array([b""] * len(d), pa.binary())})
            left = ~gone
            yield pa.RecordBatch.from_pydict({"bucket": name[left], "doc_id": doc[left], "a": at[left], "b": at[left] + 1, "context": pa.nulls(int(left.sum()), pa.binary())})

    for batch in batches:
        out: dict[str, list] = {"bucket": [], "doc_id": [], "a": [], "b": [], "context": []}
        for doc, packed, runs in zip(batch["doc_id"].to_pylist(), batch["packed"].to_pylist(), batch["runs"].to_pylist()):
            text = unpack(packed)
            for r in runs:
                a, b = r["a"], r["b"]
                piece = text[a : b - 1 + DEPTH]
                if r["state"] == APART:
                    name = depth_names(np.frombuffer(piece, np.uint8))[1].view(np.int64)
                    held.append((name, np.full(len(name), doc, np.int64), np.arange(a, b)))
                    size += len(name)
                else:
                    for k, v in zip(out, (r["bucket"], doc, a, b, piece)):
                        out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int64()), pa.array(out["doc_id"], pa.int64()), pa.array(out["a"], pa.int64()), pa.array(out["b"], pa.int64()), pa.array(out["context"], pa.binary())], names=list(out))
        if size > HELD:
            yield from flush()
    yield from flush()


def _settle_strings(t: pa.Table):
    """Of equal strings all but the earliest; ``t`` has whole buckets."""
    bucket, doc, a, b = (t[c].to_numpy() for c in ("bucket", "doc_id", "a", "b"))
    context = t["context"].to_pylist()
    length = np.array([-1 if c is None else len(c) for c in context])
    single, done, run = length == -1, length == 0, length > 0
    names, docs, at = [bucket[single]], [doc[single]], [a[single]]
    rows = np.flatnonzero(run)
    for i in range(0, len(rows), 4096):
        part = rows[i : i + 4096]
        data = np.frombuffer(b"".join(context[k] for k in part), np.uint8)
        strings = depth_names(data)[1].view(np.int64)
        count = (b - a)[part]
        first = np.cumsum(length[part]) - length[part]
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        names.append(strings[np.repeat(first, count) + inner])
        docs.append(np.repeat(doc[part], count))
        at.append(np.repeat(a[part], count) + inner)
    name, d, s = map(np.concatenate, (names, docs, at))
    order = np.lexsort((s, d, name))
    name, d, s = name[order], d[order], s[order]
    gone = later(np.append(True, name[1:] != name[:-1]), d, s) if len(name) else np.zeros(0, bool)
    d, s, e = joined_intervals(*(np.concatenate(x) for x in ((d[gone], doc[done]), (s[gone], a[done]), (s[gone] + DEPTH, b[done]))))
    yield pa.RecordBatch.from_pydict({"doc_id": d, "a": s, "b": e})


def _equal_strings(batches):
    """Rows sorted by bucket; the last bucket of a batch may go on in the next."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if rest is not None and rest.num_rows:
            t = pa.concat_tables([rest, t])
        bucket = t["bucket"].to_numpy()
        whole = int(np.searchsorted(bucket, bucket[-1]))
        rest = t.slice(whole)
        if whole:
            yield from _settle_strings(t.slice(0, whole))
    if rest is not None and rest.num_rows:
        yield from _settle_strings(rest)


def _cut(batch: pa.RecordBatch) -> dict:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
    for packed, spans in zip(batch["packed"].to_pylist(), batch["spans"].to_pylist()):
        text = unpack(packed)
        kept, at, n_spans = [], 0, 0
        for s in sorted((s["a"], s["b"]) for s in spans or ()):
            if s[0] > at or not n_spans:
                kept.append(text[at : s[0]])
                n_spans += 1
            at = max(at, s[1])
        kept.append(text[at:])
        left = b"".join(kept)
        for k, v in zip(out, (len(text), len(text) - len(left), n_spans, left)):
            out[k].append(v)
    return {"doc_id": batch["doc_id"], **{k: pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")}, "kept": pa.array(out["kept"], pa.binary())}


def removed(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """(doc_id, a, b): byte intervals, possibly overlapping, that repeat earlier strings."""
    spark = docs.sparkSession
    runs = docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(_runs, RUNS)
    order = ("bucket", F.desc("state"), "kind", "doc_id", "a")
    refined = materialized(runs.repartition("bucket").sortWithinPartitions(*order).mapInArrow(_refine, RUNS), "suffix-runs")
    open_ = refined.where(F.col("state").isin(OPEN, APART)).groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("bucket", "a", "b", "state")).alias("runs"))
    asked = packed.join(open_, F.col("doc_id") == F.col("of")).select("doc_id", "packed", "runs")
    strings = asked.mapInArrow(_strings, STRINGS)
    equal = strings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_equal_strings, "doc_id long, a long, b long")
    return refined.where(F.col("state") == GONE).select("doc_id", "a", "b").unionByName(equal)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept (binary); one row per row.

    Texts travel compressed, and both joins by document read one exchange.
    """
    packed = map_rows(docs.select("doc_id", "text"), _pack, "doc_id long, packed binary")
    known = packed.where("doc_id IS NOT NULL")
    nameless = map_rows(docs.select("doc_id", "text").where("doc_id IS NULL"), _pack, "doc_id long, packed binary")
    spans = removed(docs, known).groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    both = known.join(spans, F.col("doc_id") == F.col("of"), "left").select("doc_id", "packed", "spans")
    none = nameless.select("doc_id", "packed", F.lit(None).cast("array<struct<a:bigint,b:bigint>>").alias("spans"))
    return map_rows(both.unionByName(none), _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
