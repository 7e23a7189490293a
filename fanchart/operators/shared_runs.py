"""Longest runs of words that documents share with references, of any length.

A run has a name: names of 1, 2, 4, … words are made from two names of half the length, any other length is a chain of
those. Two runs are the same when their names are, so documents and references only ever meet on names, never
position by position: a passage that a third of the texts hold is one name on the reference side and one row per
document on the other.

First every document proposes its longest run up to ``SEED`` words whose name is in a filter of the references' names, and
the names themselves confirm or refute it; a refuted document proposes less. Documents with a run of ``SEED`` words then
grow it, doubling the step while some run goes on and halving it afterwards, so a run of n words takes about
2 log2(n / SEED) rounds over the documents that have one.

Filters are bitmaps of a fixed size, set by an aggregation. A full filter makes more proposals, never another result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanchart.sources.materialize import materialized

WORDS = r"[^\s]+"
#: Words up to which all lengths are looked up at once; a power of two.
SEED = 8
#: Bits of a filter; each name sets two.
FILTER_BITS = 1 << 26
_BUCKET = 32768  # bits of one bitmap of Spark's bitmap aggregate

U = np.uint64
_LEFT, _RIGHT, _SIZE = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


class Runs:
    """Names of the runs of one text from the hashes of its words."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.doubled = [words.view(np.uint64)]

    def _power(self, k: int) -> np.ndarray:
        while len(self.doubled) <= k:
            half, size = self.doubled[-1], 1 << (len(self.doubled) - 1)
            self.doubled.append(_mix(half[:-size] * _LEFT + half[size:] * _RIGHT) if len(half) > size else half[:0])
        return self.doubled[k]

    def names(self, length: int, at: np.ndarray | None = None) -> np.ndarray:
        """Names of the runs of ``length`` words from the given places on, or from all that have as many."""
        at = np.arange(max(self.n - length + 1, 0)) if at is None else at
        name, left = None, length
        for k in range(length.bit_length() - 1, -1, -1):
            if left >> k:
                part = self._power(k)[at]
                name = part if name is None else _mix(name * _LEFT + part * _RIGHT)
                at, left = at + (1 << k), left - (1 << k)
        return _mix(name + U(length * int(_SIZE) % (1 << 64))).view(np.int64)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.array([v.tolist() for v in values], pa.list_(kind))


def _words(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _bits(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return names & (FILTER_BITS - 1), (names >> 32) & (FILTER_BITS - 1)


def _passes(bitmap: np.ndarray, names: np.ndarray) -> np.ndarray:
    first, second = _bits(names)
    return ((bitmap[first >> 3] >> (first & 7)) & (bitmap[second >> 3] >> (second & 7)) & 1).astype(bool)


def _filter(names: DataFrame) -> tuple:
    """A broadcast bitmap of FILTER_BITS bits of the ``name`` column, and the values of ``length``."""
    low = F.col("name").bitwiseAND(FILTER_BITS - 1)
    high = F.shiftright("name", 32).bitwiseAND(FILTER_BITS - 1)
    bit = names.select("length", F.explode(F.array(low, high)).alias("bit")).select("length", F.floor(F.col("bit") / _BUCKET).alias("bucket"), (F.col("bit") % _BUCKET).alias("bit"))
    out, lengths = np.zeros(FILTER_BITS // 8, np.uint8), set()
    for r in bit.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"), F.collect_set("length").alias("lengths")).collect():
        out[r.bucket * (_BUCKET // 8) : (r.bucket + 1) * (_BUCKET // 8)] = np.frombuffer(r.bits, np.uint8)
        lengths.update(r.lengths)
    return names.sparkSession.sparkContext.broadcast(out), sorted(lengths)


def _names_of(lengths: list[int], within=None):
    """(length, name) of all runs of the lengths; of those in the filter, where there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in _words(batch["words"]):
                runs = Runs(words)
                for length in lengths:
                    if length <= runs.n:
                        names = np.unique(runs.names(length))
                        names = names if within is None else names[_passes(within.value, names)]
                        if len(names):
                            yield pa.RecordBatch.from_pydict({"length": pa.array(np.full(len(names), length, np.int32)), "name": pa.array(names)})

    return lambda refs: refs.mapInArrow(run, "length int, name long")


def _propose(filter_, seed: int):
    """The longest run below ``below`` words in the filter, with its places and names; length 0 without one."""

    def run(batches):
        for batch in batches:
            length, names, places = [], [], []
            for words, below in zip(_words(batch["words"]), batch["below"].to_pylist()):
                runs, at = Runs(words), np.arange(len(words))
                found = 0, at[:0], at[:0]
                # what begins a run in the references is in the filter as well
                for n in range(1, below):
                    at = at[: np.searchsorted(at, runs.n - n, side="right")]
                    all_ = runs.names(n, at)
                    passing = _passes(filter_.value, all_)
                    at = at[passing]
                    if not len(at):
                        break
                    found = n, all_[passing], at
                length.append(found[0])
                names.append(found[1])
                places.append(found[2])
            # only documents that may grow keep their words
            kept = pa.array([w.as_py() if n == seed else None for n, w in zip(length, batch["words"])], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "words": kept, "length": pa.array(length, pa.int32()), "names": _lists(names, pa.int64()), "places": _lists(places, pa.int32())})

    return run


def _grow(batches):
    """Names of each document's runs, grown by its step."""
    for batch in batches:
        names, places, lengths = [], [], []
        for words, length, step, at in zip(_words(batch["words"]), batch["length"].to_pylist(), batch["step"].to_pylist(), batch["places"].to_pylist()):
            grown, at = length + step, np.array(at, np.int64)
            at = at[at + grown <= len(words)]
            lengths.append(grown)
            names.append(Runs(words).names(grown, at) if len(at) else np.zeros(0, np.int64))
            places.append(at)
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "length": pa.array(lengths, pa.int32()), "names": _lists(names, pa.int64()), "places": _lists(places, pa.int32())})


def _hits(proposed: DataFrame, known: DataFrame) -> DataFrame:
    """(hit, at): documents with the places whose name a reference has."""
    pairs = proposed.select("doc_id", "length", F.explode(F.arrays_zip("names", "places")).alias("p")).select("doc_id", "length", F.col("p.names").alias("name"), F.col("p.places").alias("place"))
    return pairs.join(known, ["length", "name"], "left_semi").groupBy(F.col("doc_id").alias("hit")).agg(F.collect_list("place").alias("at"))


def longest_shared_run(docs: DataFrame, refs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, text) and reference texts -> doc_id, longest_run: the most consecutive words that a document shares with
    one reference, 0 without any; one row per document. Null texts have no words; doc_id names a document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORDS), F.lit(0)), lambda w: F.xxhash64(w)).alias("words")
    words = docs.select("doc_id", hashed)
    # references fold to distinct texts
    refs = materialized(refs.select(hashed).where(F.size("words") > 0).distinct(), "run-refs")
    known = materialized(_names_of(list(range(1, seed + 1)))(refs).distinct(), "run-names")
    filter_, _ = _filter(known)
    schema = f"doc_id {kind}, words array<long>, length int, names array<long>, places array<int>"
    open_ = words.withColumn("below", F.lit(seed + 1))
    done, grown = [], []
    while True:
        proposed = materialized(open_.mapInArrow(_propose(filter_, seed), schema), "run-proposed")
        hits = materialized(_hits(proposed, known), "run-hits")
        met = proposed.join(hits, F.col("doc_id") == F.col("hit"), "left")
        done.append(proposed.where("length = 0").select("doc_id", "length"))
        done.append(met.where(F.col("hit").isNotNull() & (F.col("length") < seed)).select("doc_id", "length"))
        grown.append(met.where(F.col("hit").isNotNull() & (F.col("length") == seed)).select("doc_id", "words", "length", F.col("at").alias("places")))
        refuted = materialized(met.where(F.col("hit").isNull() & (F.col("length") > 0)).select(F.col("doc_id").alias("again"), F.col("length").alias("below")), "run-refuted")
        open_ = words.join(refuted, F.col("doc_id") == F.col("again")).select("doc_id", "words", "below")
        if refuted.isEmpty():
            break
    first, *more = grown
    for g in more:
        first = first.unionByName(g)
    state = materialized(first.select("*", F.lit(seed).alias("step"), F.lit(True).alias("up")), "run-state")
    while not state.isEmpty():
        proposed = materialized(state.mapInArrow(_grow, f"doc_id {kind}, length int, names array<long>, places array<int>"), "run-grown")
        # as many lengths as documents differ in, at most the longest shared run over the step
        within, lengths = _filter(proposed.select("length", F.explode("names").alias("name")))
        hits = _hits(proposed, _names_of(lengths, within)(refs))
        met = state.join(hits, F.col("doc_id") == F.col("hit"), "left")
        hit = F.col("hit").isNotNull()
        up = F.col("up") & hit
        met = materialized(met.select(
            "doc_id", "words", F.when(hit, F.col("length") + F.col("step")).otherwise(F.col("length")).alias("length"), F.coalesce("at", "places").alias("places"),
            F.when(up, F.col("step") * 2).otherwise(F.floor(F.col("step") / 2)).cast("int").alias("step"), up.alias("up"),
        ), "run-state")
        done.append(met.where("step = 0").select("doc_id", "length"))
        state = met.where("step > 0")
    out, *more = done
    for d in more:
        out = out.unionByName(d)
    return out.select("doc_id", F.col("length").alias("longest_run"))
