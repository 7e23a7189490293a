"""Pack token sequences into windows by non-negative least squares over their length histogram.

A document's tokens end with ``END``. Whole windows of a long document are sequences of their own; what is left is a
piece shorter than a window. The plan needs the histogram of those lengths only: all combinations of two or three
lengths that fill a window exactly are enumerated, repeat counts are the non-negative least-squares solution
against the histogram, rounded and held to what is there. Residual lengths are packed greedily, the longest that fits
first; where none fits, the shortest one is cut, and its end becomes a length of its own. Greedy steps take the lengths
that most pieces have first and repeat while those last, so the number of steps follows the window and the logarithm of
the counts, not the number of documents. What does not fill a last window goes to sequences of powers of two, which
need no padding.

The plan gives each length a list of intervals: its k-th piece takes the slot of the interval that holds k. Pieces of a
length are numbered by the task that tokenized them, from the counts of the tasks before, so a length that many
documents share is numbered by many tasks. The plan is broadcast; its size is bounded by the window (about
window ** 2 / 4 intervals and those of the greedy steps).

Defined results: null is the empty text, which has the token ``END`` alone; rows repeat with pieces of their own; texts
are taken whole, whatever their length; an empty table gives no pieces. A sequence id is the number of a planned
sequence, or beyond those a number made of task and place for a whole window. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fanchart.llm.bpe import PATTERN, byte_symbols, vocabulary
from fanchart.llm.common import map_rows, table
from fanchart.sources.materialize import materialized

WINDOW, END = 1024, 0
#: Rounds of the least-squares solver.
ROUNDS = 400
#: Bits of a task's whole windows in a sequence id.
TASK_BITS = 36
_SHIFT = 50


# ---- tokens ----------------------------------------------------------------------------------------


@lru_cache(2)
def encoder(spec: str):
    """Text -> ids of a byte-level vocabulary whose ids follow its merges; checked on the file."""
    model = json.loads(spec)
    symbols = byte_symbols()
    raw = lambda s: bytes(symbols[c] for c in s)
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {raw(s): i for s, i in model["model"]["vocab"].items() if s not in special}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
    made = [ranks[raw(a) + raw(b)] for a, b in pairs]
    if made != sorted(made) or max(ranks.values()) + len(special) > 65535:
        raise ValueError("only vocabularies of 16 bits whose ids rise with the rank of their merge")
    e = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    library = Tokenizer.from_str(spec)

    def encode(text: str) -> np.ndarray:
        try:
            return e.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its pattern matcher gives up on runs of about a million blanks
            return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def _tokenize(spec, window: int):
    def run(batches):
        encode, task = encoder(spec.value), TaskContext.get().partitionId()
        seen, windows = np.zeros(window, np.int64), 0
        for batch in batches:
            ids, size, place, before = [], [], [], []
            for text in batch["text"].to_pylist():
                t = np.append(encode(text or ""), END).astype("<u2")
                whole, rest = divmod(len(t), window)
                ids.append(t.tobytes())
                size.append(len(t))
                place.append(int(seen[rest]))
                before.append(windows)
                seen[rest] += 1
                windows += whole
            n = len(size)
            size = np.array(size, np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "ids": pa.array(ids, pa.binary()), "doc_tokens": pa.array(size), "rest": pa.array(size % window), "task": pa.array(np.full(n, task, np.int64)),
                "place": pa.array(place, pa.int64()), "before": pa.array(before, pa.int64()),
            })

    return run


# ---- the plan --------------------------------------------------------------------------------------


def combinations(window: int, present: np.ndarray) -> np.ndarray:
    """(n, 3): lengths of two or three present pieces that fill the window, falling; 0 where there are two."""
    there = np.zeros(window, bool)
    there[present] = True
    there[0] = False
    a, b = (x.ravel() for x in np.meshgrid(present, present, indexing="ij"))
    c = window - a - b
    ok = (a >= b) & (b >= c) & (c >= 0)
    a, b, c = a[ok], b[ok], c[ok]
    ok = there[c] | (c == 0)
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def least_squares(columns: np.ndarray, wanted: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 that brings the lengths used by ``columns`` close to ``wanted``: accelerated projected gradients."""
    n = len(wanted)
    scale = float(wanted.max(initial=1))
    flat = columns.ravel()

    def used(x: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, weights=np.repeat(x, columns.shape[1]), minlength=n)
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return r[columns].sum(axis=1)

    v = np.ones(len(columns))
    for _ in range(20):
        v = back(used(v))
        v /= np.linalg.norm(v)
    step = 1.0 / (1.05 * float(np.linalg.norm(back(used(v)))))
    x = y = np.zeros(len(columns))
    t = 1.0
    target = wanted / scale
    for _ in range(rounds):
        r = used(y) - target
        r[0] = 0
        new = np.maximum(y - step * back(r), 0.0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


class Plan:
    """Intervals of piece numbers per length: first sequence, offset, tokens taken, first number of the cut-off end."""

    def __init__(self, histogram: np.ndarray, window: int = WINDOW):
        self.window, self.total = window, histogram.astype(np.int64).copy()
        self.total[0] = 0
        self.used = np.zeros(window, np.int64)
        self.sequences = 0
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.solve()
        self.fill()
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 6)
        self.key = (rows[:, 0] << _SHIFT) + rows[:, 1]
        self.low, self.sequence, self.offset, self.taken, self.next = rows[:, 1:].T
        del self.rows

    def left(self, length: int) -> int:
        return int(self.total[length] - self.used[length])

    def place(self, slots: list[tuple[int, int]], times: int) -> None:
        """``times`` sequences of the slots (length, taken)."""
        offset = 0
        for length, taken in slots:
            low = int(self.used[length])
            self.used[length] += times
            after = -1
            if taken < length:
                after = int(self.total[length - taken])
                self.total[length - taken] += times
            self.rows.append((length, low, self.sequences, offset, taken, after))
            offset += taken
        self.sequences += times

    def solve(self) -> None:
        present = np.flatnonzero(self.total)
        columns = combinations(self.window, present)
        if not len(columns):
            return
        x = np.rint(least_squares(columns, self.total.astype(float))).astype(np.int64)
        for i in np.argsort(-x, kind="stable"):
            if not x[i]:
                break
            lengths = [int(n) for n in columns[i] if n]
            times = min(int(x[i]), *(self.left(n) // lengths.count(n) for n in set(lengths)))
            if times > 0:
                self.place([(n, n) for n in lengths], times)

    def fill(self) -> None:
        """Common lengths first: a step takes lengths that last for ``least`` sequences, and ``common`` halves when none are left."""
        tokens = int((np.arange(self.window) * (self.total - self.used)).sum())
        common = int((self.total - self.used).max(initial=0))
        while tokens:
            if tokens < self.window:
                window, common, least = 1 << (tokens.bit_length() - 1), 1, 1
            else:
                window, least = self.window, max(1, common // 8)
            slots = self.sequence_of(window, common, least)
            if slots is None:
                common //= 2
                continue
            lengths = [n for n, _ in slots]
            times = min(self.left(n) // lengths.count(n) for n in set(lengths)) if window == self.window else 1
            self.place(slots, times)
            tokens -= times * window

    def sequence_of(self, window: int, common: int, least: int) -> list[tuple[int, int]] | None:
        """Slots that fill ``window``: the longest length that fits, or else the shortest one, cut."""
        left = self.total - self.used
        there = np.flatnonzero(left >= common)
        taken: dict[int, int] = {}
        room, slots = window, []
        while room:
            there = there[[left[n] // (taken.get(n, 0) + 1) >= least for n in there.tolist()]] if len(there) else there
            if not len(there):
                return None
            fit = int(np.searchsorted(there, room, side="right"))
            length = int(there[fit - 1]) if fit else int(there[0])
            taken[length] = taken.get(length, 0) + 1
            slots.append((length, min(length, room)))
            room -= slots[-1][1]
        return slots

    def slots(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the number-th pieces of a length: sequence, offset, tokens taken, number of the rest."""
        at = np.searchsorted(self.key, (length << _SHIFT) + number, side="right") - 1
        ahead = number - self.low[at]
        return self.sequence[at] + ahead, self.offset[at], self.taken[at], self.next[at] + ahead


# ---- pieces ----------------------------------------------------------------------------------------


def _pieces(batch: pa.RecordBatch, shared) -> dict:
    plan: Plan = shared.value
    window = plan.window
    size, rest, task, before = (batch[c].to_numpy() for c in ("doc_tokens", "rest", "task", "before"))
    whole = size // window
    row = np.repeat(np.arange(len(size)), whole)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
    # whole windows are numbered behind the planned sequences, by task and place
    sequence = plan.sequences + (task[row] << TASK_BITS) + before[row] + nth
    parts = [(row, nth * window, np.full(len(row), window), sequence, np.zeros(len(row), np.int64))]
    row = np.flatnonzero(rest)
    start, length, number = whole[row] * window, rest[row], batch["number"].to_numpy()[row]
    while len(row):
        sequence, offset, taken, after = plan.slots(length, number)
        parts.append((row, start, taken, sequence, offset))
        more = taken < length
        row, start, length, number = row[more], (start + taken)[more], (length - taken)[more], after[more]
    row, start, length, sequence, offset = (np.concatenate(x) for x in zip(*parts))
    ids = [np.frombuffer(b, "<u2") for b in batch["ids"].to_pylist()]
    cut = [ids[r][s : s + n].astype("<u4").tobytes() for r, s, n in zip(row.tolist(), start.tolist(), length.tolist())]
    return {
        "doc_id": batch["doc_id"].take(pa.array(row)), "start": pa.array(start), "length": pa.array(length), "ids": pa.array(cut, pa.binary()),
        "doc_tokens": pa.array(size[row]), "sequence_id": pa.array(sequence), "offset": pa.array(offset),
    }


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, text) -> doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset per piece."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    spec = spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))
    tokens = docs.select("doc_id", "text").mapInArrow(_tokenize(spec, window), f"doc_id {kind}, ids binary, doc_tokens long, rest long, task long, place long, before long")
    tokens = materialized(tokens, "pack-tokens")
    per_task = tokens.groupBy("rest", "task").agg(F.count("*").alias("n"))
    histogram = np.zeros(window, np.int64)
    for r in per_task.groupBy("rest").agg(F.sum("n").alias("n")).collect():
        histogram[r.rest] = r.n
    plan = Plan(histogram, window)
    earlier = W.partitionBy("rest").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    starts = per_task.select(F.col("rest").alias("r"), F.col("task").alias("t"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    numbered = tokens.join(starts, (F.col("rest") == F.col("r")) & (F.col("task") == F.col("t"))).withColumn("number", F.col("place") + F.col("first"))
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return map_rows(numbered.select("doc_id", "ids", "doc_tokens", "rest", "task", "before", "number"), _pieces, schema, spark.sparkContext.broadcast(plan))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
