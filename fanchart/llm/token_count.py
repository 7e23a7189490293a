"""Count tokens of a piece vocabulary by merging pairs, without ids.

A segment's symbols form a linked list; a heap holds its adjacent pairs that are pieces, by rank and place. The
lowest-ranked pair is merged again and again, new neighbours join the heap, entries whose symbols have changed are
passed over. The count is the number of initial symbols less the number of merges; a character outside the
vocabulary counts one symbol per UTF-8 byte.

No piece spans the places where texts are cut into segments (before a space that follows another character, around
newlines, before a full stop or comma); this is checked on the vocabulary, and a text is one segment if it fails.
Merges on both sides of such a place are independent, so counts add up, and a worker counts a repeated segment once.

Defined results: null is the empty text, with 0 bytes and 0 tokens; special strings in a text are ordinary text;
repeated rows repeat their result; texts are taken whole.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fanchart.llm.bpe import Kept, vocabulary
from fanchart.llm.common import map_rows, table

SPACE = "▁"
LIMIT = 4096
#: Kinds of pieces in the model file.
NORMAL, USER, UNUSED = 1, 4, 5


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialized message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n


class Counter:
    def __init__(self, model: bytes):
        self.rank: dict[str, float] = {}
        kinds = set()
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                kind = piece.get(3, NORMAL)
                kinds.add(kind)
                if kind == NORMAL:
                    self.rank[piece[1].decode()] = -struct.unpack("<f", piece[2])[0]
            elif number == 3:
                norm = dict(fields(value))
                if norm.get(1) != b"identity" or norm.get(4, 1):
                    raise ValueError("only models that keep texts as they are can be counted")
        if kinds & {USER, UNUSED}:
            raise ValueError("user-defined and unused pieces are not supported")
        inner = {(a, b) for p in self.rank for a, b in zip(p, p[1:])}
        stops = [c for c in ".," if all(a in ".," for a, b in inner if b == c)]
        apart = not any(b == SPACE and a != SPACE for a, b in inner) and not any("\n" in p for p in self.rank)
        stop = re.escape("".join(stops))
        plain = f"[^{SPACE}\n{stop}]"
        begin = f"{SPACE}*[{stop}]*" if stops else f"{SPACE}*"
        self.segments = re.compile(f"{begin}{plain}+|{begin}(?<=[{SPACE}{stop}])").findall if apart else lambda t: [t]
        self.newline = len("\n".encode()) if apart else 0
        self.counts = Kept(self.count_segment)

    def count_segment(self, segment: str) -> int:
        rank, symbol = self.rank, list(segment)
        n = len(symbol)
        count = sum(1 if c in rank else len(c.encode()) for c in symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(segment[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            left = symbol[i]
            j = after[i]
            if not left or j >= n or len(left) + len(symbol[j]) != size:
                continue
            merged = left + symbol[j]
            symbol[i], symbol[j] = merged, ""
            k = after[i] = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if (r := rank.get(merged + symbol[k])) is not None:
                    heapq.heappush(heap, (r, i, size + len(symbol[k])))
            h = before[i]
            if h >= 0 and (r := rank.get(symbol[h] + merged)) is not None:
                heapq.heappush(heap, (r, h, len(symbol[h]) + size))
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        look, lines = self.counts.__getitem__, text.count("\n") * self.newline
        return lines + sum(map(look, self.segments(SPACE + text.replace(" ", SPACE))))


@lru_cache(2)
def counter(model: bytes) -> Counter:
    return Counter(model)


def _count(batch: pa.RecordBatch, model) -> dict:
    c, texts = counter(model.value), batch["text"].to_pylist()
    return {"doc_id": batch["doc_id"], "n_bytes": pa.array([len((t or "").encode()) for t in texts], pa.int64()), "n_tokens": pa.array([c.count(t or "") for t in texts], pa.int64())}


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit; the model file is read once on the driver."""
    model = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    out = map_rows(docs.select("doc_id", "text"), _count, "doc_id long, n_bytes long, n_tokens long", model)
    return out.withColumn("over_limit", out["n_tokens"] > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
