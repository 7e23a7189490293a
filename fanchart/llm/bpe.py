"""Byte-level BPE by the compatibility of neighbouring tokens.

A BPE tokenization is right exactly when no merge could still happen across the border of two neighbours. Each merge
(u, v) -> uv bars v behind u from its rank on, so a token t may follow p unless some v on t's left ends is barred
behind some x on p's right ends, by a merge older than those that hid x and v. These tests take the place of the
states and transitions of a compiled automaton, whose table would be quadratic in the vocabulary; results of pairs
that occur are kept, up to a bound.

Of all token paths that spell a word exactly one passes every test. The search tries the longest token first and
remembers positions without an accepted rest, so it is linear in practice. Decoding joins the tokens' bytes.

Words are cut with the vocabulary's own pattern. A worker keeps a bounded table of words that it has encoded.

Defined results: null is the empty text, with no tokens; the special token's string inside a text is that token;
rows repeat with their own result; texts are taken whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import json
import struct
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from fanchart.llm.common import map_rows, table

#: Fixed value: the pattern of words of this family of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that one generation of a worker's table holds; two generations are kept.
KEEP = 150_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Kept(dict):
    """A bounded table that computes what it lacks."""

    def __init__(self, compute, keep: int = KEEP):
        super().__init__()
        self.compute, self.keep, self.old = compute, keep, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.keep:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Automaton:
    def __init__(self, labels: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        """``labels``: every token's bytes and id, single bytes included; ``merges`` by rank."""
        self.size = max(labels.values()) + 1
        self.label = {i: b for b, i in labels.items()}
        self.length = {i: len(b) for i, b in self.label.items()}
        # (end that stays visible, rank of the merge that hides it) from the token itself inwards
        never = len(merges) + 1
        self.left_ends: dict[int, list[tuple[int, int]]] = {}
        self.right_ends: dict[int, list[tuple[int, int]]] = {}
        self.bar: dict[int, int] = {}
        for i, b in self.label.items():
            if len(b) == 1:
                self.left_ends[i] = self.right_ends[i] = [(i, never)]
        for rank, (u, v) in enumerate(merges):
            a, b, c = labels[u], labels[v], labels[u + v]
            self.bar.setdefault(a * self.size + b, rank)
            if c not in self.left_ends:
                self.left_ends[c] = [(c, never), (a, rank), *self.left_ends[a][1:]]
                self.right_ends[c] = [(c, never), (b, rank), *self.right_ends[b][1:]]
        self.step = Kept(self._step, 1_000_000)
        self.arcs: dict[bytes, int] = {}
        for b, i in labels.items():
            if i in self.left_ends:
                for k in range(1, len(b)):
                    self.arcs.setdefault(b[:k], -1)
                self.arcs[b] = i
        self.shorter: dict[int, int] = {}
        for i in self.left_ends:
            b = self.label[i]
            self.shorter[i] = next((t for k in range(len(b) - 1, 0, -1) if (t := self.arcs.get(b[:k], -1)) >= 0), -1)

    def _step(self, pair: int) -> bool:
        """Whether the automaton has a transition from the state behind ``p`` on ``t``; pair = p * size + t."""
        p, t = divmod(pair, self.size)
        get, size = self.bar.get, self.size
        for x, hidden in self.right_ends[p]:
            for v, covered in self.left_ends[t]:
                rank = get(x * size + v)
                if rank is not None and rank < hidden and rank <= covered:
                    return False
        return True

    def longest(self, word: bytes, at: int) -> int:
        get, best, end, n = self.arcs.get, -1, at + 1, len(word)
        while end <= n and (t := get(word[at:end])) is not None:
            if t >= 0:
                best = t
            end += 1
        return best

    def encode(self, word: bytes) -> list[int]:
        if (t := self.arcs.get(word, -1)) >= 0 and len(word) == 1:
            return [t]
        n, at, path, dead = len(word), 0, [], set()
        step, length, shorter, size = self.step, self.length, self.shorter, self.size
        t = self.longest(word, 0)
        while at < n:
            while t >= 0:
                end = at + length[t]
                if end not in dead and (not path or step[path[-1] * size + t]):
                    break
                t = shorter[t]
            if t >= 0:
                path.append(t)
                at = end
                t = self.longest(word, at) if at < n else -1
            else:
                dead.add(at)
                t = path.pop()
                at -= length[t]
                t = shorter[t]
        return path


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, spec: dict):
        symbols = byte_symbols()
        raw = lambda s: bytes(symbols[c] for c in s)
        labels = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.automaton = Automaton(labels, [(raw(a), raw(b)) for a, b in pairs])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = dict(self.automaton.label) | {i: s.encode() for s, i in self.special.items()}
        self.words = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        encode, pack = self.automaton.encode, struct.pack
        self.packed = Kept(lambda w: pack(f"<{len(ids := encode(w.encode()))}I", *ids))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        look = self.packed.__getitem__
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(map(look, self.words(text)))
        return b"".join(struct.pack("<I", self.special[part]) if part in self.special else b"".join(map(look, self.words(part))) for part in self.cut.split(text) if part)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def codec(spec: str) -> Codec:
    return Codec(json.loads(spec))


def _encode(batch: pa.RecordBatch, spec) -> dict:
    c = codec(spec.value)
    return {"doc_id": batch["doc_id"], "ids": pa.array([c.encode(t or "") for t in batch["text"].to_pylist()], pa.binary())}


def _decode(batch: pa.RecordBatch, spec) -> dict:
    c = codec(spec.value)
    return {"doc_id": batch["doc_id"], "text": pa.array([c.decode(b) for b in batch["ids"].to_pylist()], pa.string())}


def _digests(batch: pa.RecordBatch, spec) -> dict:
    c, n, a, b = codec(spec.value), [], [], []
    for text in batch["text"].to_pylist():
        ids = c.encode(text or "")
        n.append(len(ids) // 4)
        a.append(hashlib.sha256(ids).hexdigest())
        b.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
    return {"doc_id": batch["doc_id"], "n_tokens": pa.array(n, pa.int64()), "ids_sha256": a, "decoded_sha256": b}


def _spec(spark: SparkSession, path: str):
    """The vocabulary file, read once on the driver; its size does not depend on the data."""
    return spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids): little-endian unsigned 32-bit integers, one row per row."""
    return map_rows(docs.select("doc_id", "text"), _encode, "doc_id long, ids binary", _spec(docs.sparkSession, path))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text)."""
    return map_rows(encoded.select("doc_id", "ids"), _decode, "doc_id long, text string", _spec(encoded.sparkSession, path))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode in one pass over the texts, keeping digests of both."""
    return map_rows(docs.select("doc_id", "text"), _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _spec(docs.sparkSession, path))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary())
