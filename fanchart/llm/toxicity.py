"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded sample: the ``EXAMPLES`` labelled rows whose ids have the least digests. The space has all their
terms, words (runs of ASCII letters and digits and of all characters beyond ASCII, in lower case) and the first five
letters of longer words, by 64-bit names; document frequencies are counted over all documents. A
term's weight is (1 + log tf) * log((n + 1) / (df + 1)), scaled by what the sample's labels say about it: its evidence is its
documents times the divergence of their label rate from the sample's, and the scale rises from ``FLOOR`` for terms
without any towards 1 for evidence that chance does not reach. No term is left out, so texts without telling words
still meet the examples that share their rare ones. Words outside the space count in a text's length, as terms of
one document without evidence.

The index keeps each term's examples in order, cut into blocks of ``BLOCK`` examples, with the largest weight of each
block. A document's terms give every block an upper bound of the cosine; the quarter of the blocks with the highest bounds is
scored first, then every block whose bound reaches the ``NEIGHBOURS``-th best cosine so far, so the neighbours are those of a full scan. Ties go to
the earlier example. The score is the vote of the neighbours, weighted by cosine / (distance + 0.05), drawn towards
the sample's rate by one vote at cosine 0.525; documents that share no term with any example get the rate. The nearest
example and its cosine are returned as evidence.

Defined results: null and empty texts have no terms and get the sample's rate; without labelled rows every score is 0; several labels of one id:
the largest; null labels are unlabelled; repeated rows repeat their result; a null doc_id counts as held out. Labels
are read of rows that are not held out only, and texts are the only input of a score.
"""

from __future__ import annotations

import ctypes
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fanchart.llm.common import map_rows, table
from fanchart.llm.near_dup import BYTES, _powers, scramble
from fanchart.llm.resampling import IN_WORD, LOWER, _parts
from fanchart.sources.materialize import materialized

EXAMPLES, NEIGHBOURS, BLOCK = 2048, 16, 64
#: Scale of terms that say nothing about labels.
FLOOR = 0.005
#: Terms of more than one in COMMON examples are kept as columns.
COMMON = 16
#: Letters of a word's beginning.
HEAD = 5
FOLDS = 5
#: Bytes of text worked on at once; a longer text is taken alone, whole.
PART = 1 << 17
U = np.uint64
_HEADS = U(0x5851F42D4C957F2D)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


class Terms:
    """The terms of consecutive texts: per (text, term) its count; terms are 64-bit names, of words or of beginnings."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.texts = len(bounds) - 1
        b = LOWER[data]
        # capitals of the two-byte Latin letters
        b[1:][(b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)] += 0x20
        word = IN_WORD[b]
        cut = np.zeros(len(b) + 1, bool)
        cut[bounds] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | cut[1:-1]
        starts = np.flatnonzero(first)
        if not len(starts):
            self.of, self.term, self.count = (np.zeros(0, np.int64),) * 3
            self.names, self.is_word = np.zeros(0, np.uint64), np.zeros(0, bool)
            return
        of = np.searchsorted(bounds, starts, side="right") - 1
        # a text is below 2 GiB, so places have 32 bits
        number = np.cumsum(first, dtype=np.int32) - np.int32(1)
        at = np.arange(len(b), dtype=np.int32)
        at -= starts.astype(np.int32)[number]
        at[~word] = 0
        value = BYTES[b]
        value *= _powers(1 << max(int(at.max()), 63).bit_length())[at]
        value[~word] = 0
        del at
        begins = word & ((b & 0xC0) != 0x80)
        letters = np.cumsum(begins, dtype=np.int32)
        letters -= letters[starts][number]
        early = letters < HEAD
        del letters, number
        long = np.add.reduceat(begins.astype(np.int64), starts) > HEAD
        whole = scramble(np.add.reduceat(value, starts))
        value[~early] = 0
        heads = scramble(np.add.reduceat(value, starts) ^ _HEADS)[long]
        del value
        self.names, back = np.unique(np.concatenate([whole, heads]), return_inverse=True)
        self.is_word = np.zeros(len(self.names), bool)
        self.is_word[back[: len(whole)]] = True
        pair, self.count = np.unique(np.concatenate([of, of[long]]) * len(self.names) + back, return_counts=True)
        self.of, self.term = pair // len(self.names), pair % len(self.names)


def chunks(column: pa.Array):
    """(first row, end row, terms) of consecutive texts; small parts keep the work in a processor's cache."""
    for a, b, data, bounds in _parts(column, PART):
        yield a, b, Terms(data, bounds)


class Space:
    """The examples' terms with their weights; ``outside`` is the weight of any other word."""

    def __init__(self, names: np.ndarray, weight: np.ndarray | None = None, outside: float = 0.0):
        self.names, self.weight, self.outside = names, weight, outside

    def numbers(self, names: np.ndarray) -> np.ndarray:
        """Places in the space, -1 outside."""
        if not len(self.names):
            return np.full(len(names), -1)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, at, -1)

    def vectors(self, t: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, value), by text, of vectors of length 1 over the space's terms and the words outside."""
        number = self.numbers(t.names)
        per_name = np.where(number >= 0, self.weight[number] if len(self.names) else 0.0, np.where(t.is_word, self.outside, 0.0))
        v = (1 + np.log(t.count)) * per_name[t.term]
        size = np.sqrt(np.bincount(t.of, weights=v * v, minlength=t.texts))
        keep = (number[t.term] >= 0) & (v > 0)
        return t.of[keep], number[t.term[keep]], v[keep] / size[t.of[keep]]


def _ranges(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers of the ranges of n from a on, one range after the other."""
    return np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def one_thread() -> None:
    """Tasks share a machine's cores already, so the matrix library of a worker keeps to one thread; else its threads wait busily."""
    for lib in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        handle = ctypes.CDLL(str(lib))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(handle, name):
                getattr(handle, name)(1)
                break


class Index:
    """Postings by term, in blocks of examples with each block's largest weight. Terms of many examples, whose postings
    would be nearly whole, are dense columns: their part of the cosines is exact from the start and joins a block's bound."""

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int, block: int = BLOCK):
        self.n, self.block, self.blocks = n, block, -(-n // block)
        common = np.bincount(term, minlength=n_terms) * COMMON > max(n, COMMON)
        self.column = np.where(common, np.cumsum(common) - 1, -1)
        here = common[term]
        self.wide = (example[here].astype(np.int32), self.column[term[here]].astype(np.int32), weight[here])
        term, example, weight = term[~here], example[~here], weight[~here]
        order = np.lexsort((example, term))
        term, self.example, self.weight = term[order], example[order], weight[order]
        part = term * max(self.blocks, 1) + self.example // block
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
        # of each (term, block): its block, its postings, its largest weight
        self.of_block = (self.example[first] // block).astype(np.int32)
        self.begin, self.size = first, np.diff(np.append(first, len(part))).astype(np.int32)
        self.example = self.example.astype(np.int32)
        self.top = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.start = np.searchsorted(term[first], np.arange(n_terms + 1))
        self.dense = None

    def __getstate__(self):
        if self.wide is None:
            raise ValueError("an index in use has given up what it is sent with")
        return self.__dict__.copy()

    def nearest(self, of: np.ndarray, term: np.ndarray, value: np.ndarray, texts: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, example, cosine) of each text's k examples of highest positive cosine, best first, ties to the earlier example."""
        width, blocks = self.blocks * self.block, self.blocks
        if self.dense is None:
            one_thread()
            self.dense = np.zeros((int(self.column.max(initial=-1)) + 1, width))
            self.dense[self.wide[1], self.wide[0]] = self.wide[2]
            self.wide = None
        column = self.column[term]
        wide = np.zeros((texts, len(self.dense)))
        common = column >= 0
        wide[of[common], column[common]] = value[common]
        known = wide @ self.dense
        of, term, value = of[~common], term[~common], value[~common]
        many = self.start[term + 1] - self.start[term]
        part, of, value = _ranges(self.start[term], many), np.repeat(of, many), np.repeat(value, many)
        cell = of * blocks + self.of_block[part]
        bound = np.bincount(cell, weights=self.top[part] * value, minlength=texts * blocks) + known.reshape(texts * blocks, self.block).max(axis=1, initial=0.0)
        by_text = bound.reshape(texts, blocks)
        score = np.zeros(texts * width)
        # the most promising blocks set a floor, then all blocks above it
        few = min(max(2, blocks // 4), blocks)
        chosen = by_text >= -np.partition(-by_text, few - 1, axis=1)[:, few - 1 : few]
        done = np.zeros_like(chosen)
        for _ in range(2):
            here = chosen.reshape(-1)[cell]
            n = self.size[part[here]]
            at = _ranges(self.begin[part[here]], n)
            score += np.bincount(np.repeat(of[here] * width, n) + self.example[at], weights=self.weight[at] * np.repeat(value[here], n), minlength=len(score))
            score.reshape(texts, blocks, self.block)[chosen] += known.reshape(texts, blocks, self.block)[chosen]
            rows = score.reshape(texts, width)
            least = np.partition(rows, -min(k, width), axis=1)[:, -min(k, width)]
            done |= chosen
            chosen = (by_text >= least[:, None] - 1e-12) & (by_text > 0) & ~done
            if not chosen.any():
                break
        text, example = np.nonzero((rows >= least[:, None]) & (rows > 0))
        cosine = rows[text, example]
        order = np.lexsort((example, -cosine, text))
        text, example, cosine = text[order], example[order], cosine[order]
        place = np.arange(len(text)) - np.searchsorted(text, text)
        return text[place < k], example[place < k], cosine[place < k]


class Model:
    def __init__(self, space: Space, ids: np.ndarray, label: np.ndarray, of: np.ndarray, term: np.ndarray, value: np.ndarray):
        """``ids`` and ``label`` of the examples; (of, term, value) their vectors."""
        self.space, n = space, len(ids)
        # examples with like leading terms share blocks, which keeps block maxima sharp
        lead = np.full(n, -1)
        by_value = np.argsort(value, kind="stable")
        lead[of[by_value]] = term[by_value]
        order = np.lexsort((ids, lead))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.ids, self.label = ids[order], label[order].astype(float)
        self.index = Index(place[of] if n else of, term, value, n, len(space.names))
        self.rate = float(self.label.mean()) if n else 0.0

    def scores(self, column: pa.Array, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, nearest example (-1: none) and its cosine of each text."""
        score, nearest, best = np.full(len(column), self.rate), np.full(len(column), -1, np.int64), np.zeros(len(column))
        for a, b, terms in chunks(column) if len(self.ids) else ():
            text, example, cosine = self.index.nearest(*self.space.vectors(terms), terms.texts, k)
            vote = cosine / (1.05 - np.minimum(cosine, 1.0))
            total = lambda w: np.bincount(text, weights=w, minlength=b - a)  # noqa: B023, E731
            score[a:b] = (total(vote * self.label[example]) + self.rate) / (total(vote) + 1)
            first = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else text
            nearest[a + text[first]], best[a + text[first]] = self.ids[example[first]], cosine[first]
        return score, nearest, best


def weights(df: np.ndarray, n: int, n0: np.ndarray, n1: np.ndarray, all0: int, all1: int) -> tuple[np.ndarray, float]:
    """Term weights from corpus frequencies ``df`` of ``n`` documents and the labels of the sample's documents; the last
    number is the weight of a word outside the space."""
    total, here = float(all0 + all1), n0 + n1
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda k, every: np.where(k > 0, k * np.log(k / here * (total / every)), 0.0)
        evidence = part(n0, all0) + part(n1, all1) if all0 and all1 else np.zeros(len(df))
    chance = np.log(max(len(df), 1)) + 1
    scale = FLOOR + (1 - FLOOR) * evidence / (evidence + chance)
    return np.log((n + 1) / (np.minimum(df, n) + 1)) * scale, float(np.log((n + 1) / 2) * FLOOR)


def _example_terms(batch: pa.RecordBatch) -> dict:
    """Names and counts of the terms of each text, and which of them are words."""
    out: dict[str, list] = {"names": [], "counts": [], "is_word": []}
    for _, _, t in chunks(batch["text"]):
        edge = np.searchsorted(t.of, np.arange(t.texts + 1))
        for x, y in zip(edge[:-1], edge[1:]):
            out["names"].append(t.names[t.term[x:y]].view(np.int64))
            out["counts"].append(t.count[x:y])
            out["is_word"].append(t.is_word[t.term[x:y]])
    kinds = {"names": pa.int64(), "counts": pa.int64(), "is_word": pa.bool_()}
    return {"doc_id": batch["doc_id"], "toxic": batch["toxic"]} | {c: pa.array(v, pa.list_(kinds[c])) for c, v in out.items()}


def _corpus_counts(space):
    """(name, df): documents of the task that hold each term of the space."""

    def run(batches):
        s = space.value
        df = np.zeros(len(s.names), np.int64)
        for batch in batches:
            for _, _, t in chunks(batch["text"]):
                number = s.numbers(t.names)
                held = np.bincount(t.term, minlength=len(t.names))
                df[number[number >= 0]] += held[number >= 0]
        at = np.flatnonzero(df)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_pydict({"number": pa.array(at[i : i + 100_000], pa.int32()), "df": pa.array(df[at[i : i + 100_000]], pa.int64())})

    return run


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model:
    """The model from at most ``examples`` labelled rows outside the held-out fold; only what those rows hold reaches the driver."""
    spark = docs.sparkSession
    y = labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = y.join(docs.select(F.col("doc_id").alias("of")).where("of IS NOT NULL").distinct(), F.col("doc_id") == F.col("of"), "left_semi")
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(examples)
    texts = docs.select(F.col("doc_id").alias("of"), "text").join(F.broadcast(chosen), F.col("of") == F.col("doc_id"))
    sample = texts.select("doc_id", "toxic", "text").dropDuplicates(["doc_id"])
    held = map_rows(sample, _example_terms, "doc_id long, toxic int, names array<long>, counts array<long>, is_word array<boolean>")
    held = materialized(held, "tox-sample").toArrow()
    ids, label = held["doc_id"].to_numpy(), held["toxic"].to_numpy()
    of = np.repeat(np.arange(len(ids)), held["names"].combine_chunks().value_lengths().to_numpy()) if len(ids) else np.zeros(0, np.int64)
    flat = lambda c: held[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(ids) else np.zeros(0, np.int64)
    names, term = np.unique(flat("names").view(np.uint64), return_inverse=True)
    shared = spark.sparkContext.broadcast(Space(names))
    df, n = np.zeros(len(names), np.int64), docs.count()
    counted = docs.select("text").mapInArrow(_corpus_counts(shared), "number int, df long").groupBy("number").agg(F.sum("df").alias("df")).toArrow()
    df[counted["number"].to_numpy()] = counted["df"].to_numpy()
    holders = lambda which: np.bincount(term[label[of] == which], minlength=len(names))
    all1 = int(label.sum())
    space = Space(names, *weights(df, n, holders(0), holders(1), len(ids) - all1, all1))
    # every word of an example is in the space, so its length is that of its terms
    v = (1 + np.log(flat("counts"))) * space.weight[term]
    size = np.sqrt(np.bincount(of, weights=v * v, minlength=len(ids)))
    some = v > 0
    return Model(space, ids, label, of[some], term[some], v[some] / size[of[some]])


def _score(batch: pa.RecordBatch, model, k: int, keep_text: bool) -> dict:
    score, nearest, cosine = model.value.scores(batch["text"], k)
    out = {"row": batch["row"], "score": pa.array(score), "evidence_id": pa.array(nearest, pa.int64(), mask=nearest < 0), "evidence_cosine": pa.array(cosine)}
    return out | {"text": batch["text"]} if keep_text else out


def score(docs: DataFrame, model: Model, carry: list[str] | None = None, k: int = NEIGHBOURS, keep_text: bool = False) -> DataFrame:
    """row (struct of doc_id and the carried columns), score, evidence_id, evidence_cosine, if asked for text; one row per row."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys(["doc_id", *(carry or [])])]).alias("row"), "text")
    kind = packed.schema["row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"row {kind}, score double, evidence_id long, evidence_cosine double" + ", text string" * keep_text
    return map_rows(packed, _score, schema, shared, k, keep_text)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(fold(F.col("row.doc_id")) == 0, F.lit(True))
    return out.select(F.col("row.doc_id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence_id", "evidence_cosine")
