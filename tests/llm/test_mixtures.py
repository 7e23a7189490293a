"""Resampling, divergence and packing against brute force."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fanchart.llm import divergence, packing, resampling
from fanchart.llm.bpe import vocabulary
from tests.llm import edge

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+").findall
SAMPLE = ["", "\n", "one", "One\ntwo THREE\nfour", "a b\n\nc\nd e f g\n" * 3, "É é\x00ß\n日本語 x9\r\ny", "w" * 300 + " short " + "é" * 90 + "\nend", "x\ny\nz\n" * 5, "q " * 40]


def rows_of(spark, texts, **more):
    rows = [(i if i % 7 else None, t, f"l{i % 2}", f"s{i % 3}", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, edge.SCHEMA)


def bucket_list(text):
    w = ALNUM((text or "").translate(LOW))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resample_brute(docs, target, min_words, percent):
    made = [(d, *bucket_list(t)) for d, t in docs]
    s, t = Counter(b for *_, f in made for b in f), Counter(b for x in target for b in bucket_list(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
    out = []
    for d, n, f in made:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f))
        out.append((d, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    return out, able[: len(able) * percent // 100]


@pytest.mark.parametrize("crossing", [False, True])
def test_ngram_buckets_equal_the_crc_of_joined_words(crossing):
    rnd = random.Random(1)
    texts = SAMPLE + ["".join(rnd.choice("ab \n.Zé9\t") for _ in range(rnd.randrange(200))) for _ in range(200)]
    got = []
    for a, b, data, bounds in resampling._parts(pa.array(texts[:3] + texts)[3:]):
        words = resampling.Words(data, bounds)
        row, bucket = resampling._unpacked(resampling._packed(*words.features(crossing), b - a))
        assert words.per_text().tolist() == [bucket_list(t)[0] for t in texts[a:b]]
        got += [sorted(bucket[row == i].tolist()) for i in range(b - a)]
    for text, found in zip(texts, got):
        whole, inner = Counter(bucket_list(text)[1]), Counter(b for line in text.split("\n") for b in bucket_list(line)[1])
        assert found == sorted((whole - inner if crossing else whole).elements()), text


def test_resampling_equals_brute_force(spark):
    rnd = random.Random(2)
    lines = ["shared words of a line", "Alpha beta", "", "gamma\tdelta 7"]
    texts = SAMPLE + [None] + ["\n".join(rnd.choice(lines) + " " * rnd.randrange(2) + rnd.choice("uvw") * rnd.randrange(3) for _ in range(rnd.randrange(12))) for _ in range(120)]
    target = ["alpha beta gamma", None, "shared words of a line\nalpha", "u v w"]
    docs = rows_of(spark, texts)
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=30).collect()
    want, drawn = resample_brute([(r.doc_id, r.text) for r in docs.collect()], target, resampling.MIN_WORDS, 30)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(((d, n, w, s) for d, _, n, w, s in want), key=key)
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and [r.score for r in ranked] == [r[4] for r in drawn]


def test_resampling_takes_odd_rows(spark):
    target = spark.createDataFrame([("one two three",)], "text string")
    rows = resampling.resample(edge.docs(spark), target, percent=100, min_words=1).collect()
    assert len(rows) == len(edge.ROWS)
    n = lambda text: len(bucket_list(text)[1])
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_features) for r in rows) == sorted((x[0] is not None, x[0] or 0, n(x[1])) for x in edge.ROWS)
    assert resampling.resample(edge.docs(spark, []), target).collect() == []
    assert resampling.resample(edge.docs(spark), target.limit(0)).count() == len(edge.ROWS)


def test_hot_lines_keep_their_weights(spark, monkeypatch):
    texts = [f"the hot line everywhere\nown {i} line\nthe hot line everywhere" for i in range(60)]
    docs, target = rows_of(spark, texts), spark.createDataFrame([("hot line",)], "text string")
    plain = sorted(map(tuple, resampling.weights(docs, target).select("n_features", "weight").collect()))
    monkeypatch.setattr(resampling, "HOT", 1)
    assert sorted(map(tuple, resampling.weights(docs, target).select("n_features", "weight").collect())) == plain


def divergence_brute(rows, min_docs, top):
    df, tf, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        words = LETTERS(text.translate(LOW))
        groups.add((lang, source))
        tf[lang, source].update(words)
        df[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept, sources = [t for t, n in df[lang].items() if n >= min_docs], sorted(s for g, s in groups if g == lang)
        all_ = Counter()
        for s in sources:
            all_.update({t: tf[lang, s][t] for t in kept})

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: shares(tf[lang, s]) for s in sources}, shares(all_)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if tf[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                order = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("tile", [64, 2])
def test_divergence_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(divergence, "TILE", tile)
    rnd = random.Random(5)
    words = ["the", "Of", "é", "ß-x", "日本", "rare", *(f"w{chr(97 + i % 26)}{'abc'[i % 3]}" for i in range(300))]
    rows = [(rnd.choice(["en", "de", None, ""]), f"s{int(rnd.random() ** 3 * 7)}", " ".join(words[int(rnd.random() ** 2 * len(words))] for _ in range(rnd.randrange(60)))) for _ in range(300)]
    rows += [("xx", "a", None), ("xx", None, ""), ("yy", "alone", "one word")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    got = divergence.divergence(docs, min_docs=4, top=5, block=40)
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == divergence_brute(rows, 4, 5)


def test_levels_meet_in_every_form():
    rnd = np.random.default_rng(3)
    for seen in (1, 63, 64, 500):
        made = []
        for top in (2, 40, 4000):
            ids = np.sort(rnd.choice(seen, rnd.integers(0, seen + 1), replace=False))
            counts = rnd.integers(1, top, len(ids))
            made.append(divergence.Levels(ids, counts, counts * 10 + 3, 3, seen))
        for a in made:
            for b in made:
                assert a.distance(b, 7) == int(np.abs(a.share - b.share).sum())


def test_divergence_takes_odd_rows(spark):
    rows = divergence.divergence(edge.docs(spark), min_docs=1).collect()
    brute = divergence_brute([(x[2], x[3], x[1]) for x in edge.ROWS], 1, divergence.TOP)
    assert sorted(tuple(r) for r in rows) == brute
    assert divergence.divergence(edge.docs(spark, [])).collect() == []


def lengths(h, window):
    """Sequence fills and pieces of a plan, piece by piece."""
    plan = packing.Plan(h, window)
    fill = defaultdict(list)
    for n in np.flatnonzero(h):
        for k in range(int(h[n])):
            length, number = int(n), k
            while length:
                sequence, offset, taken, after = (int(x[0]) for x in plan.slots(np.array([length]), np.array([number])))
                fill[sequence].append((offset, taken))
                length, number = length - taken, after
    return plan, fill


@pytest.mark.parametrize("window", [16, 64])
def test_plans_fill_windows(window):
    rnd = np.random.default_rng(8)
    kinds = [np.bincount(rnd.integers(1, window, 700), minlength=window), np.bincount(rnd.integers(window * 3 // 4, window, 300), minlength=window), np.zeros(window, int), np.eye(1, window, 1, dtype=int)[0]]
    kinds.append(np.eye(1, window, window * 2 // 3, dtype=int)[0] * 1000 + np.eye(1, window, 5, dtype=int)[0] * 3)
    for h in kinds:
        plan, fill = lengths(h, window)
        assert sorted(fill) == list(range(plan.sequences))
        for parts in fill.values():
            at = 0
            for offset, taken in sorted(parts):
                assert offset == at and taken > 0
                at += taken
            assert at == window or at & (at - 1) == 0
        assert sum(t for p in fill.values() for _, t in p) == (np.arange(window) * h).sum()


def test_the_plan_does_not_grow_with_the_documents():
    rnd = np.random.default_rng(9)
    h = np.bincount(rnd.integers(500, 1024, 20_000), minlength=1024)
    h[700] += 10_000
    small, large = packing.Plan(h), packing.Plan(h * 100_000)
    assert len(large.key) < 40 * 1024 and large.sequences > 90_000 * small.sequences


def test_least_squares_is_optimal():
    """No column can lower the error further: gradients are 0 where a column is used and not negative elsewhere."""
    h = np.zeros(16, np.int64)
    h[[10, 6, 12, 4, 3]] = 70, 50, 30, 20, 20
    columns = packing.combinations(16, np.flatnonzero(h))
    assert all(c.sum() == 16 for c in columns)
    x = packing.least_squares(columns, h.astype(float), 4000)
    error = -h.astype(float)
    for c, n in zip(columns, x):
        for k in c[c > 0]:
            error[k] += n
    gradient = np.array([sum(error[k] for k in c if k) for c in columns])
    assert (x >= 0).all() and gradient.min() > -1e-6 and np.abs(x * gradient).max() < 1e-6


def test_packing_covers_every_id_once(spark):
    path, library = vocabulary(), Tokenizer.from_file(vocabulary())
    texts = SAMPLE + [None, "<|endoftext|> x", " " * 1_200_000, *(f"text {i} " * (i % 90) for i in range(200)), *(["a copy of one text"] * 150)]
    for window in (64, 1024):
        docs = rows_of(spark, texts).repartition(5).withColumn("ids", F.lit("extra")).withColumn("number", F.lit("extra"))
        docs = docs.withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("doc_id")))
        pieces = packing.pack(docs, path, window).collect()
        of = defaultdict(list)
        for p in pieces:
            of[p.doc_id].append(p)
        for i, text in enumerate(texts):
            if i % 7:
                want = struct.pack(f"<{len(ids := [*library.encode(text or '', add_special_tokens=False).ids, 0])}I", *ids)
                parts = sorted(of[i], key=lambda p: p.start)
                assert b"".join(bytes(p.ids) for p in parts) == want and all(p.doc_tokens == len(ids) for p in parts)
                assert [p.start for p in parts] == np.cumsum([0, *(p.length for p in parts)]).tolist()[:-1]
        in_sequence = defaultdict(list)
        for p in pieces:
            in_sequence[p.sequence_id].append((p.offset, p.length))
        for parts in in_sequence.values():
            parts.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0
            n = sum(x for _, x in parts)
            assert n <= window and (n == window or n & (n - 1) == 0)


def test_packing_takes_odd_rows(spark):
    pieces = packing.pack(edge.docs(spark), vocabulary()).collect()
    assert sum(p.start == 0 for p in pieces) == len(edge.ROWS)
    assert packing.pack(edge.docs(spark, []), vocabulary()).collect() == []
