"""Vector searches and toxicity against full scans."""

import math
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fanchart.llm import bit_sliced, graph_search, toxicity
from tests.llm import edge

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, n=1500, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[200:260] = x[0]
    x[300:340] = np.round(x[300:340])
    rows = [(int(i * 7 % n), [float(v) for v in r]) for i, r in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    odd = [(9000, None), (9010, [None, *[1.0] * (dim - 1)]), (9020, [nan] + [1.0] * (dim - 1)), (9030, [inf] + [1.0] * (dim - 1)), (9040, [1.0]), (None, [1.0] * dim), (9050, [])]
    zero = [(9100, [0.0] * dim)]
    df = spark.createDataFrame(rows + odd + zero + rows[:1], SCHEMA).withColumns({"shard": F.lit("x"), "part": F.lit("y"), "q": F.lit("z")})
    return df, {i: np.array(v, np.float64) for i, v in rows}


def test_bit_sliced_search_equals_a_full_scan(spark):
    df, x = table(spark)
    got = {}
    for r in bit_sliced.exact_search(df, 50).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    ids = np.array([*sorted(x), 9100, 0])
    q = np.floor(np.stack([*(x[i] for i in sorted(x)), np.zeros(16), x[0]]) * 256).astype(np.int64)
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    for i in got:
        score = q @ q[np.flatnonzero(ids == i)[0]]
        want = sorted((-s, int(v)) for s, v in zip(score.tolist(), ids) if v != i)[:5]
        assert [got[i][k] for k in range(1, 6)] == [(v, -s) for s, v in want]


def test_bitmap_arithmetic():
    rng = np.random.default_rng(3)
    for n, drop in ((1, 0), (63, 1), (130, 3), (5, 2)):
        rows, queries = rng.integers(-300, 300, (n, 7)), rng.integers(-300, 300, (9, 7))
        ids = np.arange(n) * 2
        asked = np.arange(9) * 2
        q, r, score = bit_sliced.top_rows(queries, asked, rows, ids, 3, drop)
        for i in range(9):
            want = sorted((-int(s), int(v)) for s, v in zip(rows @ queries[i], ids) if v != asked[i])[:3]
            assert sorted((-int(s), int(ids[k])) for s, k in zip(score[q == i], r[q == i]))[:3] == want


def test_fewer_candidates_than_asked_for(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (50, [0.5, 0.25]), (3, [-1.0, 4.0])], SCHEMA)
    assert bit_sliced.exact_search(df, 50).count() == 4 and graph_search.neighbours(df, 20).count() == 2
    none = spark.createDataFrame([], SCHEMA)
    assert bit_sliced.exact_search(none, 50).collect() == [] and graph_search.neighbours(none, 20).collect() == []
    one = spark.createDataFrame([(0, [1.0])], SCHEMA)
    assert bit_sliced.exact_search(one, 50).collect() == [] and graph_search.neighbours(one, 20).collect() == []


def test_graph_search_finds_the_nearest(spark):
    df, x = table(spark, seed=1)
    got = {}
    for r in graph_search.neighbours(df, 20).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    ids, m = np.array(sorted(x)), np.stack([x[i] for i in sorted(x)])
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    found = total = 0
    for i, hits in got.items():
        assert sorted(hits) == list(range(1, 21)) and i not in {v for v, _ in hits.values()} and len({v for v, _ in hits.values()}) >= 19
        order = [(-s, v) for v, s in hits.values()]
        assert [(-s, v) for v, s in (hits[k] for k in range(1, 21))] == sorted(order)
        assert all(math.isclose(s, float(x[v] @ x[i]), rel_tol=1e-12, abs_tol=1e-12) for v, s in hits.values())
        best = sorted(((-float(s), int(v)) for s, v in zip(m @ x[i], ids) if v != i))[:20]
        found += len({v for _, v in best} & {v for v, _ in hits.values()})
        total += 20
    assert found / total >= 0.95


@pytest.mark.parametrize("n_terms", [40, 900])
def test_block_max_neighbours_equal_a_full_scan(n_terms):
    rnd = random.Random(0)
    dense = np.zeros((700, n_terms))
    for row in dense:
        terms = rnd.sample(range(n_terms), rnd.randrange(0, 6))
        row[terms] = [rnd.choice([0.5, 1.0, 2.0]) for _ in terms]
    dense /= np.maximum(np.sqrt((dense * dense).sum(axis=1, keepdims=True)), 1e-9)
    of, term = np.nonzero(dense)
    index = pickle.loads(pickle.dumps(toxicity.Index(of, term, dense[of, term], 700, n_terms, block=16)))
    asked = of < 200
    text, example, cosine = index.nearest(of[asked], term[asked], dense[of, term][asked], 200, 16)
    full = dense[:200] @ dense.T
    for i in range(200):
        want = np.sort(full[i][full[i] > 1e-12])[::-1][:16]
        np.testing.assert_allclose(cosine[text == i], want, rtol=0, atol=1e-12)
        np.testing.assert_allclose(full[i, example[text == i]], want, rtol=0, atol=1e-12)


def terms_of(text):
    """Words and beginnings by plain string operations: {(kind, term): count}."""
    low = "".join(c.lower() if c < "\x80" or "À" <= c <= "Þ" and c != "×" else c for c in text or "")
    said = Counter(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))
    out = Counter({("w", w): n for w, n in said.items()})
    for w, n in said.items():
        if len(w) > 5:
            out["h", w[:5]] += n
    return out


def test_terms_equal_plain_strings():
    rnd = random.Random(4)
    texts = ["", "Abc abc", "Éclair éclair ÉCLAIRS", "x" * 300 + " y", *("".join(rnd.choice("abcdefgÀÉéß日 .\n7") for _ in range(rnd.randrange(120))) for _ in range(200))]
    named = {}
    for a, b, t in toxicity.chunks(pa.array(texts)):
        for i in range(a, b):
            here = t.of == i - a
            want = terms_of(texts[i])
            assert sorted(t.count[here].tolist()) == sorted(want.values()) and t.is_word[t.term[here]].sum() == sum(k == "w" for k, _ in want)
            for name, count in zip(t.names[t.term[here]].tolist(), t.count[here].tolist()):
                named.setdefault(name, set()).add(frozenset(k for k, n in want.items() if n == count))
    # a name stands for one term wherever it is found
    assert all(frozenset.intersection(*sets) for sets in named.values())


def toxic_rows(n=900):
    rnd, rows, labels = random.Random(8), [], []
    vocab = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnrst"]
    for i in range(n):
        bad = rnd.random() < 0.3
        words = [rnd.choice(vocab) for _ in range(rnd.randrange(20, 200))]
        for _ in range(rnd.randrange(2, 5) * bad):
            words.insert(rnd.randrange(len(words)), rnd.choice(["Zounds!", "zwilly", "quaxing", "quaxed", "quaxes"]))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    docs = edge.docs(spark, rows + edge.ROWS[3:])
    truth = {i: y for i, _, y in labels}
    given = spark.createDataFrame([(i, q, y if i % 2 else (y or None)) for i, q, y in labels] + [(3000, 1, 1), (None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, given), carry=["source", "score"]).withColumn("held", toxicity.fold(F.col("row.doc_id")) == 0).collect()
    assert len(out) == len(rows) + len(edge.ROWS[3:]) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held and r.row.doc_id in truth]
    assert len(held) > 100 and sum((r.score >= 0.5) == bool(truth[r.row.doc_id]) for r in held) / len(held) > 0.97
    assert all(r.evidence_id is not None for r in held if r.score >= 0.5)


def brute_toxicity(rows, truth, k=16):
    """Scores by full TF-IDF cosines: {doc_id: (score, best cosine)}."""
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    examples = [(i, truth[i], terms_of(t)) for i, t, *_ in rows if i in truth and i not in held]
    terms = sorted({t for *_, c in examples for t in c})
    own = {i: terms_of(t) for i, t, *_ in rows}
    df = np.array([sum(t in c for c in own.values()) for t in terms])
    n0, n1 = (np.array([sum(t in c for _, y, c in examples if y == label) for t in terms]) for label in (0, 1))
    all1 = sum(y for _, y, _ in examples)
    weight, outside = toxicity.weights(df, len(rows), n0, n1, len(examples) - all1, all1)
    at, rate = {t: j for j, t in enumerate(terms)}, all1 / len(examples)

    def unit(counts):
        v, rest = np.zeros(len(terms)), 0.0
        for t, c in counts.items():
            if t in at:
                v[at[t]] = (1 + np.log(c)) * weight[at[t]]
            elif t[0] == "w":
                rest += ((1 + np.log(c)) * outside) ** 2
        return v / max((v @ v + rest) ** 0.5, 1e-300)

    base, label = np.stack([unit(c) for *_, c in examples]), np.array([y for _, y, _ in examples])
    out = {}
    for i, c in own.items():
        cosine = base @ unit(c)
        best = np.argsort(-cosine, kind="stable")[:k]
        best = best[cosine[best] > 0]
        vote = cosine[best] / (1.05 - np.minimum(cosine[best], 1))
        out[i] = float((vote @ label[best] + rate) / (vote.sum() + 1)), float(cosine[best[0]]) if len(best) else 0.0
    return out


def test_toxicity_equals_brute_force_over_all_terms(spark):
    rows, labels = toxic_rows(260)
    # copies of labelled rows whose words nobody else uses, and clean rows of unknown words
    rows += [(i, " ".join(f"only{'abcdefgh'[i % 8]}{'xyz'[j]}q" for j in range(3)), "en", "s", 0) for i in range(1000, 1040)]
    labels += [(i, 1, i % 2) for i in range(1000, 1020)]
    rows += [(i, f"nothing{i} known{i} here{i}", "en", "s", 0) for i in range(2000, 2010)] + [(3000, None, None, None, None), (3001, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, edge.SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = brute_toxicity(rows, {i: y for i, _, y in labels})
    got = {r.row.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert set(got) == set(want)
    for i, (score, cosine) in want.items():
        # where cosines tie at the edge of the neighbours another label may vote, so only clear edges are compared
        assert got[i].evidence_cosine == pytest.approx(cosine, abs=1e-9)
    assert np.mean([abs(got[i].score - s) < 1e-9 for i, (s, _) in want.items()]) > 0.9
    assert all(got[i].evidence_id is not None and got[i].evidence_cosine > 0.999 for i in range(1020, 1040))
    assert all(got[i].score == pytest.approx(model.rate) for i in (*range(2000, 2010), 3000, 3001))
    assert np.mean([got[i].evidence_id is not None for i, *_ in rows]) > 0.9


def test_toxicity_without_labels_or_rows(spark):
    docs, labels = edge.docs(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()} == {0.0}
    empty = edge.docs(spark, [])
    assert toxicity.score(empty, toxicity.fit(empty, labels)).collect() == []
