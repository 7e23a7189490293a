"""Line dedup, near duplicates and suffix dedup against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from fanchart.llm import lines, near_dup, suffix
from fanchart.llm.common import BATCH, map_rows
from fanchart.llm.graph import components
from tests.llm import edge


def families(seed=1, n=160):
    """Documents with exact copies, near copies of varied distance, shared passages and chains."""
    rnd, out = random.Random(seed), []
    vocab = [f"w{i}" for i in range(3000)]
    base = [[rnd.choice(vocab) for _ in range(rnd.choice([3, 30, 120, 400]))] for _ in range(12)]
    passage = [rnd.choice(vocab) for _ in range(60)]
    for i in range(n):
        words = list(rnd.choice(base)) if rnd.random() < 0.8 else [rnd.choice(vocab) for _ in range(50)] + passage
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 8])):
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        text = rnd.choice([" ", "\n", "\t "]).join(words)
        out.append((i * 37 % 1009, text.upper() if rnd.random() < 0.2 else text, "en", "a", None))
    return out


def near_brute(rows, percent=85):
    sets = {}
    for doc, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark):
    rows = families()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(rows, edge.SCHEMA)).collect()}
    want = near_brute(rows)
    assert got == want and sum(not k for _, _, k in want.values()) > 20


def test_a_large_group_whose_members_mostly_lie_below_the_threshold(spark):
    rnd = random.Random(11)
    base, rows = [f"v{rnd.randrange(9999)}" for _ in range(150)], []
    for i in range(460):
        words = list(base)
        for _ in range(rnd.randrange(9)):
            words[rnd.randrange(150)] = f"x{rnd.random()}"
        rows.append((i * 17 % 997, " ".join(words), "en", "a", 0))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(rows, edge.SCHEMA)).collect()}
    assert got == near_brute(rows)


def test_intersections_of_all_pairs():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 3000), dtype=np.uint64)) for _ in range(30)]
    m = near_dup.intersections(sets)
    assert all(m[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(30))


def test_near_duplicates_edges(spark):
    out = near_dup.near_duplicates(edge.docs(spark)).collect()
    assert len(out) == len(edge.ROWS)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False)
    assert got[3] == (0, 3, True) and got[4] == (0, 4, True) and got[5] == (0, 5, True)
    assert got[None] == (1, None, True)
    assert near_dup.near_duplicates(edge.docs(spark, [])).collect() == []


def test_every_pair_within_the_radius_shares_a_key():
    rng = np.random.default_rng(0)
    for wrong in range(near_dup.RADIUS + 1):
        a = rng.integers(0, 2**32, (40, near_dup.K), dtype=np.uint64).astype(np.uint32)
        b = a.copy()
        for row in b:
            row[rng.choice(near_dup.K, wrong, replace=False)] += 1
        ka, kb = near_dup.bucket_keys(a), near_dup.bucket_keys(b)
        assert all(set(x) & set(y) for x, y in zip(ka.tolist(), kb.tolist()))


def test_word_hashes_follow_the_words():
    h = lambda t: near_dup.word_hashes(t.encode()).tolist()
    assert h("Ab cd\n\tab  CD é É") [:2] == h("ab cd")
    assert len(h(" \x0b x\x85y z ")) == 2 and h("é") != h("É") and h("") == h("  ") == []


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def lines_brute(rows, chars=40, docs=5):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for doc, text, *_ in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= chars:
                    held.setdefault(key(line), set()).add(doc)
    often = {k: max(d) for k, d in held.items() if len(d) >= docs}
    out = {}
    for doc, text, *_ in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if doc is None or often.get(key(x), doc) == doc]
        out[doc] = (len(all_), len(all_) - len(kept), "\n".join(kept))
    return out


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(4)
    pool = [f"line {i} " + "é" * rnd.randrange(25, 50) for i in range(60)]
    dress = lambda x: rnd.choice([x, x.upper().replace("É", "é"), f"  {x}\t", x + "\r"])
    rows = [(i * 31 % 997, "\n".join(dress(rnd.choice(pool)) if rnd.random() < 0.7 else f"own {rnd.random()} " * 3 for _ in range(rnd.randrange(12))), "en", "s", 0) for i in range(120)]
    rows += edge.ROWS
    out = lines.line_dedup(edge.docs(spark, rows), carry=["source", "key"]).collect()
    want = lines_brute(rows)
    assert len(out) == len(rows) and sum(w[1] for w in want.values()) > 50
    assert all((r.n_lines, r.n_dropped, r.kept) == want[r.row.doc_id] and r.row.key == "extra" for r in out)
    assert lines.line_dedup(edge.docs(spark, [])).collect() == []


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64))
    ph, rest = lines.PerfectHash.build(keys)
    assert not len(rest) and sorted(ph.slots(keys).tolist()) == list(range(len(keys)))
    _, rest = lines.PerfectHash.build(np.array([5, 5, 9], np.uint64))
    assert rest.tolist() == [5, 5]


def suffix_brute(rows):
    seen, out = {}, {}
    for doc, text in sorted({r[0]: (r[0], r[1]) for r in rows if r[0] is not None}.values(), key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.setdefault(data[i : i + 100], 1)
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out[doc] = (len(data), len(data) - len(kept), sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1])), kept)
    return out


def test_suffix_dedup_equals_brute_force(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdé \n") for _ in range(rnd.randrange(400))) for _ in range(30)]
    rows = []
    for i in range(300):
        text = "".join(rnd.choice(base)[rnd.randrange(0, 200) : rnd.randrange(100, 400)] for _ in range(rnd.randrange(5)))
        text = rnd.choice(["ab" * rnd.randrange(200) + text, "x" * rnd.randrange(1000)]) if rnd.random() < 0.15 else text
        # a passage of 70 bytes with many different surroundings makes hot buckets
        rows.append((i * 7 % 1000, text if rnd.random() < 0.7 else f"{rnd.random()}" + "a common passage, " * 4 + text, "en", "s", 0))
    rows += [(None, "z" * 300, "en", "s", 0), (5000, None, "en", "s", 0), (5001, "", "en", "s", 0), rows[3]]
    got = suffix.suffix_dedup(edge.docs(spark, rows).repartition(4)).collect()
    assert len(got) == len(rows)
    have = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got}
    assert have.pop(None) == (300, 0, 0, b"z" * 300)
    assert have == suffix_brute(rows)
    assert suffix.suffix_dedup(edge.docs(spark, [])).collect() == []


def test_names_tell_strings_apart_and_runs_cover_every_string():
    data = np.frombuffer(bytes(random.Random(2).choices(b"ab", k=4000)), np.uint8)
    _, strings = suffix.depth_names(data)
    exact = [data[i : i + 100].tobytes() for i in range(len(data) - 99)]
    assert len(set(exact)) == len(set(strings.tolist()))
    bucket, _, number, start, length = suffix.runs_of([data.tobytes(), data[50:900].tobytes()])
    assert length.max() <= suffix.SPAN and sum(length) == (4000 - 99) + (850 - 99)
    of = {}
    for b, n, s, k in zip(bucket.tolist(), number, start, length):
        for i in range(s, s + k):
            of.setdefault(exact[i + 50 * n], set()).add(b)
    assert all(len(b) == 1 for b in of.values())


def test_pieces_hold_every_string_of_a_long_text():
    text = bytes(random.Random(6).choices(range(256), k=3000))
    parts = list(suffix.pieces(text, 700))
    starts = [i + k for i, p in parts for k in range(len(p) - 99)]
    assert starts == list(range(len(text) - 99)) and all(text[i : i + len(p)] == p for i, p in parts)


def test_batches_of_texts_are_bounded_in_bytes(spark):
    """Workers get a few MB at a time, however long the texts are."""
    docs = spark.range(0, 4000, 1, 1).select(F.expr("repeat(cast(id % 10 AS string), 5000)").alias("text"))
    size = lambda batch: {"n": [batch.num_rows], "bytes": [batch.nbytes]}
    got = map_rows(docs, size, "n long, bytes long").agg(F.sum("n").alias("n"), F.max("bytes").alias("most")).first()
    assert got.n == 4000 and got.most < 2 * BATCH
