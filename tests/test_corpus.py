"""Corpus selection and overlap audits on small texts."""

import pytest
from pyspark.sql import functions as F

from fanchart.operators import corpus as X
from fanchart.operators import gates as G


def test_newest_first_with_ties_in_index_order(spark):
    units = spark.createDataFrame([("u", "2020-06-30")], "unit_id string, asof string")
    index = spark.createDataFrame(
        [("u", 0, "a", "2020-06-01", "a.txt"), ("u", 1, "b", "2020-06-30T09:00", "b.txt"), ("u", 2, "c", "2020-06-01", "c.txt"),
         ("u", 3, "late", "2020-07-01", "d.txt"), ("u", 4, "gone", "2020-01-01", "none.txt"), ("u", 5, "undated", None, "e.txt")],
        "unit_id string, pos int, doc_id string, timestamp string, path string",
    )
    docs = spark.createDataFrame([("u", f"{c}.txt", "t") for c in "abcdex"], "unit_id string, path string, text string")
    kept, counts = X.docs_asof(index, docs, units)
    assert tuple(counts.first()) == ("u", 3, 3)
    top, dropped = X.newest_k(kept, 2)
    assert [r.doc_id for r in top.orderBy("rank").collect()] == ["b", "a"]
    assert dropped.first().dropped == 1


def test_overlap_counts_every_copy_once_per_document(spark):
    refs = spark.createDataFrame([(1, "The cat sat. It slept."), (2, "The cat sat.")], "ref_id int, text string")
    docs = spark.createDataFrame([(1, "The  cat\nsat. New one. The cat sat."), (2, "Nothing here.")], "doc_id int, text string")
    got = {r.doc_id: (r.sentences, r.verbatim) for r in X.passage_overlap(docs, refs).collect()}
    assert got == {1: (4, 1), 2: (1, 0)}


def longest(a, b):
    best = 0
    a, b = a.split(), b.split()
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best


def test_longest_run_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    words = ["w%d" % i for i in range(4)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(6)]
    refs = [" ".join(rng.choices(words, k=50)) for _ in range(3)] + [texts[0][30:120]]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:1])), "doc_id int, text string")
    ref = spark.createDataFrame(list(enumerate(refs)), "ref_id int, text string")
    got = {r.doc_id: r.longest_run for r in X.longest_shared_run(docs, ref, 4).collect()}
    want = {i: max(longest(t, r) for r in refs) for i, t in enumerate(texts + texts[:1])}
    assert got == want
    one = spark.createDataFrame([("nothing in common at all",)], "text string")
    assert {r.longest_run for r in X.longest_shared_run(docs, one).collect()} == {0}
    assert {r.longest_run for r in X.longest_shared_run(docs, one.limit(0)).collect()} == {0}


def test_a_passage_in_a_third_of_the_texts_multiplies_nothing(spark, monkeypatch):
    """Documents and references meet on names: pairs that a join makes stay below one per document and place."""
    from fanchart.operators import shared_runs as S

    passage = " ".join(f"p{i}" for i in range(37))
    docs = [(i, (f"own{i} before {passage} after{i}" if i % 3 == 0 else f"own{i} p{i % 37} x") if i else None) for i in range(300)]
    refs = [(f"r{i} {passage} s{i}",) for i in range(200)] + [(None,)]
    made = []
    write = S.materialized
    monkeypatch.setattr(S, "materialized", lambda df, name: (lambda out: (made.append((name, out.count())), out)[1])(write(df, name)))
    d = spark.createDataFrame(docs, "doc_id int, text string")
    got = {r.doc_id: r.longest_run for r in S.longest_shared_run(d, spark.createDataFrame(refs, "text string")).collect()}
    assert got == {i: 0 if not i else 37 if i % 3 == 0 else 1 for i in range(300)}
    assert max(n for name, n in made if name != "run-names") <= 300

    # a filter that lets everything pass changes no result
    monkeypatch.setattr(S, "_passes", lambda bitmap, names: names == names)
    assert {r.doc_id: r.longest_run for r in S.longest_shared_run(d, spark.createDataFrame(refs, "text string")).collect()} == got


def test_every_phrase_search_carries_its_control(spark):
    docs = spark.createDataFrame([(1, "a licence and a license")], "doc_id int, text string")
    got = {r.pattern: (r.documents, r.hits) for r in X.phrase_search(docs, {"lic": "licen[sc]e", "none": "zzz"}, "needle").collect()}
    assert got == {"lic": (1, 2), "none": (0, 0), "control": (1, 1)}


def test_headers_and_tables(spark):
    doc = spark.createDataFrame([(1, "# source: Bank | date: 2020-01-02 | type: minutes\nbody")], "doc_id int, text string")
    assert tuple(doc.select(*X.doc_header("text")).first()) == ("Bank", "2020-01-02", "minutes")
    table = "Title\n\nreport_date  oi  l  s  n\n 2024-01-02   184042   33585   90780   -57195\n 2024-01-02   1  2  3  4\n"
    rows = X.positioning_table(spark.createDataFrame([(1, table)], "doc_id int, text string")).collect()
    assert [(str(r.report_date), r.noncomm_net) for r in rows] == [("2024-01-02", -57195), ("2024-01-02", 4)]


def test_context_holds_assets_then_documents(spark):
    units = spark.createDataFrame([("u", "2020-06-30", ["B", "A"], [5], "level"), ("v", "2020-06-30", ["A"], [5], "level")], "unit_id string, asof string, asset_ids array<string>, horizons array<int>, target_type string")
    stats = spark.createDataFrame([("u", "A", 1.0, 0.1), ("u", "B", 2.0, 0.2), ("v", "A", 1.0, 0.1)], "unit_id string, asset string, last double, sd_h double")
    top = spark.createDataFrame([("u", 1, "d1", "2020-06-01", "speech", "x" * 7000)], "unit_id string, rank int, doc_id string, timestamp string, doc_type string, text string")
    got = {r.unit_id: r.context.split("\n") for r in X.context_pack(top, stats, units).collect()}
    assert got["u"][2].startswith("  B: level 2.000000") and got["u"][3].startswith("  A:")
    assert got["u"][5] == "--- d1 (2020-06-01, speech) ---" and len(got["u"][6]) == 6000
    assert got["v"][-1] == "Documents: 0"


def test_canaries_and_path_rules(spark):
    guid = "0f8fad5b-d9cb-469f-a165-70867728950e"
    docs = spark.createDataFrame([(1, f"x {guid.upper()} y {guid}"), (2, "clean")], "doc_id int, text string")
    hits = G.canary_scan(docs, spark.createDataFrame([("u", guid)], "unit_id string, canary_guid string")).collect()
    assert [(h.doc_id, h.unit_id) for h in hits] == [(1, "u")]
    files = spark.createDataFrame([("bank_a.txt",), ("bank_fed.txt",), ("planted.bin",)], "path string")
    got = {r.path: r.n_rules for r in G.path_rules(files, {"bank": "^bank_", "fed": "fed"}).collect()}
    assert got == {"bank_a.txt": 1, "bank_fed.txt": 2, "planted.bin": 0}


@pytest.mark.parametrize("k", [1, 3])
def test_dropped_is_never_negative(spark, k):
    docs = spark.createDataFrame([("u", "2020-01-01", 0)], "unit_id string, timestamp string, pos int")
    assert X.newest_k(docs, k)[1].select(F.max("dropped")).first()[0] == 0
