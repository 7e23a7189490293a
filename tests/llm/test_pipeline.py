"""The pipeline's stages: what each keeps of its input, against brute force on a small corpus."""

import hashlib
import struct
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from fanchart.llm import bpe
from tests.llm import edge
from tests.llm.test_duplicates import families, lines_brute, near_brute
from tests.llm.test_search import toxic_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    toxic, labels = toxic_rows(300)
    shared = "this line is long enough and stands in many of the documents"
    near = [(2000 + d, t + f"\n{shared}", lang, f"s{d % 4}", len(t)) for d, t, lang, _, _ in families(3, 60)]
    rows = toxic + near + [(9000 + r[0], *r[1:]) for r in edge.ROWS[3:6]] + [r for r in edge.ROWS if r[0] is None]
    spark.createDataFrame(rows, edge.SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, {i: y for i, _, y in labels}, str(folder)


def test_stages_in_order(spark, corpus):
    rows, truth, folder = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"] and pipeline.ORACLE_SQL is None

    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == COLUMNS and clean.dtypes == docs.dtypes
    left = [tuple(r) for r in clean.collect()]
    assert set(left) <= set(rows)
    gone = {r[0] for r in rows} - {r[0] for r in left}
    bad = {i for i, y in truth.items() if y}
    assert len(gone & bad) > 0.95 * len(bad) and len(gone - bad) < 3

    short = stages["line_dedup"](spark, clean, folder)
    assert short.columns == COLUMNS
    cut = [tuple(r) for r in short.collect()]
    want = lines_brute(left)
    # the row without an id shares no line here, so the digest of all rows by id is enough
    assert len(cut) == len(left) and all((t or "") == want[d][2] for d, t, *_ in cut)
    assert all(n == len(t) for d, t, _, _, n in cut if want[d][1]) and sum(want[d][1] for d in want) > 30
    assert {d for d, t, *_ in cut if t is None} == {d for d, t, *_ in left if t is None}

    short = spark.createDataFrame(cut, edge.SCHEMA)
    single = stages["near_dedup"](spark, short, folder)
    assert single.columns == COLUMNS
    kept = [tuple(r) for r in single.collect()]
    groups = near_brute([r for r in cut if r[0] is not None])
    assert Counter(kept) == Counter(r for r in cut if r[0] is None or groups[r[0]][2]) and len(kept) < len(cut)

    single = spark.createDataFrame(kept, edge.SCHEMA)
    mixed = stages["mixing"](spark, single, folder)
    assert mixed.columns == COLUMNS
    taken = [tuple(r) for r in mixed.collect()]
    assert set(taken) <= set(kept) and max(Counter(taken).values()) <= 3
    words = lambda rs: sum(len((r[1] or "").encode().split()) for r in rs)
    assert abs(words(taken) - words([r for r in kept if r[0] is not None])) <= 400 * 6

    encoded = stages["bpe"](spark, spark.createDataFrame(taken, edge.SCHEMA), folder).collect()
    library = Tokenizer.from_file(bpe.vocabulary())
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids
    digest = lambda t: hashlib.sha256(struct.pack(f"<{len(ids(t))}I", *ids(t))).hexdigest()
    assert Counter((r.doc_id, r.ids_sha256) for r in encoded) == Counter((r[0], digest(r[1])) for r in taken)


def test_run_applies_all_stages(spark, corpus):
    rows, _, folder = corpus
    out = pipeline.run(spark, folder)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    assert {r.doc_id for r in out.collect()} <= {r[0] for r in rows} and out.count() > 100


def test_extra_columns_with_clashing_names_pass(spark, corpus):
    _, _, folder = corpus
    docs = edge.docs(spark)
    for name, stage in pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        out.collect()


def test_near_dedup_takes_similarities_of_four_fifths(spark, corpus):
    rows = []
    for g in range(30):
        words = [f"g{g}w{i}" for i in range(100)]
        # one shingle set of 96 less 5 to 25: similarities from 0.90 down to 0.59
        for k in range(2):
            other = [f"x{i}" if k and i % 20 == 10 and i // 20 < 1 + g % 5 else w for i, w in enumerate(words)]
            rows.append((10 * g + k, " ".join(other), "en", "a", 0))
    want = near_brute(rows, 80)
    assert 0 < sum(not k for _, _, k in near_brute(rows).values()) < sum(not k for _, _, k in want.values()) < 30
    out = dict(pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(rows, edge.SCHEMA), corpus[2])
    assert {r.doc_id for r in out.collect()} == {d for d, (_, _, kept) in want.items() if kept}


def test_mixing_keeps_rows_without_id_and_meets_targets_with_repeated_ids(spark, tmp_path):
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # a has target weight 1, b 2: all of one id in a, none has an id in b
    rows = [(7, f"a{i} is a text of eight words in all", "en", "a", i) for i in range(300)] + [(None, f"b{i} is a text of eight words in all", "en", "b", i) for i in range(150)]
    out = [tuple(r) for r in dict(pipeline.STAGES)["mixing"](spark, spark.createDataFrame(rows, edge.SCHEMA), str(tmp_path)).collect()]
    taken = Counter(out)
    per = Counter(r[3] for r in out)
    # 9 words a row, 450 rows in all: a gets 150, b 300, which is two whole epochs
    assert set(taken) <= set(rows) and abs(per["a"] - 150) <= 1 and abs(per["b"] - 300) <= 1
    assert {n for r, n in taken.items() if r[0] is None} == {2} and {n for r, n in taken.items() if r[0] == 7} == {1}
