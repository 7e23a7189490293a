"""File trees: units, panels, submissions, reference material; then the whole evaluation."""

import hashlib
import json
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fanchart.operators import gates as G
from fanchart.operators import metrics as M
from fanchart.operators import panel as P
from fanchart import contract as C
from fanchart.plans.scoring import baseline_draws, evaluate_tree, evidence_digests, producer_faults, publication_faults, score_submissions, submission_tables
from fanchart.sources import listing
from fanchart.sources import readers as R
from fanchart.sources import writers as W

ASSETS, HORIZONS, DRAWS, ASOF = ["ALPHA", "BRAVO"], [1, 5], 200, "2019-03-29"
CARD = """
[task]
id = "{unit}"
split = "public-dev"
[metadata]
category = "F3"
[provenance]
data_cutoff = "2019-03-29"
[scoring.params]
tail_levels = [0.01, 0.05, 0.95, 0.99]
joint = "variogram"
[scoring.params.weights]
marginal = 0.5
joint = 0.3
tail = 0.2
[panels.main]
end_date = "2019-03-29"
[targets]
asset_ids = ["ALPHA", "BRAVO"]
horizons = [1, 5]
target_type = "level"
target_dates = ["2019-04-01", "2019-04-05"]
"""
UNITS = ["unit-one", "unit-two"]


def history(seed):
    rng = np.random.default_rng(seed)
    dates = pd.bdate_range(end=ASOF, periods=120)
    return pd.concat(pd.DataFrame({"date": dates.date, "asset": a, "panel_id": "main", "value": 100 + rng.standard_normal(120).cumsum()}) for a in ASSETS)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("units")
    for i, unit in enumerate(UNITS):
        base = root / unit
        (base / "text").mkdir(parents=True), (base / "reference").mkdir()
        (base / "card.toml").write_text(CARD.format(unit=unit))
        past = history(i)
        if i == 0:
            (base / "panels").mkdir()
            pq.write_table(pa.Table.from_pandas(past, preserve_index=False), base / "panels" / "main.parquet")
        else:  # one directory up, the other spelling, text dates
            past = past.rename(columns={"asset": "asset_id"}).astype({"date": str})
            pq.write_table(pa.Table.from_pandas(past, preserve_index=False), base / "main.parquet")
        index = {"card_id": unit, "asof": ASOF, "documents": [
            {"doc_id": "d1", "timestamp": "2019-03-01", "source": "s", "doc_type": "speech", "file": "./d1.txt"},
            {"doc_id": "d2", "timestamp": "2019-03-04", "source": "s", "doc_type": "speech", "path": "sub/d2.txt"},
        ]}
        (base / "text" / "corpus_index.json").write_text(json.dumps(index))
        (base / "text" / "d1.txt").write_bytes(b"fine \xff text")
        (base / "text" / "sub").mkdir()
        (base / "text" / "sub" / "d2.txt").write_text("two\nlines")
        cells = [(0, a, h, 100.0 + i, "2019-04-01") for a in ASSETS for h in HORIZONS]
        truth = pd.DataFrame(cells, columns=["draw", "asset", "horizon", "value", "target_date"])
        pq.write_table(pa.Table.from_pandas(truth, preserve_index=False), base / "reference" / "realized.parquet")
        (base / "reference" / "ref_scale.json").write_text(json.dumps({"marginal": 1.0, "joint": 0.5, "tail": 0.2, "seed": 1}))
    return root


def submit(root, sub, unit, frame, meta=None, rationale="because"):
    base = root / sub / unit
    base.mkdir(parents=True)
    if isinstance(frame, bytes):
        (base / "forecast.parquet").write_bytes(frame)
    else:
        pq.write_table(pa.Table.from_pandas(frame, preserve_index=False), base / "forecast.parquet")
    doc = {"unit_id": unit, "asof": ASOF, "representation": "samples", "asset_ids": ASSETS, "horizons": HORIZONS, "n_draws": DRAWS, "target": "level"}
    text = meta if isinstance(meta, str) else json.dumps(doc | (meta or {}))
    (base / "forecast_meta.json").write_text(text)
    (base / "forecast_rationale.md").write_text(rationale)


def forecast(seed=0):
    rng = np.random.default_rng(seed)
    rows = [(d, a, h, 100 + z) for d, z in enumerate(rng.standard_normal(DRAWS)) for a in ASSETS for h in HORIZONS]
    return pd.DataFrame(rows, columns=["draw", "asset", "horizon", "value"]).astype({"draw": "int32", "horizon": "int32"})


@pytest.fixture(scope="module")
def submissions(tmp_path_factory):
    root = tmp_path_factory.mktemp("subs")
    good = forecast()
    for unit in UNITS:
        submit(root, "clean", unit, good)
    submit(root, "mixed", UNITS[0], good.assign(note="x"))
    submit(root, "mixed", UNITS[1], b"not parquet")
    submit(root, "typed", UNITS[0], good.astype({"horizon": "float64", "draw": "int64"}))
    submit(root, "typed", UNITS[1], good.assign(value="high"))
    submit(root, "words", UNITS[0], good, meta="[1, 2]")
    submit(root, "words", UNITS[1], good, meta="{oops", rationale=" \n\t")
    submit(root, "blank", UNITS[0], good, rationale=" \n\t")
    submit(root, "blank", UNITS[1], good, meta={"n_draws": True})
    return root


def tables(spark, tree, root):
    units, faults = R.trusted_asof(R.read_units(spark, str(tree)))
    assert faults.count() == 0
    return submission_tables(spark, str(root), units)


def plan(root, units=UNITS):
    grid = {"assets": ASSETS, "horizons": HORIZONS, "cell_count": len(ASSETS) * len(HORIZONS), "digest": "d"}
    doc = {
        "metric": {"direction": "asc", "domain": {"min": 0, "max": 4}}, "normalization": {"mode": "ref_scale"},
        "roster": {"count": len(units), "expected_units": [{"unit_handle": u, "grid": grid} for u in units]},
        "participant_failure": {"policy": "worst", "score": 4.0, "clip_real_scores_to_domain": True},
    }
    (root / "plan.json").write_text(json.dumps(doc))
    return str(root / "plan.json")


def test_no_defect_of_a_tree_is_scored(spark, tree, tmp_path):
    good, one, two = forecast(), *UNITS
    subs = tmp_path / "subs"
    edit = lambda c, i, v: good.assign(**{c: good[c].astype(object).where(good.index != i, v)})
    cases = {
        "clean": (good, {}, "because", None),
        "bulky-sidecar": (good.iloc[:-1], json.dumps({"asof": "1999-01-01"}) + " " * C.MAX_META_BYTES, "because", ("malformed_output", None)),
        "bulky-rationale": (good, {}, "r" * (C.MAX_RATIONALE_BYTES + 1), ("malformed_output", None)),
        "bulky-draws": (b"x" * (C.MAX_DRAWS_FILE_BYTES + 1), {}, "because", ("malformed_output", None)),
        "no-rows": (good.iloc[:0], {}, "because", ("incomplete_output", 0)),
        "short-and-wide": (good.iloc[:-4].assign(note="x"), {}, "because", ("incomplete_output", len(good) - 4)),
        "wide-and-late": (good.assign(**{f"c{i}": 1 for i in range(6)}), {"asof": "1999-01-01"}, "because", ("cutoff_violation", None)),
        "float-ids": (good.astype({"draw": "float64"}), {}, "because", ("schema_invalid", None)),
        "huge-id": (good.astype({"draw": "int64"}).assign(draw=lambda f: f["draw"].where(f.index != 7, 2**40)), {}, "because", ("schema_invalid", None)),
        "nan": (good.assign(value=good["value"].where(good.index != 3)), {}, "because", ("schema_invalid", None)),
        "hidden": (good, {}, "because", ("schema_invalid", None)), "nested": (good, {}, "because", ("schema_invalid", None)),
        "worded-axis": (good, {"horizons": [1, "x"]}, "because", ("schema_invalid", None)),
    }
    for name, (frame, meta, rationale, _) in cases.items():
        submit(subs, name, one, frame, meta=meta, rationale=rationale)
        submit(subs, name, two, good)
    pq.write_table(pa.table({"draw": pa.array(good["draw"]), "asset": pa.array(good["asset"]), "horizon": pa.array(good["horizon"]), "value": pa.array([None if i == 3 else v for i, v in enumerate(good["value"])])}), subs / "nan" / one / "forecast.parquet")
    broken = bytearray((subs / "clean" / one / "forecast.parquet").read_bytes())
    submit(subs, "broken", one, good)
    submit(subs, "broken", two, good)
    broken[4:400] = b"\0" * 396  # the footer stays whole, the pages do not
    (subs / "broken" / one / "forecast.parquet").write_bytes(bytes(broken))
    (subs / "hidden" / one / ".note").write_text("x")
    (subs / "nested" / one / "x").mkdir()
    (subs / "nested" / one / "x" / "answers.csv").write_text("x")
    want = {n: c[3] for n, c in cases.items() if c[3]} | {"broken": ("malformed_output", None)}
    ev = evaluate_tree(spark, str(tree), str(subs), plan(tmp_path))
    refused = {(r.submission_id, r.unit_id): r for r in ev.refusals.collect()}
    assert {k[0]: r.code for k, r in refused.items()} == {n: c for n, (c, _) in want.items()} and {k[1] for k in refused} == {one}
    assert all(n is None or refused[s, one].counts["observed_count"] == n for s, (_, n) in want.items())
    assert (refused["nan", one].counts["invalid_row_count"], refused["nan", one].counts["nonfinite_count"]) == (1, 0)
    assert refused["hidden", one].counts["extra_count"] == 1 and refused["float-ids", one].counts["invalid_row_count"] == len(good)
    scored = {(r.submission_id, r.unit_id) for r in ev.payload.collect()}
    assert scored == {(n, two) for n in want} | {("clean", one), ("clean", two)}
    assert ev.organizer_faults.count() == 0 and ev.faults.count() == 0
    board = {r.submission_id: r for r in ev.aggregates.collect()}
    assert len(board) == len(want) + 1 and board["clean"]["rank"] == 1 and all(board[n].n_failure == 1 for n in want)


def test_a_tree_is_judged_as_it_is(spark, tree, tmp_path):
    """Empty files, hidden names, folders and nodes in the place of files are seen and refused."""
    good, one, two = forecast(), *UNITS
    subs = tmp_path / "subs"
    names = ["clean", "empty-meta", "empty-draws", "empty-note", "empty-extra", "hidden", "deep", "checksum", "folder-for-draws", "folder-for-meta", "bare"]
    for n in names:
        submit(subs, n, two, good)
        if n not in ("folder-for-draws", "bare"):
            submit(subs, n, one, good, rationale="" if n == "empty-note" else "because")
    at = lambda n: subs / n / one
    (at("empty-meta") / "forecast_meta.json").write_text("")
    (at("empty-draws") / "forecast.parquet").write_bytes(b"")
    (at("empty-extra") / "x.txt").write_text("")
    (at("hidden") / ".h").write_text("")
    (at("deep") / "_d" / "q").mkdir(parents=True)
    for n in (".y", "_z"):
        (at("deep") / n).write_text("x")
    (at("checksum") / ".forecast.parquet.crc").write_bytes(b"crc")  # kept by a file system beside its file
    (at("folder-for-draws") / "forecast.parquet").mkdir(parents=True)
    (at("folder-for-draws") / "forecast_meta.json").write_text("{}")
    (at("folder-for-meta") / "forecast_meta.json").unlink()
    (at("folder-for-meta") / "forecast_meta.json").mkdir()
    at("bare").mkdir()
    want = {
        "empty-meta": ("malformed_output", 0, 0), "empty-draws": ("malformed_output", None, None), "empty-note": ("schema_invalid", None, None), "empty-extra": ("schema_invalid", 1, 0),
        "hidden": ("schema_invalid", 1, 0), "deep": ("schema_invalid", 3, 0), "folder-for-draws": ("malformed_output", 0, 1), "folder-for-meta": ("malformed_output", 0, 1),
    }
    ev = evaluate_tree(spark, str(tree), str(subs), plan(tmp_path))
    refused = {r.submission_id: r for r in ev.refusals.where(F.col("unit_id") == one).collect()}
    assert {n: r.code for n, r in refused.items()} == {n: c for n, (c, _, _) in want.items()}
    for n, (_, extra, odd) in want.items():
        if extra is not None and "extra_count" in refused[n].counts:
            assert (refused[n].counts["extra_count"], refused[n].counts["rejected_node_count"]) == (extra, odd), n
    assert ev.refusals.where(F.col("unit_id") == two).count() == 0 and ev.faults.count() == 0
    scored = {(r.submission_id, r.unit_id) for r in ev.payload.collect()}
    assert scored == {(n, two) for n in names} | {("clean", one), ("checksum", one)}
    # every scored key has both digests; equal draws have equal ones, whatever their order
    evidence = {(r.submission_id, r.unit_id): (r.draws_digest, r.outcome_digest) for r in ev.evidence.collect()}
    assert scored <= set(evidence) and len(set(evidence.values())) == 2
    shuffled = R.read_draws(spark, str(subs)).where("submission_id = 'clean'").repartition(7).sortWithinPartitions(F.rand(3))
    again = {r.unit_id: r.draws_digest for r in evidence_digests(shuffled, R.read_realized(spark, str(tree))).collect()}
    assert again == {u: evidence["clean", u][0] for u in UNITS}
    changed = {r.draws_digest for r in evidence_digests(shuffled.withColumn("value", F.when(F.col("draw") == 7, 1.0).otherwise(F.col("value"))), R.read_realized(spark, str(tree))).collect()}
    assert not changed & set(again.values())


def test_a_footer_costs_the_end_of_its_file(tmp_path, monkeypatch):
    big = forecast()
    big = pd.concat([big.assign(draw=big["draw"] + DRAWS * i, value=np.random.default_rng(i).standard_normal(len(big))) for i in range(60)])
    path = tmp_path / "forecast.parquet"
    pq.write_table(pa.Table.from_pandas(big, preserve_index=False), path, row_group_size=8000)
    read = []

    class Counting:
        def __init__(self, name):
            self.file = open(name, "rb")

        def read(self, n=-1):
            body = self.file.read(n)
            read.append(len(body))
            return body

        def __getattr__(self, name):
            return getattr(self.file, name)

    monkeypatch.setattr(R, "open_file", lambda p: pa.PythonFile(Counting(p), mode="r"))
    frame = pd.DataFrame({"submission_id": ["s"], "unit_id": ["u"], "path": [str(path)], "length": [path.stat().st_size]})
    (facts,) = R._footers(iter([frame]))
    assert facts["n_rows"][0] == len(big) and facts["readable"][0]
    assert 0 < sum(read) < 0.2 * path.stat().st_size
    read.clear()
    rows = sum(b.num_rows for b in R._decode_draws(iter([pa.RecordBatch.from_pandas(frame[["submission_id", "unit_id", "path"]])])))
    assert rows == len(big) and sum(read) < 1.3 * path.stat().st_size


def test_listing_of_any_depth(spark, tmp_path):
    (tmp_path / "a" / ".b" / "c").mkdir(parents=True)
    (tmp_path / "a" / ".b" / "c" / "d").write_text("xyz")
    (tmp_path / "_e").write_text("")
    got = {(r.path[len(str(tmp_path)) + 1 :], r.kind, r.length, r.depth) for r in listing.list_tree(spark, str(tmp_path)).collect()}
    assert got == {("a", "folder", None, 1), ("_e", "file", 0, 1), ("a/.b", "folder", None, 2), ("a/.b/c", "folder", None, 3), ("a/.b/c/d", "file", 3, 4)}
    assert listing.list_tree(spark, str(tmp_path), 2).count() == 3
    assert listing.list_tree(spark, str(tmp_path / "absent")).count() == 0


def test_panel_folders_that_must_not_be_published(spark, tmp_path):
    units = ["whole", "none", "empty", "stray", "undated", "broken", "late"]
    frame = history(0).astype({"date": str})
    for u in units:
        base = tmp_path / u
        base.mkdir()
        (base / "card.toml").write_text(CARD.format(unit=u))
        if u != "none":
            (base / "panels").mkdir()
        if u not in ("none", "empty"):
            out = frame.drop(columns="date") if u == "undated" else frame.assign(date="2019-04-01") if u == "late" else frame
            pq.write_table(pa.Table.from_pandas(out, preserve_index=False), base / "panels" / "main.parquet")
    (tmp_path / "stray" / "panels" / "_notes.txt").write_text("")
    (tmp_path / "broken" / "panels" / "two.parquet").write_bytes(b"")
    faults = {(r.unit_id, r.fault) for r in publication_faults(spark, str(tmp_path)).collect()}
    assert faults == {
        ("none", "no panel folder"), ("empty", "no panel in the folder"), ("stray", "entries that are no panel"), ("undated", "a panel has no date column"),
        ("undated", "a panel has a date that is none"), ("broken", "a panel cannot be opened"), ("late", "a panel goes beyond the as-of"),
    }


def test_foreign_and_missing_units_stop_the_run(spark, tree, tmp_path):
    submit(tmp_path / "subs", "s", UNITS[0], forecast())
    submit(tmp_path / "subs", "s", "unit-nine", forecast())
    ev = evaluate_tree(spark, str(tree), str(tmp_path / "subs"), plan(tmp_path, [*UNITS, "unit-ten"]))
    assert {(r.unit_id, r.fault) for r in ev.organizer_faults.collect()} >= {("unit-nine", "submitted unit is not in the plan"), ("unit-ten", "a unit of the plan has no card")}


def test_units_and_panels(spark, tree):
    units = R.read_units(spark, str(tree)).orderBy("unit_id").collect()
    assert [u.unit_id for u in units] == UNITS and units[0].asset_ids == ASSETS and units[0].error is None
    panel = R.read_panels(spark, str(tree))
    assert {(r.unit_id, r.asset): r["count"] for r in panel.groupBy("unit_id", "asset").count().collect()} == {(u, a): 120 for u in UNITS for a in ASSETS}
    clean = P.normalize_panel(panel)
    assert clean.select(F.max("date")).first()[0].isoformat() == ASOF


def test_corpora(spark, tree):
    index = R.read_corpus_index(spark, str(tree))
    docs = R.read_documents(spark, str(tree))
    assert sorted(r.path for r in index.where("unit_id = 'unit-one'").collect()) == ["d1.txt", "sub/d2.txt"]
    texts = {r.path: r.text for r in docs.where("unit_id = 'unit-one'").collect()}
    assert texts == {"d1.txt": "fine � text", "sub/d2.txt": "two\nlines"}
    units, _ = R.trusted_asof(R.read_units(spark, str(tree)))
    r = G.corpus_cutoff(index, docs, units).first()
    assert (r.indexed_documents, r.undated, r.late, r.unindexed, r.absent) == (2, 0, 0, 0, 0)


def test_documents_are_written_and_read_by_tasks(spark, tmp_path):
    """Empty texts, nulls, repeated ids and odd sources keep their rows; the driver's file index sees no document."""
    from fanchart.plans.bindings import Tables
    from fanchart.plans.catalog import sources

    rows = [(1, "a", "x"), (1, "a", "x"), (2, "a\n", "x"), (3, "", "x"), (4, None, "x"), (5, "é", "y/z=1 %"), (6, "b", None), (None, "b", ".."), (7, "a", "")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    out = sources.read_documents(Tables(spark, str(tmp_path)))
    md5 = lambda x: None if x is None else hashlib.md5(x.encode()).hexdigest()
    assert {(r.unit_id, r.digest): r.copies for r in out.collect()} == Counter((s, md5(x)) for _, x, s in rows)
    assert "binaryFile" not in out._jdf.queryExecution().toString()


def test_reference_material(spark, tree):
    units, _ = R.trusted_asof(R.read_units(spark, str(tree)))
    realized = R.read_realized(spark, str(tree))
    assert realized.columns == ["unit_id", "asset", "horizon", "value"]
    assert G.realized_exact(realized, P.grid(units)).count() == 0
    assert G.realized_exact(realized.where("horizon = 1"), P.grid(units)).first().missing == 2
    scale = R.read_ref_scale(spark, str(tree), units)
    assert scale.where("fault IS NOT NULL").count() == 0


@pytest.mark.parametrize(
    ("text", "cells", "fault"),
    [
        ('{"marginal": 1, "tail": 2}', 1, None), ('{"marginal": 1, "joint": null, "tail": 2}', 1, None), ('{"marginal": 1, "joint": 0.0, "tail": 2}', 1, None),
        ('{"marginal": 1, "tail": 2}', 4, "missing joint"), ('{"marginal": 1, "joint": 0.0, "tail": 2}', 4, "joint is not positive"),
        ('{"marginal": true, "joint": 1, "tail": 2}', 4, "marginal is not a number"), ('{"marginal": 1, "joint": 1, "tail": -2}', 4, "tail is not positive"),
        ('{"marginal": 1, "joint": 1, "tail": 2, "note": 1}', 4, "unknown key"), ("[1]", 4, "unreadable"), ("{", 4, "unreadable"), (None, 4, "unreadable"),
        ('{"marginal": 1, "joint": "x", "tail": 2}', 1, "joint is not a number"), ('{"marginal": 1, "joint": 1.5, "tail": 2, "method": "m", "seed": 1, "generated": "d"}', 4, None),
    ],
)
def test_scale_rules(spark, text, cells, fault):
    r = R.parse_ref_scale(spark.createDataFrame([("u", cells, text)], "unit_id string, cell_count int, text string")).first()
    assert r.fault == fault


def test_the_whole_evaluation(spark, tree, submissions):
    t = tables(spark, tree, submissions)
    units, realized = t["units"], R.read_realized(spark, str(tree))
    scale = R.read_ref_scale(spark, str(tree), units).select("unit_id", "marginal", "joint", "tail")
    ev = score_submissions(t, realized, scale, units)
    refused = {(r.submission_id, r.unit_id): r.code for r in ev.refusals.collect()}
    one, two = UNITS
    assert refused == {
        ("mixed", one): "schema_invalid", ("mixed", two): "malformed_output", ("typed", two): "schema_invalid",
        ("words", one): "schema_invalid", ("words", two): "malformed_output", ("blank", one): "schema_invalid", ("blank", two): "schema_invalid",
    }
    assert ev.faults.count() == 0 and ev.organizer_faults.count() == 0
    stopped = score_submissions(t, realized.where("unit_id = 'unit-one'"), scale, units, levels=(0.01, 0.05, 0.95)).organizer_faults
    assert {(r.unit_id, r.fault) for r in stopped.collect()} == {
        ("unit-two", "outcomes do not fill the grid"), ("unit-two", "no outcome"),
        ("unit-one", "tail level not computed"), ("unit-two", "tail level not computed"),
    }
    payload = {(r.submission_id, r.unit_id): r.score for r in ev.payload.collect()}
    assert set(payload) == {("clean", one), ("clean", two), ("typed", one)}
    assert payload["clean", one] == payload["typed", one]
    board = {r.submission_id: r for r in ev.aggregates.collect()}
    assert board["clean"].n_failure == 0 and board["mixed"].value == 4.0 and board["typed"].n_scored == 1
    assert board["clean"]["rank"] == 1
    # the rationale cannot change a score, and a second path gives the same numbers
    again = M.composite(M.components(R.read_draws(spark, str(submissions)).where("submission_id = 'clean'"), realized, units, (0.01, 0.05, 0.95, 0.99)), units, scale)
    assert {r.unit_id: r.composite for r in again.collect()} == {u: payload["clean", u] for u in UNITS}


def test_sinks(spark, tree, submissions, tmp_path):
    draws = R.read_draws(spark, str(submissions)).where("submission_id = 'clean'")
    W.write_draws(draws, str(tmp_path / "draws"))
    assert R.read_draws_table(spark, str(tmp_path / "draws")).exceptAll(draws).count() == 0
    refusals = spark.createDataFrame([], "submission_id string, unit_id string, gate string, code string, counts map<string,bigint>")
    W.write_details(refusals, str(tmp_path / "details"))
    assert (tmp_path / "details").is_dir()
    bad = spark.createDataFrame([("s", float("nan"))], "submission_id string, value double")
    with pytest.raises(G.OrganizerFault):
        W.write_scores(bad, bad.select("submission_id"), str(tmp_path / "scores"))
    assert not (tmp_path / "scores").exists()


def test_baseline_over_the_tree(spark, tree):
    units, _ = R.trusted_asof(R.read_units(spark, str(tree)))
    draws = baseline_draws(P.normalize_panel(R.read_panels(spark, str(tree))), units, 250, 1)
    assert draws.count() == 2 * 250 * 4
    counts = G.degenerate_draws(draws, units.withColumn("family", F.lit("F3"))).collect()
    assert {r.degenerate_cells for r in counts} == {0} and {r.warning for r in counts} == {"below 500 draws"}


def test_units_without_history_are_faults(spark, tree):
    units, _ = R.trusted_asof(R.read_units(spark, str(tree)))
    panel = P.normalize_panel(R.read_panels(spark, str(tree)))
    assert producer_faults(panel, units).count() == 0
    thin = panel.where((F.col("unit_id") != UNITS[0]) | (F.col("asset") != ASSETS[0]))
    late = F.col("date") > F.date_sub(F.lit(ASOF).cast("date"), 5)
    thin = thin.where((F.col("unit_id") != UNITS[1]) | late)
    assert {(r.unit_id, r.fault) for r in producer_faults(thin, units).collect()} == {
        (UNITS[0], "an asset has no row"), (UNITS[0], "too few common rows"), (UNITS[1], "too few common rows"),
    }


def test_documents_move_the_draws_through_stored_replies(spark, tree, tmp_path):
    """A stub model end to end: adjusted, skipped and failed units; equal contexts are asked once, stored ones not again."""
    from fanchart.plans.producer import NO_DOCUMENTS, NO_REPLY, ask, text_adjusted

    units, _ = R.trusted_asof(R.read_units(spark, str(tree)))
    panel = P.normalize_panel(R.read_panels(spark, str(tree)))
    index, docs = R.read_corpus_index(spark, str(tree)), R.read_documents(spark, str(tree))
    log = tmp_path / "calls"
    log.mkdir()

    def model(texts):
        import uuid

        (log / uuid.uuid4().hex).write_text(str(len(texts)))
        if any("two" not in t for t in texts):
            raise RuntimeError("down")
        return ['So: {"assets": {"ALPHA": {"drift_bp": 20, "vol_scale": 0.5}}}' for _ in texts]

    out = text_adjusted(panel, index, docs, units, model, str(tmp_path / "store"), n_draws=200, seed=3)
    base = {(r.unit_id, r.draw, r.asset, r.horizon): r.value for r in baseline_draws(panel, units, 200, 3).collect()}
    moved = {(r.unit_id, r.draw, r.asset, r.horizon): r.value for r in out.draws.collect()}
    assert set(moved) == set(base)
    for cell in [(u, a, h) for u in UNITS for a in ASSETS for h in HORIZONS]:
        x, y = (np.array([v for k, v in sorted(t.items()) if (k[0], *k[2:]) == cell]) for t in (base, moved))
        assert y.std() == pytest.approx(x.std() * (0.5 if cell[1] == "ALPHA" else 1.0))
        assert (y.mean() > x.mean()) == (cell[1] == "ALPHA") or cell[1] == "BRAVO"
    side = {r.unit_id: r for r in out.sidecars.collect()}
    assert all(side[u].reasoning_applied and side[u].reason == "" and side[u].documents_read == 2 for u in UNITS)
    W.write_meta(out.sidecars, str(tmp_path / "meta"))
    calls = len(list(log.iterdir()))
    text_adjusted(panel, index, docs, units, model, str(tmp_path / "store"), n_draws=200, seed=3).sidecars.collect()
    assert len(list(log.iterdir())) == calls > 0
    # one unit without documents, one whose context the model cannot read
    odd = docs.where("unit_id = 'unit-two' AND path = 'd1.txt'")
    some = {r.unit_id: r for r in text_adjusted(panel, index, odd, units, model, str(tmp_path / "other"), n_draws=200, seed=3).sidecars.collect()}
    assert (some[UNITS[0]].reason, some[UNITS[1]].reason) == (NO_DOCUMENTS, NO_REPLY) and not any(r.reasoning_applied for r in some.values())
    # a bad context in a batch costs itself only
    contexts = spark.createDataFrame([("a", "two"), ("b", "bad"), ("c", "two"), ("d", "two more")], "unit_id string, context string").coalesce(1)
    got = {r.unit_id: r.reply is not None for r in ask(contexts, model, str(tmp_path / "third")).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": True}


def test_a_failing_model_costs_its_unit(spark, tree):
    from fanchart.operators import generators as FC

    units, _ = R.trusted_asof(R.read_units(spark, str(tree)))
    panel = P.normalize_panel(R.read_panels(spark, str(tree)))

    def model(history, unit):
        if unit["unit"] == UNITS[1]:
            raise ValueError("no")
        return forecast(1)

    draws, outcomes = FC.run_forecaster(panel, units, model, DRAWS)
    assert {(r.unit_id, r.status, r.n_rows) for r in outcomes.collect()} == {(UNITS[0], "ok", DRAWS * 4), (UNITS[1], "model_error", 0)}
    assert draws.count() == DRAWS * 4
    short = lambda history, unit: forecast(1).iloc[1:] if unit["unit"] == UNITS[0] else forecast(1).assign(value=float("inf"))
    assert {r.status for r in FC.run_forecaster(panel, units, short, DRAWS)[1].collect()} == {"shape_invalid", "nonfinite_values"}
