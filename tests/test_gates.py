"""One edit to a valid submission gives one coded refusal with exact counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fanchart.operators import gates as G

ASSETS, HORIZONS, M = ["SYN-A", "SYN-B"], [1, 5], 200


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(
        [("u", "2020-06-30", ASSETS, HORIZONS, ["2020-07-01", "2020-07-07"], "level")],
        "unit_id string, asof string, asset_ids array<string>, horizons array<int>, target_dates array<string>, target_type string",
    ).withColumn("asof", F.to_date("asof"))


@pytest.fixture(scope="module")
def meta(spark):
    return spark.createDataFrame(
        [("s", "u", "u", "2020-06-30", "samples", ASSETS, HORIZONS, M, "integer", "level")],
        "submission_id string, unit_id string, declared_unit string, asof string, representation string, asset_ids array<string>, horizons array<int>, n_draws int, n_draws_type string, target string",
    )


@pytest.fixture(scope="module")
def draws(spark):
    rng = np.random.default_rng(0)
    rows = [("s", "u", d, a, h, float(1 + 0.25 * z)) for d, z in enumerate(rng.standard_normal(M)) for a in ASSETS for h in HORIZONS]
    return spark.createDataFrame(rows, "submission_id string, unit_id string, draw int, asset string, horizon int, value double").cache()


def first(units, meta, draws):
    return G.run_ladder({"units": units, "meta": meta, "draws": draws}, without=("expected", "files", "file_facts", "meta_errors", "rationales")).first()


def cell(d, a="SYN-A", h=1):
    return (F.col("draw") == d) & (F.col("asset") == a) & (F.col("horizon") == h)


def test_a_valid_submission_passes(units, meta, draws):
    assert first(units, meta, draws) is None


def test_an_extra_row_is_incomplete(units, meta, draws):
    r = first(units, meta, draws.unionByName(draws.where(cell(0))))
    assert (r.code, r.counts["observed_count"], r.counts["expected_count"]) == ("incomplete_output", 801, 800)


def test_a_duplicate_with_a_compensating_omission(units, meta, draws):
    broken = draws.withColumn("draw", F.when(cell(3), 4).otherwise(F.col("draw")))
    r = first(units, meta, broken)
    assert (r.code, r.counts["invalid_row_count"], r.counts["missing_count"]) == ("incomplete_output", 1, 1)


@pytest.mark.parametrize(("column", "value"), [("asset", "SYN-Z"), ("horizon", 9)])
def test_a_label_outside_the_grid(units, meta, draws, column, value):
    r = first(units, meta, draws.withColumn(column, F.when(cell(2), F.lit(value)).otherwise(F.col(column))))
    assert (r.code, r.counts["extra_count"]) == ("schema_invalid", 1)


def test_shifted_draw_ids(units, meta, draws):
    r = first(units, meta, draws.withColumn("draw", F.col("draw") + 1))
    assert (r.gate, r.code, r.counts["invalid_row_count"]) == ("g3_domain_semantics", "schema_invalid", 4)


@pytest.mark.parametrize(("value", "name"), [(float("nan"), "nonfinite_count"), (float("inf"), "nonfinite_count"), (None, "invalid_row_count")])
def test_values_that_are_no_numbers(units, meta, draws, value, name):
    r = first(units, meta, draws.withColumn("value", F.when(cell(7), F.lit(value)).otherwise(F.col("value"))))
    assert (r.code, r.counts[name]) == ("schema_invalid", 1)


@pytest.mark.parametrize("n", [3, 199, 20_001])
def test_declared_draws_outside_the_contract(units, meta, draws, n):
    r = first(units, meta.withColumn("n_draws", F.lit(n)), draws)
    assert (r.gate, r.code, r.counts["observed_count"]) == ("g1_schema", "schema_invalid", n)


def test_declared_draws_differ_from_observed(units, meta, draws):
    assert first(units, meta.withColumn("n_draws", F.lit(201)), draws).code == "incomplete_output"


@pytest.mark.parametrize(
    ("column", "value", "gate", "code"),
    [
        ("asof", "2020-06-29", "g2_cutoff_resource", "cutoff_violation"),
        ("asof", "June", "g2_cutoff_resource", "schema_invalid"),
        ("declared_unit", "other", "g2_cutoff_resource", "schema_invalid"),
        ("target", "log_return", "g2_cutoff_resource", "schema_invalid"),
        ("representation", "parametric", "g1_schema", "schema_invalid"),
        ("n_draws_type", "boolean", "g1_schema", "schema_invalid"),
    ],
)
def test_sidecar_defects(units, meta, draws, column, value, gate, code):
    r = first(units, meta.withColumn(column, F.lit(value)), draws)
    assert (r.gate, r.code) == (gate, code)


def test_an_undeclared_target_is_allowed(units, meta, draws):
    assert first(units, meta.withColumn("target", F.lit(None).cast("string")), draws) is None


def test_repeated_and_reordered_axes(units, meta, draws):
    r = first(units, meta.withColumn("asset_ids", F.array(F.lit("SYN-A"), F.lit("SYN-A"))), draws)
    assert (r.code, r.counts) == ("schema_invalid", {"invalid_row_count": 1})
    r = first(units, meta.withColumn("asset_ids", F.reverse("asset_ids")), draws)
    assert (r.code, r.counts["missing_count"], r.counts["extra_count"]) == ("schema_invalid", 0, 0)
    r = first(units, meta.withColumn("horizons", F.array(F.lit(1), F.lit(6))), draws)
    assert (r.counts["missing_count"], r.counts["extra_count"]) == (1, 1)


def test_the_earliest_gate_decides(units, meta, draws):
    r = first(units, meta.withColumn("asof", F.lit("2020-01-01")), draws.where(~cell(0)))
    assert r.code == "cutoff_violation"


def test_file_sets(spark):
    keys = "submission_id string, unit_id string"
    expected = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c"), ("s", "d")], keys)
    full = ["forecast.parquet", "forecast_meta.json", "forecast_rationale.md"]
    rows = [("s", "a", n, 1) for n in full] + [("s", "b", n, 1) for n in [*full, "notes.txt"]] + [("s", "c", full[0], 1)]
    files = spark.createDataFrame(rows, keys + ", name string, length int")
    got = {r.unit_id: r for r in G.file_set(files, expected).collect()}
    assert "a" not in got
    assert (got["b"].code, got["b"].counts["extra_count"]) == ("schema_invalid", 1)
    assert (got["c"].code, got["c"].counts["missing_count"]) == ("no_output", 1)
    assert (got["d"].code, got["d"].counts["missing_count"]) == ("no_output", 2)


def test_organizer_faults_raise(units):
    G.raise_on_faults(G.declared_cutoff(units), "cutoff")
    late = units.withColumn("target_dates", F.array(F.lit("2020-06-30")))
    with pytest.raises(G.OrganizerFault):
        G.raise_on_faults(G.declared_cutoff(late), "cutoff")


def test_labels_cover_every_code(spark):
    from fanchart.contract import LABEL_FOR_CODE

    rows = spark.createDataFrame([(c,) for c in LABEL_FOR_CODE], "code string")
    assert {r.code: r.label for r in G.label_for(rows).collect()} == LABEL_FOR_CODE


def test_corpus_check_is_skipped_when_no_entry_names_a_file(spark, units):
    index = spark.createDataFrame([("u", "d1", "2020-06-01T10:00", None), ("u", "", "soon", None), ("u", "d3", "2021-01-01", None)], "unit_id string, doc_id string, timestamp string, path string")
    files = spark.createDataFrame([("u", "stray.txt")], "unit_id string, path string")
    r = G.corpus_cutoff(index, files, units).first()
    assert (r.no_doc_id, r.undated, r.late, r.unindexed, r.absent) == (1, 1, 1, 0, 0)
    named = index.withColumn("path", F.lit("a.txt"))
    r = G.corpus_cutoff(named, files, units).first()
    assert (r.unindexed, r.absent) == (1, 1)


def test_a_shock_must_be_a_horizon_away(spark):
    """F4 counts business days; the other families count months to the first target."""
    from fanchart.operators import panel as P

    days = spark.sql("SELECT explode(sequence(DATE'2019-01-01', DATE'2019-12-31')) AS date")
    calendar = P.business_calendar(days, spark.sql("SELECT DATE'2019-01-21' AS date"))
    rows = [("far", "F4", "2019-01-31", ["2019-02-07"], "2019-02-07"), ("near", "F4", "2019-01-31", ["2019-02-06"], "2019-02-06"), ("holiday", "F4", "2019-01-18", ["2019-01-25"], "2019-01-25"),
            ("open", "F4", "2019-01-31", ["2019-02-07"], None), ("f1", "F1", "2019-01-31", ["2019-07-31"], None), ("f3", "F3", "2019-01-31", ["2019-02-27"], None)]
    units = spark.createDataFrame(rows, "unit_id string, family string, asof string, target_dates array<string>, shock_date string")
    units = units.selectExpr("unit_id", "family", "CAST(asof AS DATE) AS asof", "target_dates", "CAST(shock_date AS DATE) AS shock_date", "array(1, 5) AS horizons")
    got = {r.unit_id: (r.ok, r.gap_days) for r in G.min_gap(units, calendar).collect()}
    assert got == {"far": (True, 5), "near": (False, 4), "holiday": (False, 4), "open": (False, None), "f1": (True, None), "f3": (False, None)}
