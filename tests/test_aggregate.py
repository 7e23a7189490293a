"""Roster means, incentives and cross-unit analysis."""

import pytest
from pyspark.sql import functions as F

from fanchart.operators import aggregate as A
from fanchart.operators import gates as G

HANDLES = [f"u{i}" for i in range(6)]


@pytest.fixture(scope="module")
def roster(spark):
    return spark.createDataFrame([(h, f"2020-0{1 + i // 2}-01") for i, h in enumerate(HANDLES)], "unit_id string, asof string")


def results(spark, scores, sub="s"):
    rows = [(sub, h, "success" if s is not None else "failure", None if s is None else float(s)) for h, s in zip(HANDLES, scores)]
    return spark.createDataFrame(rows, "submission_id string, unit_id string, state string, score double")


def mean(spark, roster, scores):
    return A.roster_mean(results(spark, scores), roster).first()


@pytest.mark.parametrize("honest", [0, 0.5, 3.9, 4.0, 4.1, 6, 9, 12, 1e9])
def test_failing_never_beats_an_honest_score(spark, roster, honest):
    fair = mean(spark, roster, [0.1] * 5 + [honest]).value
    failed = mean(spark, roster, [0.1] * 5 + [None]).value
    assert fair <= failed
    assert failed == pytest.approx((0.5 + 4.0) / 6)
    assert fair == pytest.approx((0.5 + min(honest, 4.0)) / 6)


def test_the_denominator_is_the_roster(spark, roster):
    r = mean(spark, roster, [1.0, 1.0, None])  # three units have no row at all
    assert (r.n_expected, r.n_scored, r.n_failure) == (6, 2, 4)
    assert r.value == pytest.approx((2 + 16) / 6)


def test_nonfinite_scores_are_faults_and_never_averaged(spark):
    bad = results(spark, [1.0, float("nan"), float("inf")])
    assert A.nonfinite_scores(bad).count() == 2
    with pytest.raises(G.OrganizerFault):
        G.raise_on_faults(A.nonfinite_scores(bad), "scores")


def test_missing_repeated_and_foreign_rows_cannot_move_a_mean(spark, roster):
    rows = results(spark, [1.0, 2.0, float("nan")]).unionByName(results(spark, [3.0, 0.0]))
    rows = rows.unionByName(spark.createDataFrame([("s", "elsewhere", "success", 0.0), ("t", "elsewhere", "success", 0.0)], rows.schema))
    got = {r.submission_id: r for r in A.roster_mean(rows, roster).collect()}
    # u0 and u1 count once with their worse value, u2 is not finite, three units have no row
    assert (got["s"].n_scored, got["s"].n_failure) == (2, 4) and got["s"].value == pytest.approx((3.0 + 2.0 + 16) / 6)
    assert (got["t"].n_scored, got["t"].value) == (0, 4.0)


def test_bootstrap_counts_absent_units_as_failures(spark, roster):
    rows = results(spark, [1.0, 1.0]).unionByName(results(spark, [None] * 6, "none"))
    means = A.bootstrap_means(rows, roster, 400, 3).groupBy("submission_id").agg(F.count("*").alias("n"), F.avg("mean").alias("m"), F.max("mean").alias("hi"), F.min("mean").alias("lo"))
    got = {r.submission_id: r for r in means.collect()}
    assert got["s"].n == got["none"].n == 400 and got["none"].lo == got["none"].hi == 4.0
    assert got["s"].m == pytest.approx(A.roster_mean(rows.where("submission_id = 's'"), roster).first().value, abs=0.15)


def test_leaderboard_ranks_ascending_with_ties(spark, roster):
    rows = results(spark, [1] * 6, "b").unionByName(results(spark, [0.5] * 6, "a")).unionByName(results(spark, [1] * 6, "c"))
    board = A.leaderboard(A.roster_mean(rows, roster)).collect()
    assert [(r.submission_id, r["rank"]) for r in board] == [("a", 1), ("b", 2), ("c", 2)]


def test_bootstrap_resamples_whole_clusters(spark, roster):
    # units of one as-of share a score, so every replicate is a mean of cluster values
    got = A.bootstrap_means(results(spark, [0, 0, 1, 1, 2, 2]), roster, 300, 1).collect()
    assert {round(r["mean"] * 3, 9) for r in got} <= {float(k) for k in range(7)}
    ci = A.bootstrap_ci(results(spark, [0, 0, 1, 1, 2, 2]), roster, 300, seed=1).first()
    assert 0 <= ci.lo < 1 < ci.hi <= 2
    flat = A.bootstrap_ci(results(spark, [1] * 6), roster, 50).first()
    assert (flat.lo, flat.hi) == (1.0, 1.0)


def test_roster_coverage_counts(spark, roster):
    rows = results(spark, [1] * 4).unionByName(results(spark, [1])).unionByName(results(spark, [1]).withColumn("unit_id", F.lit("zz")))
    r = G.roster_coverage(rows, roster).first()
    assert (r.duplicate, r.missing, r.extra) == (1, 2, 1)


def test_uplift_uses_the_best_baseline_on_common_units(spark):
    rows = results(spark, [0.5, 0.5, 3.0], "me").unionByName(results(spark, [1.0, 0.8], "b1")).unionByName(results(spark, [0.9, 0.7], "b2"))
    r = A.uplift(rows, ["b1", "b2"]).first()
    assert (r.baseline, r.n_units, r.uplift) == ("b2", 2, pytest.approx(0.3))


def test_sibling_leak_strengths(spark):
    panel = spark.createDataFrame(
        [("a", "X", "2020-01-01", 1.0), ("b", "X", "2020-01-01", 1.0), ("b", "X", "2020-01-05", 5.0), ("b", "X", "2020-01-09", 9.5), ("c", "Y", "2020-01-01", 1.0)],
        "unit_id string, asset string, date string, value double",
    ).withColumn("date", F.to_date("date"))
    realized = spark.createDataFrame(
        [("a", "X", 1, "2020-01-05", 5.0), ("a", "X", 2, "2020-01-09", 9.0), ("a", "X", 3, "2020-01-07", 7.0), ("b", "X", 1, "2020-01-09", 9.5), ("c", "Y", 1, "2020-01-09", 1.0)],
        "unit_id string, asset string, horizon int, target_date string, value double",
    ).withColumn("target_date", F.to_date("target_date"))
    got = {r.unit_id: (r.cells, r.reach_cells, r.row_cells, r.value_cells, r.exposure) for r in A.sibling_leak(panel, realized).collect()}
    assert got == {"a": (3, 3, 2, 1, "part"), "b": (1, 0, 0, 0, "none"), "c": (1, 0, 0, 0, "none")}


def test_parity_reports_missing_and_different_rows(spark):
    a, b = results(spark, [1.0, 2.0, None]), results(spark, [1.0, 2.5, None]).where("unit_id <> 'u0'")
    assert sorted(r.unit_id for r in A.parity(a, b).collect()) == ["u0", "u1"]


def test_phase_budget(spark):
    runs = spark.createDataFrame([("s", i, f"u{i}", s) for i, s in enumerate([100, 2000, 1000, 1800])], "submission_id string, seq int, unit_id string, seconds int")
    got = [r.status for r in A.phase_budget(runs, 1800, 3000).orderBy("seq").collect()]
    assert got == ["completed", "resource_timeout", "completed", "unscored"]


def test_ranks_of_a_whole_table(spark):
    """Ties and a value that half of the rows share, over many ranges."""
    from pyspark.sql import functions as F

    from fanchart.operators.ranking import global_rank, numbered

    rows = [(i, float(i % 50) if i % 2 else 7.0) for i in range(2000)] + [(2000, None)]
    df = spark.createDataFrame(rows, "id int, value double")
    want = {r.id: r["rank"] for r in df.selectExpr("id", "rank() OVER (ORDER BY value) AS rank").collect()}
    assert {r.id: r["rank"] for r in global_rank(df, "value").collect()} == want
    placed = numbered(df, [F.desc("value"), F.asc("id")], "place").orderBy("place").collect()
    assert [r.place for r in placed] == list(range(1, 2002))
    assert [r.id for r in placed] == [r.id for r in df.orderBy(F.desc("value"), "id").collect()]
