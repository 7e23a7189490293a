"""Gap guard, moments, calendars and outcomes on small panels."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fanchart.operators import generators as FC
from fanchart.operators import panel as P


def panel(spark, rows, unit="u", asset="A"):
    df = spark.createDataFrame([(unit, "p", d, asset, float(v)) for d, v in rows], "unit_id string, panel_id string, date string, asset string, value double")
    return df.withColumn("date", F.to_date("date"))


def units(spark, asof, assets=("A",), horizons=(1,), target="level"):
    return spark.createDataFrame(
        [("u", asof, list(assets), list(horizons), target)], "unit_id string, asof string, asset_ids array<string>, horizons array<int>, target_type string"
    ).withColumn("asof", F.to_date("asof"))


def days(start, n, step=1):
    first = dt.date.fromisoformat(start)
    return [(first + dt.timedelta(days=step * i)).isoformat() for i in range(n)]


def test_gap_guard_drops_the_jump_over_a_hole(spark):
    rows = list(zip(days("2020-01-01", 7), range(1, 8))) + [("2030-01-01", 500)]
    kept = P.gap_guard(P.first_diff(panel(spark, rows))).collect()
    assert [r["diff"] for r in kept] == [1.0] * 6


def test_gap_guard_keeps_a_monthly_panel(spark):
    rows = [(f"2020-{m:02d}-01", m) for m in range(1, 13)]
    assert P.gap_guard(P.first_diff(panel(spark, rows))).count() == 11


def test_differences_without_dates_stay(spark):
    diffs = P.first_diff(panel(spark, zip(days("2020-01-01", 8), range(8)))).withColumn("step", F.lit(None).cast("int"))
    assert P.gap_guard(diffs).count() == 7


def test_rows_after_the_asof_are_cut(spark):
    rows = list(zip(days("2020-06-01", 30), range(30))) + [("2020-12-31", 9)]
    assert P.asof_cut(panel(spark, rows), units(spark, "2020-06-30")).count() == 30


def test_moments_follow_the_target_type(spark):
    rows = list(zip(days("2020-01-01", 5), [1.0, 3.0, 2.0, 6.0, 4.0]))
    level = P.moments(panel(spark, rows), units(spark, "2020-02-01")).first()
    assert (level["last"], level.mu) == (4.0, pytest.approx(0.75))
    ret = P.moments(panel(spark, rows), units(spark, "2020-02-01", target="log_return")).first()
    assert (ret["last"], ret.mu) == (0.0, pytest.approx(3.2))
    assert ret.sigma == pytest.approx(1.7204650534085253)
    none = P.moments(panel(spark, rows, asset="B"), units(spark, "2020-02-01")).first()
    assert (none["last"], none.mu, none.sigma) == (0.0, 0.0, 1.0)


def test_constant_series_keep_a_floor(spark):
    flat = P.moments(panel(spark, [(d, 5.0) for d in days("2020-01-01", 4)]), units(spark, "2020-02-01")).first()
    assert flat.sigma == pytest.approx(5e-4)


def test_first_panel_with_rows_before_the_asof_wins(spark):
    a = panel(spark, [("2021-01-01", 1.0)]).withColumn("panel_id", F.lit("a"))
    b = panel(spark, [("2020-01-01", 2.0)]).withColumn("panel_id", F.lit("b"))
    chosen = P.select_panel(P.asof_cut(a.unionByName(b), units(spark, "2020-06-30")))
    assert [r.panel_id for r in chosen.collect()] == ["b"]


def test_locf_carries_three_days_and_drops_sparse_days(spark):
    cal = spark.createDataFrame([("u", d) for d in days("2020-01-01", 8)], "unit_id string, date string").withColumn("date", F.to_date("date"))
    full = panel(spark, [(d, i) for i, d in enumerate(days("2020-01-01", 8))])
    gappy = panel(spark, [("2020-01-01", 7.0), ("2020-01-08", 9.0)], asset="B")
    gone = panel(spark, [("2020-01-01", 7.0)], asset="C")
    out = P.locf(full.unionByName(gappy).unionByName(gone), cal)
    got = {(r.asset, r.date.day): r.value for r in out.collect()}
    assert got["B", 4] == 7.0 and got["C", 4] == 7.0
    assert ("A", 5) not in got and ("A", 7) not in got  # two series missing
    assert got["A", 8] == 7.0 and got["B", 8] == 9.0 and ("C", 8) not in got


def test_target_dates_skip_weekends_and_holidays(spark):
    dates = spark.createDataFrame([("2020-06-01",), ("2020-07-31",)], "date string").withColumn("date", F.to_date("date"))
    holidays = spark.createDataFrame([("2020-07-03",)], "date string").withColumn("date", F.to_date("date"))
    got = P.target_dates(units(spark, "2020-06-30", horizons=(1, 5)), P.business_calendar(dates, holidays))
    assert {r.horizon: str(r.target_date) for r in got.collect()} == {1: "2020-07-01", 5: "2020-07-08"}


def test_realize_sums_returns(spark):
    rows = list(zip(days("2020-01-01", 6), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]))
    got = P.realize(panel(spark, rows), units(spark, "2020-01-02", horizons=(1, 3), target="log_return")).collect()
    assert {r.horizon: round(r.value, 9) for r in got} == {1: 0.3, 3: 1.2}


def test_joint_shocks_have_the_sample_covariance(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    z = rng.standard_normal((300, 2))
    x = np.column_stack([z[:, 0], 0.8 * z[:, 0] + 0.6 * z[:, 1]]).cumsum(axis=0)
    dates = days("2019-01-01", 300)
    both = panel(spark, zip(dates, x[:, 0])).unionByName(panel(spark, zip(dates, x[:, 1]), asset="B"))
    u = units(spark, "2020-01-01", ("A", "B"))
    aligned = P.align(P.gap_guard(P.first_diff(both)), u)
    draws = FC.joint_shocks(FC.correlation_factors(aligned, u), u, 4000, 1).toPandas()
    wide = draws.pivot(index="draw", columns="asset", values="shock").to_numpy()
    want = np.cov(np.diff(x, axis=0).T)
    assert np.cov(wide.T) == pytest.approx(want, rel=0.1)


def test_draws_do_not_depend_on_partitioning(spark):
    rows = list(zip(days("2020-01-01", 40), [float(i % 7) for i in range(40)]))
    u = units(spark, "2020-03-01", horizons=(1, 5))
    m = P.moments(panel(spark, rows), u)
    a = FC.rw_independent(m, u, 50, 3).orderBy("draw", "horizon").collect()
    b = FC.rw_independent(m.repartition(3), u.repartition(2), 50, 3).orderBy("draw", "horizon").collect()
    assert a == b


@pytest.mark.parametrize(
    ("reply", "matched", "reason"),
    [
        ('x {"assets": {"A": {"drift_bp": 5, "vol_scale": 1.1}}} y', 1, ""),
        ('{"A": {"drift_bp": 5}}', 1, ""),
        ('{"assets": {"Q": {}}, "A": {"drift_bp": 5}}', 1, ""),
        ("no json here", 0, "reply contained no JSON object"),
        ("{broken", 0, "reply contained no JSON object"),
        ('{"A": 5}', 0, "reply named none of the requested assets"),
    ],
)
def test_replies(spark, reply, matched, reason):
    u = units(spark, "2020-01-01")
    rows, outcome = FC.parse_adjustments(spark.createDataFrame([("u", reply)], "unit_id string, reply string"), u)
    got = outcome.first()
    assert (got.matched, got.reason, rows.count()) == (matched, reason, matched)


@pytest.mark.parametrize(
    ("drift", "vol", "shift", "factor"),
    [("100", "1.5", 0.05, 1.5), ("-100", "9", -0.05, 2.0), ("1e12", "0.1", 0.6, 0.5), ("-1e12", "1", -0.6, 1.0), ("NaN", "1.5", 0.0, 1.0), ("up", "1.5", 0.0, 1.0), (None, "1.5", 0.0, 1.5)],
)
def test_adjustments_are_clamped(spark, drift, vol, shift, factor):
    adj = spark.createDataFrame([("u", "A", drift, vol)], "unit_id string, asset string, drift_bp string, vol_scale string")
    scale = spark.createDataFrame([("u", "A", -5.0, 0.2)], "unit_id string, asset string, last double, sd_h double")
    r = FC.clamped_adjustments(adj, scale, ["unit_id"]).first()
    assert (r["shift"], r.vol) == (pytest.approx(shift), factor)
