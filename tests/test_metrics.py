"""Metrics against brute force, and the invariants of the score."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fanchart.contract import CELL_KEYS
from fanchart.operators import metrics as M
from fanchart.operators import ranking
from fanchart.operators.ranking import ranked
from fanchart.sources.materialize import materialized

LEVELS = (0.01, 0.05, 0.95, 0.99)
ASSETS, HORIZONS = ["SYN-A", "SYN-B"], [1, 5]


def draw_table(spark, samples, submission="s", unit="u"):
    """``samples[m, asset, horizon]`` to long rows."""
    rows = [
        (submission, unit, d, a, h, float(samples[d, i, j]))
        for d in range(samples.shape[0]) for i, a in enumerate(ASSETS[: samples.shape[1]]) for j, h in enumerate(HORIZONS[: samples.shape[2]])
    ]
    return spark.createDataFrame(rows, "submission_id string, unit_id string, draw int, asset string, horizon int, value double")


def outcome(spark, y, unit="u"):
    rows = [(unit, a, h, float(y[i, j])) for i, a in enumerate(ASSETS[: y.shape[0]]) for j, h in enumerate(HORIZONS[: y.shape[1]])]
    return spark.createDataFrame(rows, "unit_id string, asset string, horizon int, value double")


def unit_table(spark, assets=2, horizons=2, tail="pinball", joint="variogram"):
    return spark.createDataFrame(
        [("u", ASSETS[:assets], HORIZONS[:horizons], tail, joint, 0.5, 0.3, 0.2)],
        "unit_id string, asset_ids array<string>, horizons array<int>, tail_metric string, joint string, w_marginal double, w_joint double, w_tail double",
    )


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(3)
    x = 1.0 + 0.25 * rng.standard_normal((60, 2, 2))
    y = np.array([[1.1, 0.7], [0.95, 1.6]])
    return x, y, draw_table(spark, x), outcome(spark, y)


def test_crps_equals_the_pairwise_form(case):
    x, y, draws, realized = case
    flat, truth = x.reshape(60, 4), y.ravel()
    near = np.abs(flat - truth).mean(axis=0)
    spread = np.abs(flat[:, None, :] - flat[None, :, :]).mean(axis=(0, 1)) / 2
    got = M.crps_marginal(draws, realized).first()
    assert got.marginal == pytest.approx((near - spread).mean(), abs=1e-12)
    assert (got.cell_count, got.n_draws) == (4, 60)


def test_quantiles_pinball_and_coverage_equal_numpy(case):
    x, y, draws, realized = case
    cells = M.cell_statistics(draws, realized, LEVELS)
    q = np.quantile(x.reshape(60, 4), LEVELS, axis=0)
    got = {(r.asset, r.horizon): r.q for r in cells.collect()}
    for k, (a, h) in enumerate((a, h) for a in ASSETS for h in HORIZONS):
        assert got[a, h] == pytest.approx(list(q[:, k]), abs=1e-12)
    t = y.ravel()
    loss = [np.where(t >= q[i], a * (t - q[i]), (1 - a) * (q[i] - t)).mean() for i, a in enumerate(LEVELS)]
    assert M.tail_pinball(cells, LEVELS).first().tail == pytest.approx(np.mean(loss), abs=1e-12)
    cover = sum(abs((t <= q[i]).mean() - a) for i, a in enumerate(LEVELS))
    assert M.tail_coverage(cells, LEVELS).first().tail == pytest.approx(cover, abs=1e-12)


def test_variogram_counts_both_orders_with_exponent_one_half(case):
    x, y, draws, realized = case
    flat, t = x.reshape(60, 4), y.ravel()
    want = sum(
        (abs(t[i] - t[j]) ** 0.5 - (np.abs(flat[:, i] - flat[:, j]) ** 0.5).mean()) ** 2
        for i in range(4) for j in range(4) if i != j
    )
    assert M.variogram(draws, realized).first().joint == pytest.approx(want, abs=1e-12)
    assert M.variogram(draws, realized, pair_weight=1.0).first().joint == pytest.approx(want / 2, abs=1e-12)
    squared = sum(
        (abs(t[i] - t[j]) ** 1.5 - (np.abs(flat[:, i] - flat[:, j]) ** 1.5).mean()) ** 2
        for i in range(4) for j in range(4) if i != j
    )
    assert M.variogram(draws, realized, p=1.5).first().joint == pytest.approx(squared, abs=1e-12)


@pytest.mark.parametrize("block", [7, 16, 512])
def test_energy_equals_brute_force_for_any_block(case, block):
    x, y, draws, realized = case
    flat, t = x.reshape(60, 4), y.ravel()
    far = np.linalg.norm(flat[:, None, :] - flat[None, :, :], axis=2).mean() / 2
    want = np.linalg.norm(flat - t, axis=1).mean() - far
    assert M.energy(draws, realized, block).first().joint == pytest.approx(want, abs=1e-12)


def test_one_cell_variogram_is_zero_and_energy_is_crps(spark):
    x = np.random.default_rng(0).standard_normal((40, 1, 1))
    y = np.array([[0.3]])
    draws, realized = draw_table(spark, x), outcome(spark, y)
    assert M.variogram(draws, realized).first().joint == 0.0
    assert M.energy(draws, realized).first().joint == pytest.approx(M.crps_marginal(draws, realized).first().marginal, abs=1e-12)


def test_permuting_rows_and_draws_changes_nothing(case):
    x, y, draws, realized = case
    perm = draws.withColumn("draw", 59 - F.col("draw")).orderBy(F.rand(5)).repartition(3)
    a, b = M.crps_marginal(draws, realized).first(), M.crps_marginal(perm, realized).first()
    assert a.marginal == pytest.approx(b.marginal, abs=1e-13)
    assert M.variogram(draws, realized).first().joint == pytest.approx(M.variogram(perm, realized).first().joint, abs=1e-13)


def test_hot_groups_are_ranked_exactly(spark):
    """One cell holds most rows, a third of them one repeated value."""
    rng = np.random.default_rng(9)
    hot = np.concatenate([np.full(1500, 2.5), np.round(rng.standard_normal(3000), 2), rng.exponential(50, 500)])
    cold = rng.standard_normal(40)
    rows = [("s", "u", "A", 1, float(v)) for v in hot] + [("s", "u", "B", 1, float(v)) for v in cold]
    df = spark.createDataFrame(rows, "submission_id string, unit_id string, asset string, horizon int, value double").repartition(4)
    got = ranked(df, CELL_KEYS, split_above=100).toPandas()
    assert got[got.asset == "B"].n.sum() == 40 and got[got.asset == "A"].n.sum() == 5000
    a = got[got.asset == "A"].sort_values("value")
    order = pd.Series(np.sort(hot))
    lo, hi = order.groupby(order).apply(lambda s: s.index[0] + 1), order.groupby(order).apply(lambda s: s.index[-1] + 1)
    assert list(a.value) == list(lo.index)
    assert list(a.lo) == list(lo) and list(a.hi) == list(hi) and set(a.m) == {5000}


def test_work_of_unbounded_groups_follows_their_distinct_values(spark, monkeypatch):
    """Neither the number of slices nor the rows of a window grow with repeats or with a low split_above."""
    rows = [("s", "u", "A", 1, float(i % 10)) for i in range(3000)] + [("s", "u", "B", 1, float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "submission_id string, unit_id string, asset string, horizon int, value double")
    parts = {}

    def noted(df, name):
        parts[name] = df.rdd.getNumPartitions()
        return materialized(df, name)

    monkeypatch.setattr(ranking, "materialized", noted)
    got = ranked(df, CELL_KEYS, split_above=1)
    assert got.count() == 3010 and parts["rank-slices"] <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = ranked(df, CELL_KEYS, split_above=1_000_000).where("asset = 'A'").orderBy("lo").collect()
    assert [(r.value, r.n, r.lo, r.hi, r.m) for r in whole] == [(float(i), 300, 300 * i + 1, 300 * i + 300, 3000) for i in range(10)]
    carried = ranked(df.withColumn("y", F.lit(2.0)), CELL_KEYS, carry=["y"], split_above=100)
    assert carried.agg(F.sum("n"), F.max("y")).first() == (6000, 2.0)


def test_sliced_and_plain_ranking_give_the_same_scores(spark):
    x = np.round(np.random.default_rng(1).standard_normal((900, 2, 2)), 1)
    y = np.array([[0.0, 0.2], [-1.0, 3.0]])
    draws, realized = draw_table(spark, x), outcome(spark, y)
    keys = ["asset", "horizon"]
    plain = {tuple(r[k] for k in keys): r for r in M.cell_statistics(draws, realized, LEVELS).collect()}
    sliced = {tuple(r[k] for k in keys): r for r in M.cell_statistics(draws, realized, LEVELS, split_above=50).collect()}
    for k, r in plain.items():
        for c in ("m", "y", "mean", "crps", "below"):
            assert sliced[k][c] == pytest.approx(r[c], abs=1e-12)
        assert sliced[k].q == pytest.approx(r.q, abs=1e-12)


@pytest.mark.parametrize(("assets", "horizons"), [(2, 2), (1, 1)])
def test_the_baseline_scores_one_under_its_own_scale(spark, assets, horizons):
    x = np.random.default_rng(4).standard_normal((200, assets, horizons))
    y = np.array([[0.4, -0.2], [1.0, 0.1]])[:assets, :horizons]
    draws, realized, units = draw_table(spark, x), outcome(spark, y), unit_table(spark, assets, horizons)
    scale = M.make_ref_scale(draws, realized, units, LEVELS)
    scored = M.composite(M.components(draws, realized, units, LEVELS), units, scale).first()
    assert scored.fault is None
    assert scored.composite == pytest.approx(1.0, abs=1e-12)


def test_published_composites_follow_from_their_components(spark):
    comps = spark.createDataFrame(
        [("s", "u", 0.39791, 0.0078938, 0.066353, 500, "pinball")],
        "submission_id string, unit_id string, marginal double, joint double, tail double, n_draws int, tail_metric string",
    )
    assert M.composite(comps, unit_table(spark, 2, 1)).first().composite == pytest.approx(0.21459381556079962, abs=5e-6)
    monthly = comps.withColumns({"marginal": F.lit(0.89332), "joint": F.lit(0.0), "tail": F.lit(0.041223)})
    assert M.composite(monthly, unit_table(spark, 1, 1)).first().composite == pytest.approx(0.6498607072684922, abs=5e-6)


def test_missing_scale_and_unknown_metrics_are_faults(spark, case):
    _, _, draws, realized = case
    units = unit_table(spark)
    comps = M.components(draws, realized, units, LEVELS)
    partial = spark.createDataFrame([("u", 1.0, None, 1.0)], "unit_id string, marginal double, joint double, tail double")
    payload, faults = M.score_payload(M.composite(comps, units, partial), "ref_scale", "plan")
    assert payload.count() == 0 and faults.first().fault == "no usable scale"
    assert M.metric_faults(unit_table(spark, tail="median")).first().fault == "unknown tail metric"
    assert M.metric_faults(unit_table(spark, joint="copula")).first().fault == "unknown joint metric"
    assert M.metric_faults(units).count() == 0


def test_units_are_scored_on_their_own_levels(spark, case):
    _, _, draws, realized = case
    cells = M.cell_statistics(draws, realized, LEVELS)
    own = unit_table(spark).withColumn("tail_levels", F.array(F.lit(0.05), F.lit(0.95)))
    pair = M.cell_statistics(draws, realized, (0.05, 0.95))
    assert M.select_tail(cells, own, LEVELS).first().tail == pytest.approx(M.tail_pinball(pair, (0.05, 0.95)).first().tail, abs=1e-12)
    assert M.metric_faults(own, (0.05,)).first().fault == "tail level not computed"
    assert M.metric_faults(unit_table(spark, joint="energy"), LEVELS, ("variogram",)).first().fault == "joint metric not computed"


def test_unscored_units_are_faults_only_on_the_roster(spark):
    units = spark.createDataFrame([("u",), ("v",), ("w",)], "unit_id string")
    realized = spark.createDataFrame([("w", 1.0)], "unit_id string, value double")
    roster = spark.createDataFrame([("u",), ("w",)], "unit_id string")
    got = {r.unit_id: r for r in M.unscored(units, realized, roster).collect()}
    assert got["u"].fault and got["u"].unscored_reason is None
    assert not got["v"].fault and got["v"].unscored_reason == "no_reference_in_mounted_unit"
    assert "w" not in got


def test_pinball_separates_what_coverage_cannot(spark):
    x = np.random.default_rng(2).standard_normal((300, 1, 1))
    near, far = np.array([[4.0]]), np.array([[40.0]])
    score = lambda y, f: f(M.cell_statistics(draw_table(spark, x), outcome(spark, y), LEVELS), LEVELS).first().tail
    assert score(near, M.tail_coverage) == score(far, M.tail_coverage)
    assert score(near, M.tail_pinball) < score(far, M.tail_pinball)
