"""Metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fanchart.operators import metrics as M
from fanchart.operators import panel as P
from fanchart.plans.bindings import LEVELS, LINE_LEVELS, LINE_SPLIT, PINBALL_SQL, Tables, by_level_sql, rd
from fanchart.plans.catalog.common import rounded
from fanchart.plans.registry import query


def _cells(t: Tables):
    return M.cell_statistics(t.draws, t.realized, LEVELS)


def _lines(t: Tables):
    return M.cell_statistics(t.line_draws, t.line_realized, LINE_LEVELS, split_above=LINE_SPLIT)


@query("met1_crps_marginal", f"SELECT submission_id, unit_id, {rd('avg(crps)')} AS marginal, count(*) AS cell_count, max(m) AS n_draws FROM cell_stats GROUP BY 1, 2")
def crps(t):
    return rounded(M.crps_marginal(t.draws, t.realized))


@query("met1_crps_line_items", f"SELECT submission_id, unit_id, {rd('avg(crps)')} AS marginal, count(*) AS cell_count, max(m) AS n_draws FROM line_stats GROUP BY 1, 2")
def crps_lines(t):
    return rounded(M.crps_marginal(t.line_draws, t.line_realized, split_above=LINE_SPLIT))


@query("met1_cell_statistics_line_items", f"SELECT submission_id, unit_id, asset, m, {rd('y', 8)} AS y, {rd('crps', 8)} AS crps, {rd('below', 8)} AS below, "
       + ", ".join(f"{rd(f'q[{i + 1}]', 8)} AS q{i}" for i in range(len(LINE_LEVELS))) + " FROM line_stats")
def cell_lines(t):
    q = [F.col("q")[i].alias(f"q{i}") for i in range(len(LINE_LEVELS))]
    return rounded(_lines(t).select("submission_id", "unit_id", "asset", "m", "y", "crps", "below", *q), 8)


@query("met1_crps_sliced_cells", f"SELECT submission_id, unit_id, {rd('avg(crps)')} AS marginal, count(*) AS cell_count, max(m) AS n_draws FROM line_stats GROUP BY 1, 2")
def crps_sliced(t):
    """The way that cells of no bounded size take: here every cell above 100 lines is ranked in slices."""
    return rounded(M.crps_marginal(t.line_draws, t.line_realized, split_above=100))


@query("met2_variogram", f"SELECT submission_id, unit_id, {rd('joint', 4)} AS joint FROM joints")
def variogram(t):
    return rounded(M.variogram(t.draws, t.realized), 4)


_PAIRS = [("discount", "price"), ("discount", "quantity"), ("discount", "tax"), ("price", "quantity"), ("price", "tax"), ("quantity", "tax")]


@query(
    "met2_variogram_line_items",
    "SELECT w.submission_id, w.unit_id, " + rd(
        "2 * (" + " + ".join(f"power(sqrt(abs(max(m.{a}) - max(m.{b}))) - avg(sqrt(abs(w.{a} - w.{b}))), 2)" for a, b in _PAIRS) + ")"
    ) + " AS joint FROM line_wide w JOIN line_means m ON m.unit_id = w.unit_id GROUP BY 1, 2",
)
def variogram_lines(t):
    draws = t.line_draws.join(t.line_realized.select("unit_id").distinct(), "unit_id", "left_semi")
    return rounded(M.variogram(draws, t.line_realized))


@query(
    "met3_energy",
    f"SELECT n.submission_id, n.unit_id, {rd('n.near - p.far / 2')} AS joint FROM (SELECT submission_id, unit_id, avg(near) AS near FROM vec GROUP BY 1, 2) n "
    "JOIN (SELECT a.submission_id, a.unit_id, avg(list_distance(a.x, b.x)) AS far FROM vec a JOIN vec b ON a.submission_id = b.submission_id AND a.unit_id = b.unit_id GROUP BY 1, 2) p "
    "ON p.submission_id = n.submission_id AND p.unit_id = n.unit_id",
    {"vec": "SELECT d.submission_id, d.unit_id, d.draw, list(d.value ORDER BY d.asset, d.horizon) AS x, "
     "sqrt(sum(power(d.value - r.value, 2))) AS near FROM rw d JOIN realized r ON r.unit_id = d.unit_id "
     "AND r.asset = d.asset AND r.horizon = d.horizon GROUP BY 1, 2, 3"},
)
def energy(t):
    return rounded(M.energy(t.rw, t.realized, block=64))


_WIDE = [f"x{i}" for i in range(1, 7)]  # no grid has more cells
_GAP = "sqrt(" + " + ".join(f"power(a.{x} - b.{x}, 2)" for x in _WIDE) + ")"


@query(
    "met3_energy_history",
    f"SELECT n.submission_id, n.unit_id, {rd('n.near - coalesce(p.far, CAST(0 AS DOUBLE)) / (n.m * n.m)')} AS joint FROM (SELECT submission_id, unit_id, avg(near) AS near, CAST(count(*) AS DOUBLE) AS m FROM hist_vec GROUP BY 1, 2) n "
    f"LEFT JOIN (SELECT a.unit_id, sum({_GAP}) AS far FROM hist_wide a JOIN hist_wide b ON a.unit_id = b.unit_id AND a.draw < b.draw GROUP BY 1) p ON p.unit_id = n.unit_id",
    {
        "hist_vec": "SELECT d.submission_id, d.unit_id, d.draw, list(d.value ORDER BY d.asset, d.horizon) AS x, sqrt(sum(power(d.value - r.value, 2))) AS near FROM hist d JOIN realized r ON r.unit_id = d.unit_id "
                    "AND r.asset = d.asset AND r.horizon = d.horizon GROUP BY 1, 2, 3",
        "hist_wide": "SELECT unit_id, draw, " + ", ".join(f"coalesce(x[{i}], CAST(0 AS DOUBLE)) AS {x}" for i, x in enumerate(_WIDE, 1)) + " FROM hist_vec",
    },
)
def energy_history(t):
    return rounded(M.energy(t.hist, t.realized))


@query("met4_tail_pinball", f"SELECT submission_id, unit_id, {rd('pinball')} AS tail FROM tails")
def pinball(t):
    return rounded(M.tail_pinball(_cells(t), LEVELS))


@query("met4_pinball_levels_line_items", f"SELECT submission_id, unit_id, level, {rd(f'avg({PINBALL_SQL})')} AS pinball, {rd('avg(CASE WHEN y <= quantile THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)')} AS coverage FROM line_levels GROUP BY 1, 2, 3",
       {"line_levels": by_level_sql("line_stats", LINE_LEVELS)})
def pinball_lines(t):
    return rounded(M.level_scores(_lines(t), LINE_LEVELS))


@query("met5_tail_coverage", f"SELECT submission_id, unit_id, {rd('coverage')} AS tail FROM tails")
def coverage(t):
    return rounded(M.tail_coverage(_cells(t), LEVELS))


@query("met6_composite", f"SELECT submission_id, unit_id, {rd('marginal')} AS marginal, {rd('joint', 4)} AS joint, {rd('tail')} AS tail, "
       f"{rd('w_marginal * marginal + w_joint * joint + w_tail * tail', 4)} AS composite FROM (SELECT c.*, w.w_marginal, w.w_joint, w.w_tail FROM comps c JOIN weights w ON w.unit_id = c.unit_id)")
def composite(t):
    raw = M.composite(t.comps, t.units)
    return raw.select(
        "submission_id", "unit_id", F.round("marginal", 6).alias("marginal"), F.round("joint", 4).alias("joint"),
        F.round("tail", 6).alias("tail"), F.round("composite", 4).alias("composite"),
    )


@query("met7_renorm_weights", f"SELECT unit_id, cell_count, rank_group, {rd('w_marginal', 9)} AS w_marginal, {rd('w_joint', 9)} AS w_joint, {rd('w_tail', 9)} AS w_tail FROM weights WHERE unit_id IN (SELECT DISTINCT unit_id FROM cut)")
def weights(t):
    present = t.units.join(t.cut.select("unit_id").distinct(), "unit_id", "left_semi")
    return rounded(M.renorm_weights(present).withColumn("cell_count", F.col("cell_count").cast("long")), 9)


@query("met8_apply_scale", f"SELECT c.submission_id, c.unit_id, {rd('c.marginal / s.marginal')} AS n_marginal, {rd('c.joint / coalesce(s.joint, CAST(1 AS DOUBLE))')} AS n_joint, {rd('c.tail / s.tail')} AS n_tail FROM comps c JOIN scale s ON s.unit_id = c.unit_id")
def scale(t):
    scale = M.scale_from_components(t.comps.where("submission_id = 'rw'"), t.units)
    out = M.apply_scale(t.comps, scale, M.renorm_weights(t.units))
    return rounded(out.where("fault IS NULL").select("submission_id", "unit_id", "n_marginal", "n_joint", "n_tail"))


@query("met9_make_ref_scale", f"SELECT unit_id, {rd('marginal')} AS marginal, {rd('joint', 4)} AS joint, {rd('tail')} AS tail FROM scale")
def ref_scale(t):
    return t.scale.select("unit_id", F.round("marginal", 6).alias("marginal"), F.round("joint", 4).alias("joint"), F.round("tail", 6).alias("tail"))


@query("met10_select_metric", f"SELECT submission_id, unit_id, tail_metric, {rd('tail')} AS tail FROM comps")
def select_metric(t):
    return rounded(M.select_tail(_cells(t), t.units, LEVELS))


@query("met11_score_payload", f"SELECT submission_id, unit_id, {rd('composite')} AS score, n_draws, cell_count, rank_group, tail_metric, 'ref_scale' AS normalization_mode, 'plan' AS grid_source, {rd('w_marginal')} AS w0 FROM scored")
def payload(t):
    good, _ = M.score_payload(t.scored, "ref_scale", "plan")
    return rounded(good.select(
        "submission_id", "unit_id", "score", "n_draws", F.col("cell_count").cast("long").alias("cell_count"), "rank_group", "tail_metric",
        "normalization_mode", "grid_source", F.col("weights_effective")[0].alias("w0"),
    ))


@query("met12_unscored", "SELECT u.unit_id, CASE WHEN u.unit_id IN (SELECT unit_id FROM line_known) THEN NULL ELSE 'no_reference_in_mounted_unit' END AS unscored_reason, "
       "u.unit_id IN (SELECT unit_id FROM line_known) AS fault FROM (SELECT DISTINCT unit_id FROM line_draws) u WHERE u.unit_id NOT IN (SELECT unit_id FROM line_realized)",
       {"line_known": "SELECT DISTINCT unit_id FROM line_draws WHERE unit_id <> '2001Q4'"})
def unscored(t):
    units = t.line_draws.select("unit_id").distinct()
    roster = units.where("unit_id <> '2001Q4'")
    return M.unscored(units, t.line_realized, roster).select("unit_id", "unscored_reason", "fault")


@query("met13_pit", f"SELECT submission_id, unit_id, asset, horizon, {rd('below')} AS pit FROM cell_stats")
def pit(t):
    return rounded(M.pit(_cells(t)))


@query("met13_pit_histogram", "SELECT submission_id, CAST(least(floor(below * 10) + 1, 10) AS INTEGER) AS bin, count(*) AS n_cells FROM line_stats GROUP BY 1, 2")
def pit_histogram(t):
    return M.pit_histogram(M.pit(_lines(t)))


_CENTRAL = (0.05, 0.25, 0.75, 0.95)


@query("met14_interval_coverage", "SELECT submission_id, count(*) AS n_cells, "
       f"{rd('avg(CASE WHEN y BETWEEN q[3] AND q[4] THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)')} AS pit_50, "
       f"{rd('avg(CASE WHEN y BETWEEN q[2] AND q[5] THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)')} AS pit_90 FROM line_stats GROUP BY 1")
def interval_coverage(t):
    cells = M.cell_statistics(t.line_draws, t.line_realized, _CENTRAL, split_above=LINE_SPLIT)
    return rounded(M.interval_coverage(cells))


@query("met15_tail_flag", f"SELECT submission_id, level, {rd('avg(c)')} AS coverage, abs(avg(c) - level) > 0.05 AS flagged FROM "
       "(SELECT submission_id, level, CASE WHEN y <= quantile THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS c FROM level_rows) GROUP BY 1, 2")
def tail_flag(t):
    return rounded(M.tail_flag(_cells(t), LEVELS))


@query(
    "met16_pit_concentration",
    "SELECT c.submission_id, count(*) AS n_cells, "
    f"{rd('avg(CASE WHEN abs(below - 0.5) <= 0.1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)')} AS share_near_centre, "
    f"{rd('avg(CASE WHEN abs(below - 0.5) <= 0.1 AND (q[4] - q[1]) < s.sd_change * CAST(3.289707253902945 AS DOUBLE) * 0.5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)')} AS share_suspect "
    "FROM central c JOIN hsd s ON s.unit_id = c.unit_id AND s.asset = c.asset AND s.horizon = c.horizon GROUP BY 1",
    {
        "central": "SELECT submission_id, unit_id, asset, horizon, below, q2 AS q FROM (SELECT c.*, x.q2 FROM cell_stats c JOIN "
                   "(SELECT submission_id, unit_id, asset, horizon, quantile_cont(value, [CAST(0.05 AS DOUBLE), CAST(0.25 AS DOUBLE), CAST(0.75 AS DOUBLE), CAST(0.95 AS DOUBLE)]) AS q2 "
                   "FROM draws GROUP BY 1, 2, 3, 4) x ON x.submission_id = c.submission_id AND x.unit_id = c.unit_id AND x.asset = c.asset AND x.horizon = c.horizon)",
        "hsd": "SELECT unit_id, asset, horizon, stddev_samp(ch) AS sd_change FROM (SELECT c.unit_id, c.asset, e.horizon, "
               "c.value - CASE e.horizon WHEN 5 THEN lag(c.value, 5) OVER w ELSE lag(c.value, 21) OVER w END AS ch FROM cut c "
               "JOIN cells e ON e.unit_id = c.unit_id AND e.asset = c.asset WINDOW w AS (PARTITION BY c.unit_id, c.asset, e.horizon ORDER BY c.date)) GROUP BY 1, 2, 3",
    },
)
def pit_concentration(t):
    cells = M.cell_statistics(t.draws, t.realized, _CENTRAL)
    parts = []
    for h in (5, 21):
        units = t.units.where(F.array_contains("horizons", h)).select("unit_id")
        stats = P.h_change_stats(t.cut.join(units, "unit_id", "left_semi"), h)
        parts.append(stats.select("unit_id", "asset", F.lit(h).alias("horizon"), "sd_change"))
    return rounded(M.pit_concentration(cells, parts[0].unionByName(parts[1])))


@query("udf2_tail_registry", f"SELECT submission_id, unit_id, {rd('pinball')} AS pinball, {rd('coverage')} AS coverage FROM tails")
def tail_registry(t):
    scored = M.level_scores(_cells(t), LEVELS).groupBy("submission_id", "unit_id").agg(
        *[build().alias(name) for name, build in M.TAIL_METRICS.items()]
    )
    return rounded(scored)


@query("udf4_joint_switch", f"SELECT d.submission_id, d.unit_id, CASE WHEN d.unit_id LIKE 'F1-%' THEN {rd('e.joint', 4)} ELSE {rd('j.joint', 4)} END AS joint FROM (SELECT DISTINCT submission_id, unit_id FROM draws) d "
       "JOIN joints j ON j.submission_id = d.submission_id AND j.unit_id = d.unit_id "
       "LEFT JOIN (SELECT submission_id, unit_id, avg(crps) AS joint FROM cell_stats GROUP BY 1, 2) e ON e.submission_id = d.submission_id AND e.unit_id = d.unit_id")
def joint_switch(t):
    """One-cell units ask for the energy score, which is the CRPS in one dimension."""
    units = t.units.withColumn("joint", F.when(F.col("family") == "F1", "energy").otherwise("variogram"))
    return rounded(M.joint_scores(t.draws, t.realized, units, ("variogram", "energy")), 4)
