"""Panel preparation queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanchart.operators import panel as P
from fanchart.plans.bindings import HORIZONS, rd
from fanchart.plans.catalog.common import rounded, ten_thousandths, text, whole_sum
from fanchart.plans.registry import query


def _summary(df, value="value", digits=4):
    return df.groupBy("unit_id", "asset").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").cast("string").alias("first"),
        F.max("date").cast("string").alias("last"), F.round(F.sum(value), digits).alias("total"),
    )


def _summary_sql(source: str, value: str = "value", digits: int = 4) -> str:
    return (
        f"SELECT unit_id, asset, count(*) AS n, CAST(min(date) AS VARCHAR) AS first, CAST(max(date) AS VARCHAR) AS last, "
        f"{rd(f'sum({value})', digits)} AS total FROM {source} GROUP BY 1, 2"
    )


@query("pan1_asof_cut", _summary_sql("cut"))
def asof_cut(t):
    return _summary(P.asof_cut(t.unit_panel, t.units))


_TWO = {
    "stack": "SELECT unit_id, asof, 'b_daily' AS panel_id, date, asset, value FROM unit_panel UNION ALL "
             "SELECT u.unit_id, u.asof, 'a_late', p.date, p.asset, p.value * 2 FROM unit_assets u JOIN panel p ON u.asset = p.asset WHERE p.date >= DATE '1998-01-01'",
}


@query("pan2_select_panel", "SELECT unit_id, asset, panel_id, count(*) AS n, " + rd("sum(value)", 4) + " AS total FROM "
       "(SELECT *, dense_rank() OVER (PARTITION BY unit_id, asset ORDER BY panel_id) AS k FROM stack WHERE date <= asof) WHERE k = 1 GROUP BY 1, 2, 3", _TWO)
def select_panel(t):
    late = t.panel.where("date >= DATE'1998-01-01'").withColumn("value", F.col("value") * 2).withColumn("panel_id", F.lit("a_late"))
    both = t.unit_panel.withColumn("panel_id", F.lit("b_daily")).unionByName(t.per_unit(late))
    chosen = P.select_panel(P.asof_cut(both, t.units))
    return chosen.groupBy("unit_id", "asset", "panel_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query("pan3_require_assets", "SELECT a.unit_id, a.asset, 'A,R' AS available FROM unit_assets a "
       "WHERE a.asset = 'N' AND EXISTS (SELECT 1 FROM panel) AND a.n_assets > 2 UNION ALL "
       "SELECT a.unit_id, a.asset, 'A' FROM unit_assets a WHERE a.asset = 'N' AND a.n_assets = 2 AND EXISTS (SELECT 1 FROM panel)")
def require_assets(t):
    return P.require_assets(t.unit_panel.where("asset <> 'N'"), t.units)


_HOLES = {
    "gaps": "SELECT date, asset, CASE WHEN day(date) = 13 THEN CAST('NaN' AS DOUBLE) WHEN day(date) = 14 THEN CAST('Infinity' AS DOUBLE) "
            "WHEN day(date) = 15 THEN NULL ELSE value END AS value FROM panel",
}


@query("pan4_drop_nonfinite", f"SELECT asset, count(*) AS n, {rd('sum(value)', 4)} AS total FROM gaps WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value) GROUP BY 1", _HOLES)
def drop_nonfinite(t):
    day = F.dayofmonth("date")
    v = F.when(day == 13, F.lit(float("nan"))).when(day == 14, F.lit(float("inf"))).when(day == 15, F.lit(None)).otherwise(F.col("value"))
    kept = P.drop_nonfinite(t.panel.withColumn("value", v))
    return kept.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("pan5_anchor", f"SELECT unit_id, asset, {rd('last')} AS last, CAST(last_date AS VARCHAR) AS last_date FROM anchors")
def anchor(t):
    return rounded(t.anchors.select("unit_id", "asset", "last", text("last_date")))


@query("pan6_first_diff", f"SELECT unit_id, asset, count(*) AS n, CAST(sum(step) AS BIGINT) AS days, {rd('sum(abs(diff))', 3)} AS moved FROM raw_diffs GROUP BY 1, 2")
def first_diff(t):
    return P.first_diff(t.cut).groupBy("unit_id", "asset").agg(
        F.count(F.lit(1)).alias("n"), F.sum("step").alias("days"), F.round(F.sum(F.abs("diff")), 3).alias("moved")
    )


_TRANSFER = {
    "t_diffs": "SELECT * FROM (SELECT unit_id, asset, date, value - lag(value) OVER w AS diff, date_diff('day', lag(date) OVER w, date) AS step "
               "FROM transfer WINDOW w AS (PARTITION BY unit_id, asset ORDER BY date)) WHERE diff IS NOT NULL",
    "t_kept": "SELECT d.* FROM t_diffs d JOIN (SELECT unit_id, asset, greatest(10 * quantile_cont(step, 0.5), 5) AS lim FROM t_diffs GROUP BY 1, 2) g "
              "ON d.unit_id = g.unit_id AND d.asset = g.asset WHERE d.step <= g.lim",
}


@query("pan7_gap_guard", f"SELECT r.unit_id, r.asset, r.n, k.n AS kept, r.widest, k.widest AS widest_kept, {rd('k.moved', 3)} AS moved FROM "
       "(SELECT unit_id, asset, count(*) AS n, max(step) AS widest FROM t_diffs GROUP BY 1, 2) r JOIN "
       "(SELECT unit_id, asset, count(*) AS n, max(step) AS widest, sum(abs(diff)) AS moved FROM t_kept GROUP BY 1, 2) k ON r.unit_id = k.unit_id AND r.asset = k.asset", _TRANSFER)
def gap_guard(t):
    raw = P.first_diff(t.transfer)
    before = raw.groupBy("unit_id", "asset").agg(F.count(F.lit(1)).alias("n"), F.max("step").cast("long").alias("widest"))
    after = P.gap_guard(raw).groupBy("unit_id", "asset").agg(
        F.count(F.lit(1)).alias("kept"), F.max("step").cast("long").alias("widest_kept"), F.round(F.sum(F.abs("diff")), 3).alias("moved")
    )
    return before.join(after, ["unit_id", "asset"])


_MIXED = {
    "m_diffs": "SELECT * FROM (SELECT unit_id, asset, date, value - lag(value) OVER w AS diff, date_diff('day', lag(date) OVER w, date) AS step "
               "FROM mixed_cut WHERE unit_id NOT LIKE 'F2-%' WINDOW w AS (PARTITION BY unit_id, asset ORDER BY date)) WHERE diff IS NOT NULL",
    "m_steps": "SELECT unit_id, asset, date, value AS step_value FROM mixed_cut WHERE unit_id LIKE 'F2-%' UNION ALL "
               "SELECT d.unit_id, d.asset, d.date, d.diff FROM m_diffs d JOIN (SELECT unit_id, asset, greatest(10 * quantile_cont(step, 0.5), 5) AS lim FROM m_diffs GROUP BY 1, 2) g "
               "ON d.unit_id = g.unit_id AND d.asset = g.asset WHERE d.step <= g.lim",
    "m_moments": "SELECT a.unit_id, a.asset, CASE WHEN a.family = 'F2' OR n.last IS NULL THEN CAST(0 AS DOUBLE) ELSE n.last END AS last, coalesce(s.mu, CAST(0 AS DOUBLE)) AS mu, "
                 "CASE WHEN n.last IS NULL THEN CAST(1 AS DOUBLE) WHEN a.family = 'F2' THEN greatest(s.sd, CAST(0.000001 AS DOUBLE)) ELSE "
                 "greatest(coalesce(s.sd, CAST(0 AS DOUBLE)), abs(n.last) * CAST(0.0001 AS DOUBLE), CAST(0.000001 AS DOUBLE)) END AS sigma FROM unit_assets a "
                 "LEFT JOIN (SELECT unit_id, asset, arg_max(value, date) AS last FROM mixed_cut GROUP BY 1, 2) n ON n.unit_id = a.unit_id AND n.asset = a.asset "
                 "LEFT JOIN (SELECT unit_id, asset, avg(step_value) AS mu, stddev_pop(step_value) AS sd FROM m_steps GROUP BY 1, 2) s ON s.unit_id = a.unit_id AND s.asset = a.asset",
}


@query("pan8_steps", _summary_sql("m_steps", "abs(step_value)", 3), _MIXED)
def steps(t):
    s = P.steps(t.mixed_cut, t.mixed_units)
    return _summary(s.withColumn("value", F.abs("step_value")), digits=3)


@query("pan9_moments", f"SELECT unit_id, asset, {rd('last')} AS last, {rd('mu')} AS mu, {rd('sigma')} AS sigma FROM m_moments", _MIXED)
def moments(t):
    return rounded(P.moments(t.mixed_cut, t.mixed_units))


@query("pan10_align", f"SELECT unit_id, asset, count(*) AS n, max(n_rows) AS n_rows, {rd('sum(abs(diff))', 3)} AS moved FROM aligned GROUP BY 1, 2")
def align(t):
    return t.aligned.groupBy("unit_id", "asset").agg(
        F.count(F.lit(1)).alias("n"), F.max("n_rows").alias("n_rows"), F.round(F.sum(F.abs("diff")), 3).alias("moved")
    )


_HDIFF = {
    "h_diffs": "SELECT * FROM (SELECT asset, date, value - lag(value) OVER w AS diff FROM panel_holey WINDOW w AS (PARTITION BY asset ORDER BY date)) WHERE diff IS NOT NULL",
}


@query("pan10_align_sparse", "SELECT asset, count(*) AS n, " + rd("sum(abs(diff))", 2) + " AS moved FROM h_diffs WHERE date IN "
       "(SELECT date FROM h_diffs GROUP BY 1 HAVING count(*) = 5) GROUP BY 1", _HDIFF)
def align_sparse(t):
    aligned = P.align(P.gap_guard(P.first_diff(t.holey)), t.holey_units)
    return aligned.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs("diff")), 2).alias("moved"))


@query("pan11_sample_sd", f"SELECT unit_id, asset, {rd('daily_sd')} AS daily_sd, n_rows FROM sds")
def sample_sd(t):
    return rounded(P.sample_sd(t.aligned))


@query("pan12_corr_matrix", f"SELECT a.unit_id, a.asset AS asset_a, b.asset AS asset_b, CASE WHEN a.asset = b.asset THEN CAST(1 AS DOUBLE) ELSE {rd('corr(a.diff, b.diff)')} END AS corr "
       "FROM aligned a JOIN aligned b ON a.unit_id = b.unit_id AND a.date = b.date GROUP BY a.unit_id, a.asset, b.asset")
def corr(t):
    return rounded(P.corr_matrix(t.aligned))


@query("pan14_business_days", f"SELECT asset, count(*) AS n, {rd('sum(value)', 3)} AS total FROM panel WHERE dayofweek(date) BETWEEN 1 AND 5 AND date NOT IN "
       "(DATE '1996-01-01', DATE '1997-01-01', DATE '1998-01-01', DATE '1999-01-01', DATE '1996-12-25', DATE '1997-12-25', DATE '1998-12-25', DATE '2000-12-25', DATE '1996-07-04') GROUP BY 1")
def business_days(t):
    kept = P.business_days(t.panel, t.holidays)
    return kept.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


_LOCF = {
    "locf_days": "SELECT DISTINCT date FROM panel_holey",
    "locf_frame": "SELECT d.date, a.asset FROM locf_days d CROSS JOIN (SELECT DISTINCT asset FROM panel_holey) a",
    "locf_filled": "SELECT f.date, f.asset, last_value(p.value IGNORE NULLS) OVER (PARTITION BY f.asset ORDER BY f.date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS v, p.value IS NOT NULL AS observed "
                   "FROM locf_frame f LEFT JOIN panel_holey p ON p.date = f.date AND p.asset = f.asset",
}


@query("pan15_locf", f"SELECT asset, count(*) AS n, count_if(observed) AS observed, {ten_thousandths('v')} AS total FROM locf_filled WHERE v IS NOT NULL AND date IN "
       "(SELECT date FROM locf_filled GROUP BY 1 HAVING count_if(v IS NULL) <= 1) GROUP BY 1", _LOCF)
def locf(t):
    calendar = t.holey.select("unit_id", "date").distinct()
    filled = P.locf(t.holey, calendar)
    return filled.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("observed").alias("observed"), whole_sum("value").alias("total")
    )


@query("pan16_rename_series", f"SELECT CASE asset WHEN 'A' THEN 'ACCEPTED' WHEN 'R' THEN 'RETURNED' ELSE asset END AS asset, count(*) AS n, {ten_thousandths('value')} AS total FROM panel GROUP BY 1")
def rename_series(t):
    mapping = t.spark.sql("SELECT * FROM VALUES ('A', 'ACCEPTED'), ('R', 'RETURNED') AS m(source_id, asset)")
    return P.rename_series(t.panel, mapping).groupBy("asset").agg(F.count(F.lit(1)).alias("n"), whole_sum("value").alias("total"))


@query("pan17_lag_cut", _summary_sql("(SELECT * FROM unit_panel WHERE date <= asof - INTERVAL 45 DAY)"))
def lag_cut(t):
    return _summary(P.lag_cut(t.unit_panel, t.units, 45))


# a line is a release: its order date is the observation, its ship date the publication
_RELEASES = {
    "releases": "SELECT o_orderpriority AS asset, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(l_shipdate AS DATE) AS release_date, "
                "CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3",
}


@query("pan18_vintage_asof", f"SELECT asset, CAST(date AS VARCHAR) AS date, {rd('arg_max(value, release_date) FILTER (WHERE release_date <= DATE ' + chr(39) + '1998-12-31' + chr(39) + ')', 2)} AS known_value, "
       f"{rd('arg_min(value, release_date)', 2)} AS first_value, count(*) AS n_vintages FROM releases GROUP BY 1, 2", _RELEASES)
def vintage(t):
    lines, orders = t.read("lineitem"), t.read("orders")
    releases = lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy(
        F.lit("lines").alias("unit_id"), F.col("o_orderpriority").alias("asset"),
        F.trunc(F.col("o_orderdate").cast("date"), "month").alias("date"), F.col("l_shipdate").cast("date").alias("release_date"),
    ).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double").alias("value"))
    units = t.spark.sql("SELECT 'lines' AS unit_id, DATE'1998-12-31' AS asof")
    return rounded(P.vintage_asof(releases, units).select("asset", text("date"), "known_value", "first_value", "n_vintages"), 2)


@query("pan19_derived_spread", f"SELECT unit_id, count(*) AS n, {rd('sum(spread)', 3)} AS total, {rd('max(spread)', 6)} AS widest FROM (SELECT a.unit_id, a.value - b.value AS spread FROM cut a JOIN cut b "
       "ON a.unit_id = b.unit_id AND a.date = b.date WHERE a.asset = 'N' AND b.asset = 'A') GROUP BY 1")
def spread(t):
    return P.derived_spread(t.cut, "N", "A").groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("spread"), 3).alias("total"), F.round(F.max("spread"), 6).alias("widest")
    )


CALENDAR = {
    "cal": "SELECT d AS date, CASE WHEN dayofweek(d) BETWEEN 1 AND 5 AND d NOT IN (DATE '1996-01-01', DATE '1997-01-01', DATE '1998-01-01', DATE '1999-01-01', DATE '1996-12-25', "
           "DATE '1997-12-25', DATE '1998-12-25', DATE '2000-12-25', DATE '1996-07-04') THEN 1 ELSE 0 END AS is_open FROM "
           "(SELECT CAST(unnest(generate_series((SELECT CAST(min(date) AS TIMESTAMP) FROM panel), (SELECT CAST(max(date) AS TIMESTAMP) FROM panel), INTERVAL 1 DAY)) AS DATE) AS d)",
    "cal_idx": "SELECT date, is_open, sum(is_open) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS idx FROM cal",
}


@query("pan20_target_dates", "SELECT DISTINCT c.unit_id, c.horizon, CAST(t.date AS VARCHAR) AS target_date FROM cells c JOIN cal_idx b ON b.date = c.asof JOIN cal_idx t ON t.is_open = 1 AND t.idx = b.idx + c.horizon", CALENDAR)
def target_dates(t):
    calendar = P.business_calendar(t.panel.select("date"), t.holidays)
    return P.target_dates(t.units, calendar).select("unit_id", "horizon", text("target_date"))


@query("pan20_panel_steps", f"SELECT unit_id, asset, horizon, CAST(target_date AS VARCHAR) AS target_date, {rd('value')} AS value FROM realized")
def panel_steps(t):
    return rounded(t.realized.select("unit_id", "asset", F.col("horizon").cast("long").alias("horizon"), text("target_date"), "value"))


@query(
    "pan21_realize",
    f"SELECT m.unit_id, m.asset, m.horizon, {rd('m.y')} AS value, CAST(m.date AS VARCHAR) AS target_date FROM (SELECT unit_id, asset, date, row_number() OVER w AS horizon, "
    "CASE WHEN unit_id LIKE 'F2-%' THEN sum(value) OVER w ELSE value END AS y FROM mixed_panel WHERE date > asof WINDOW w AS (PARTITION BY unit_id, asset ORDER BY date)) m "
    "JOIN cells c ON c.unit_id = m.unit_id AND c.asset = m.asset AND c.horizon = m.horizon",
)
def realize(t):
    out = P.realize(t.mixed_panel, t.mixed_units)
    return rounded(out.select("unit_id", "asset", F.col("horizon").cast("long").alias("horizon"), "value", text("target_date")))


_CHANGES = {
    "hch": "SELECT * FROM (SELECT unit_id, asset, date, value - lag(value, 5) OVER w AS change, lag(value, 5) OVER w - lag(value, 10) OVER w AS run_up "
           "FROM cut WINDOW w AS (PARTITION BY unit_id, asset ORDER BY date)) WHERE change IS NOT NULL",
}


@query("pan22_h_change_stats", f"SELECT unit_id, asset, count(*) AS n_changes, {rd('avg(change)', 4)} AS mean_change, {rd('stddev_samp(change)', 4)} AS sd_change, "
       f"{rd('regr_slope(change, run_up)')} AS reversion_slope FROM hch GROUP BY 1, 2", _CHANGES)
def h_change_stats(t):
    s = P.h_change_stats(t.cut, 5)
    return s.select("unit_id", "asset", "n_changes", F.round("mean_change", 4).alias("mean_change"), F.round("sd_change", 4).alias("sd_change"), F.round("reversion_slope", 6).alias("reversion_slope"))


@query(
    "pan23_vol_regime",
    f"SELECT unit_id, asset, {rd('sqrt(sum(power(CAST(0.94 AS DOUBLE), age) * diff * diff) / sum(power(CAST(0.94 AS DOUBLE), age)))', 4)} AS ewma_vol, "
    f"{rd('stddev_samp(diff) FILTER (WHERE age < 21)', 4)} AS window_vol, {rd('stddev_samp(diff)', 4)} AS full_vol FROM "
    "(SELECT *, row_number() OVER (PARTITION BY unit_id, asset ORDER BY date DESC) - 1 AS age FROM diffs) GROUP BY 1, 2",
)
def vol_regime(t):
    return rounded(P.vol_regime(t.cut), 4)


@query(
    "pan24_proxy_anchor",
    f"SELECT b.unit_id, b.n_overlap, {rd('b.alpha', 3)} AS alpha, {rd('b.beta')} AS beta, {rd('b.alpha + b.beta * n.last', 3)} AS implied_level, {rd('abs(b.beta) * s.sd', 3)} AS implied_sd FROM "
    "(SELECT x.unit_id, count(*) AS n_overlap, regr_slope(x.value, y.value) AS beta, regr_intercept(x.value, y.value) AS alpha FROM cut x JOIN cut y ON x.unit_id = y.unit_id AND x.date = y.date "
    "WHERE x.asset = 'R' AND y.asset = 'A' AND x.date < DATE '1997-01-01' GROUP BY 1) b JOIN anchors n ON n.unit_id = b.unit_id AND n.asset = 'A' "
    "JOIN (SELECT unit_id, stddev_samp(diff) AS sd FROM diffs WHERE asset = 'A' GROUP BY 1) s ON s.unit_id = b.unit_id",
)
def proxy_anchor(t):
    p = P.proxy_anchor(t.cut, "R", "A", "1997-01-01")
    return p.select("unit_id", "n_overlap", F.round("alpha", 3).alias("alpha"), F.round("beta", 6).alias("beta"),
                    F.round("implied_level", 3).alias("implied_level"), F.round("implied_sd", 3).alias("implied_sd"))


@query(
    "pan25_implied_move_rank",
    f"SELECT h.unit_id, h.asset, h.horizon, {rd('max(m.move)', 4)} AS move, {rd('avg(CASE WHEN h.change <= m.move THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)')} AS move_rank, count(*) AS n_changes "
    "FROM hchs h JOIN (SELECT d.unit_id, d.asset, d.horizon, avg(d.value) - max(a.last) AS move FROM rw d JOIN anchors a ON a.unit_id = d.unit_id AND a.asset = d.asset GROUP BY 1, 2, 3) m "
    "ON m.unit_id = h.unit_id AND m.asset = h.asset AND m.horizon = h.horizon GROUP BY 1, 2, 3",
    {"hchs": " UNION ALL ".join(f"SELECT unit_id, asset, CAST({h} AS INTEGER) AS horizon, value - lag(value, {h}) OVER (PARTITION BY unit_id, asset ORDER BY date) AS change FROM cut QUALIFY change IS NOT NULL" for h in HORIZONS)},
)
def implied_move_rank(t):
    centre = t.rw.groupBy("unit_id", "asset", "horizon").agg(F.avg("value").alias("c"))
    moves = centre.join(t.anchors, ["unit_id", "asset"]).select("unit_id", "asset", "horizon", (F.col("c") - F.col("last")).alias("move"))
    per_horizon = [P.h_changes(t.cut, h).select("unit_id", "asset", F.lit(h).alias("horizon"), "change") for h in HORIZONS]
    out = P.implied_move_rank(moves, reduce(DataFrame.unionByName, per_horizon))
    return out.withColumn("move", F.round("move", 4)).withColumn("move_rank", F.round("move_rank", 6))


@query(
    "pan26_deoverlap",
    f"SELECT asset, count(*) AS n, CAST(max(episode) AS BIGINT) AS episodes, {ten_thousandths('change')} AS total FROM (SELECT *, sum(flag) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS episode FROM "
    "(SELECT asset, date, change, row_number() OVER w AS rn, CASE WHEN date_diff('day', lag(date) OVER w, date) > 3 THEN 1 ELSE 0 END AS flag FROM och WINDOW w AS (PARTITION BY asset ORDER BY date))) WHERE (rn - 1) % 5 = 0 GROUP BY 1",
    {
        "och": "SELECT * FROM (SELECT asset, date, value - lag(value, 5) OVER (PARTITION BY asset ORDER BY date) AS change FROM panel_holey) WHERE change IS NOT NULL",
    },
)
def deoverlap(t):
    return P.deoverlap(P.h_changes(t.holey, 5), 5, gap=3).groupBy("asset").agg(
        F.count(F.lit(1)).alias("n"), F.max("episode").alias("episodes"), whole_sum("change").alias("total")
    )
