"""Forecast generator queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from fanchart.contract import DEFAULT_DRAWS, MIN_DRAWS, TEXT_BLIND_MODELS
from fanchart.operators import generators as FC
from fanchart.operators import panel as P
from fanchart.plans.bindings import HORIZONS, normal_sql, rd, uniform_sql
from fanchart.plans.catalog.common import rounded
from fanchart.plans.registry import query

#: Draws of a query: the contract's default.
N = DEFAULT_DRAWS
#: Rows of each series in the recent window of a blend.
RECENT = 127
DRAW_ROWS = "unit_id, draw, asset, horizon, " + rd("value", 4) + " AS value"


def _draws(df):
    return rounded(df.select("unit_id", F.col("draw").cast("long").alias("draw"), "asset", "horizon", "value"), 4)


def _range(n: int) -> str:
    return f"(SELECT unnest(range({n})) AS draw)"


def _walk_sql(z: str, n: int = N) -> str:
    return (
        f"SELECT unit_id, draw, asset, horizon, last + mu * horizon + sigma * sqrt(CAST(horizon AS DOUBLE)) * z AS value FROM "
        f"(SELECT c.unit_id, c.asset, c.horizon, m.last, m.mu, m.sigma, d.draw, {z} AS z FROM cells c "
        f"JOIN moments m ON c.unit_id = m.unit_id AND c.asset = m.asset CROSS JOIN {_range(n)} d)"
    )


@query("fc1_rw_independent", f"SELECT {DRAW_ROWS} FROM rw")
def rw_independent(t):
    return _draws(t.rw)


_JOINT = {
    "corrs": "SELECT a.unit_id, corr(a.diff, b.diff) FILTER (WHERE a.asset = 'A' AND b.asset = 'N') AS r12, "
             "corr(a.diff, b.diff) FILTER (WHERE a.asset = 'A' AND b.asset = 'R') AS r13, "
             "corr(a.diff, b.diff) FILTER (WHERE a.asset = 'N' AND b.asset = 'R') AS r23 FROM aligned a JOIN aligned b ON a.unit_id = b.unit_id AND a.date = b.date GROUP BY 1",
    "lower": "SELECT *, sqrt(1 - power(r13, 2) - power(l32, 2)) AS l33 FROM (SELECT *, (r23 - r12 * r13) / l22 AS l32 FROM (SELECT *, sqrt(1 - power(r12, 2)) AS l22 FROM corrs))",
    "zs": "SELECT c.unit_id, c.asset, c.horizon, d.draw, " + ", ".join(
        f"{normal_sql('c.unit_id', 'd.draw', 'c.horizon', j, 11)} AS z{j}" for j in range(3)
    ) + f" FROM cells c CROSS JOIN {_range(N)} d",
    "shocks": "SELECT z.unit_id, z.draw, z.asset, z.horizon, s.daily_sd * CASE z.asset WHEN 'A' THEN z0 WHEN 'N' THEN l.r12 * z0 + l.l22 * z1 "
              "ELSE l.r13 * z0 + l.l32 * z1 + l.l33 * z2 END AS shock FROM zs z JOIN sds s ON s.unit_id = z.unit_id AND s.asset = z.asset JOIN lower l ON l.unit_id = z.unit_id",
}


def _factors(t):
    return FC.correlation_factors(t.aligned, t.units)


@query("pan13_joint_shocks", f"SELECT unit_id, draw, asset, horizon, {rd('shock', 4)} AS shock FROM shocks", _JOINT)
def joint_shocks(t):
    s = FC.joint_shocks(_factors(t), t.units, N, 11)
    return rounded(s.select("unit_id", F.col("draw").cast("long").alias("draw"), "asset", "horizon", "shock"), 4)


@query("fc2_rw_joint", f"SELECT s.unit_id, s.draw, s.asset, s.horizon, {rd('a.last + s.shock * sqrt(CAST(s.horizon AS DOUBLE))', 4)} AS value FROM shocks s JOIN anchors a ON a.unit_id = s.unit_id AND a.asset = s.asset", _JOINT)
def rw_joint(t):
    return _draws(FC.rw_joint(_factors(t), t.anchors, t.units, N, 11))


@query(
    "fc3_model_registry",
    f"SELECT submission_id, unit_id, asset, horizon, count(*) AS n, {rd('avg(value)', 3)} AS mean, {rd('stddev_samp(value)', 3)} AS sd, true AS fallback FROM runs GROUP BY 1, 2, 3, 4",
    {
        "models": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {s})" for n, s in TEXT_BLIND_MODELS.items()) + ") AS m(submission_id, seed)",
        "runs": "SELECT submission_id, unit_id, asset, horizon, last + mu * horizon + sigma * sqrt(CAST(horizon AS DOUBLE)) * z AS value FROM (SELECT k.submission_id, c.unit_id, c.asset, c.horizon, m.last, m.mu, m.sigma, "
                f"{normal_sql('c.unit_id', 'd.draw', 'c.cell', 'k.seed')} AS z FROM cells c JOIN moments m ON c.unit_id = m.unit_id AND c.asset = m.asset CROSS JOIN {_range(N)} d CROSS JOIN models k)",
    },
)
def model_registry(t):
    runs = FC.model_registry(t.moments, t.units, N)
    return rounded(runs.groupBy("submission_id", "unit_id", "asset", "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("fallback").alias("fallback")
    ), 3)


@query("fc4_draw_count", "SELECT unit_id, greatest(600, n, 500, 200) AS n_draws, greatest(600, n, 500, 200) > 20000 AS refused FROM (SELECT unit_id, CAST(max(n_rows) * 10 AS BIGINT) AS n FROM aligned GROUP BY 1)")
def draw_count(t):
    floors = t.aligned.groupBy("unit_id").agg((F.max("n_rows") * 10).cast("int").alias("n_draws_min"))
    out = FC.draw_count(t.units.drop("n_draws_min").join(floors, "unit_id"), 600)
    return out.select("unit_id", F.col("n_draws").cast("long").alias("n_draws"), "refused")


@query("fc5_adjust", f"SELECT unit_id, asset, horizon, count(*) AS n, {rd('avg(value)', 4)} AS mean, {rd('stddev_samp(value)', 4)} AS sd, {rd('min(value)', 4)} AS lo FROM adj GROUP BY 1, 2, 3")
def adjust(t):
    return rounded(t.adj.groupBy("unit_id", "asset", "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("lo")
    ), 4)


@query("fc5_clamps", f"SELECT unit_id, asset, {rd('drift_bp')} AS drift_bp, {rd('vol')} AS vol, {rd('shift', 4)} AS shift, note FROM clamped")
def clamps(t):
    c = FC.clamped_adjustments(t.adjustments, t.scale_stats, ["unit_id"])
    return c.select("unit_id", "asset", "drift_bp", "vol", F.round("shift", 4).alias("shift"), "note")


# replies: nested, top level, prose only, foreign names, non-finite numbers
@query(
    "fc6_parse_adjustments",
    "SELECT a.unit_id, a.asset, CASE WHEN month(a.asof) = 9 THEN 'NaN' ELSE CAST(CAST(floor(n.last) AS BIGINT) % 300 AS VARCHAR) END AS drift_bp, '1.5' AS vol_scale FROM unit_assets a "
    "JOIN anchors n ON n.unit_id = a.unit_id AND n.asset = a.asset WHERE a.family IN ('F1', 'F2')",
)
def parse_adjustments(t):
    rows, _ = FC.parse_adjustments(_replies(t), t.units)
    return rows.select("unit_id", "asset", "drift_bp", "vol_scale")


@query(
    "fc6_parse_outcomes",
    "SELECT unit_id, CAST(CASE family WHEN 'F1' THEN 1 WHEN 'F2' THEN 2 ELSE 0 END AS BIGINT) AS matched, family IN ('F1', 'F2') AS reasoning_applied, "
    "CASE family WHEN 'F3' THEN 'reply contained no JSON object' WHEN 'F4' THEN 'reply named none of the requested assets' ELSE '' END AS reason FROM units WHERE unit_id IN (SELECT DISTINCT unit_id FROM cut)",
)
def parse_outcomes(t):
    return FC.parse_adjustments(_replies(t), t.units)[1]


def _replies(t):
    drift = F.when(F.month("asof") == 9, F.lit("NaN")).otherwise((F.floor("last") % 300).cast("string"))
    spec = F.concat(F.lit('"'), "asset", F.lit('": {"drift_bp": '), drift, F.lit(', "vol_scale": 1.5, "because": "stated"}'))
    body = (
        t.anchors.join(t.units.select("unit_id", "asof", "family"), "unit_id")
        .groupBy("unit_id", "family").agg(F.array_join(F.sort_array(F.collect_list(spec)), ", ").alias("b"))
    )
    reply = (
        F.when(F.col("family") == "F1", F.concat(F.lit('Here it is: {"assets": {'), "b", F.lit("}} as asked.")))
        .when(F.col("family") == "F2", F.concat(F.lit("{"), "b", F.lit("}")))
        .when(F.col("family") == "F3", F.lit("The documents say nothing."))
        .otherwise(F.lit('{"assets": {"ZZZ": {"drift_bp": 1}}}'))
    )
    return body.select("unit_id", reply.alias("reply"))


_BOOT = {
    "boot_n": "SELECT unit_id, max(n_rows) AS n FROM aligned GROUP BY 1",
    "boot_c": "SELECT unit_id, asset, diff - avg(diff) OVER (PARTITION BY unit_id, asset) AS c, row_number() OVER (PARTITION BY unit_id, asset ORDER BY date) - 1 AS t FROM aligned",
    "boot_p": f"SELECT p.unit_id, p.draw, p.s, n.n, CASE WHEN p.s = 1 OR {uniform_sql('p.unit_id', 'p.draw', 'p.s', 3, 3)} < CAST(0.2 AS DOUBLE) THEN p.s END AS s0, "
              f"CAST(floor({uniform_sql('p.unit_id', 'p.draw', 'p.s', 3, 4)} * n.n) AS BIGINT) AS t0 FROM "
              f"(SELECT u.unit_id, d.draw, unnest(range(1, list_max(u.horizons) + 1)) AS s FROM units u CROSS JOIN {_range(N)} d) p JOIN boot_n n ON n.unit_id = p.unit_id",
    "boot_t": "SELECT unit_id, draw, s, (last_value(CASE WHEN s0 IS NOT NULL THEN t0 END IGNORE NULLS) OVER w + s - last_value(s0 IGNORE NULLS) OVER w) % n AS t "
              "FROM boot_p WINDOW w AS (PARTITION BY unit_id, draw ORDER BY s ROWS UNBOUNDED PRECEDING)",
}


@query("fc7_bootstrap_paths", f"SELECT c.unit_id, b.draw, c.asset, c.horizon, {rd('max(a.last) + sum(k.c)', 4)} AS value FROM cells c JOIN boot_t b ON b.unit_id = c.unit_id AND b.s <= c.horizon "
       "JOIN boot_c k ON k.unit_id = c.unit_id AND k.asset = c.asset AND k.t = b.t JOIN anchors a ON a.unit_id = c.unit_id AND a.asset = c.asset GROUP BY c.unit_id, b.draw, c.asset, c.horizon", _BOOT)
def bootstrap_paths(t):
    steps = t.aligned.select("unit_id", "asset", "date", F.col("diff").alias("step_value"))
    return _draws(FC.bootstrap_paths(steps, t.anchors, t.units, N, block=5, seed=3))


@query("fc8_historical_sim", f"SELECT unit_id, asset, horizon, count(*) AS n, max(draw) AS last_draw, {rd('sum(value)', 1)} AS total, {rd('arg_max(value, draw)', 4)} AS oldest FROM hist GROUP BY 1, 2, 3")
def historical_sim(t):
    return t.hist.groupBy("unit_id", "asset", "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.max("draw").cast("long").alias("last_draw"),
        F.round(F.sum("value"), 1).alias("total"), F.round(F.max_by("value", "draw"), 4).alias("oldest"),
    )


_SQUARES = " + ".join(f"power({normal_sql('c.unit_id', 'd.draw', 'c.cell', 5, 10 + i)}, 2)" for i in range(5))


@query("fc9_student_t", f"SELECT {DRAW_ROWS} FROM (" + _walk_sql(f"{normal_sql('c.unit_id', 'd.draw', 'c.cell', 5)} / sqrt(({_SQUARES}) / 5) * sqrt(CAST(0.6 AS DOUBLE))") + ")")
def student_t(t):
    return _draws(FC.student_t(t.moments, t.units, N, 5, 5))


@query(
    "fc10_regime_blend",
    f"SELECT {DRAW_ROWS} FROM recent WHERE {uniform_sql('unit_id', 'draw', 2, 5)} < CAST(0.6 AS DOUBLE) UNION ALL SELECT {DRAW_ROWS} FROM full_window WHERE NOT {uniform_sql('unit_id', 'draw', 2, 5)} < CAST(0.6 AS DOUBLE)",
    {
        "late_cut": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, asset ORDER BY date DESC) AS age FROM cut) WHERE age <= {RECENT}",
        "late_raw": "SELECT * FROM (SELECT unit_id, asset, value - lag(value) OVER w AS diff, date_diff('day', lag(date) OVER w, date) AS step FROM late_cut WINDOW w AS (PARTITION BY unit_id, asset ORDER BY date)) WHERE diff IS NOT NULL",
        "late_steps": "SELECT d.* FROM late_raw d JOIN (SELECT unit_id, asset, greatest(10 * quantile_cont(step, 0.5), 5) AS lim FROM late_raw GROUP BY 1, 2) g ON d.unit_id = g.unit_id AND d.asset = g.asset WHERE d.step <= g.lim",
        "late_moments": "SELECT a.unit_id, a.asset, a.last, s.mu, greatest(s.sigma, abs(a.last) * CAST(0.0001 AS DOUBLE), CAST(0.000001 AS DOUBLE)) AS sigma FROM anchors a JOIN "
                        "(SELECT unit_id, asset, avg(diff) AS mu, stddev_pop(diff) AS sigma FROM late_steps GROUP BY 1, 2) s ON s.unit_id = a.unit_id AND s.asset = a.asset",
        "recent": _walk_sql(normal_sql("c.unit_id", "d.draw", "c.cell", 21)).replace("JOIN moments m", "JOIN late_moments m"),
        "full_window": _walk_sql(normal_sql("c.unit_id", "d.draw", "c.cell", 22)),
    },
)
def regime_blend(t):
    late = P.moments(P.recent_rows(t.cut, RECENT), t.units)
    return _draws(FC.regime_blend(FC.rw_independent(late, t.units, N, 21), FC.rw_independent(t.moments, t.units, N, 22), 0.6, 2))


@query(
    "fc11_scenario_mix",
    "SELECT r.unit_id, r.draw, r.asset, r.horizon, s.scenario, " + rd("m.centre + (r.value - m.centre) * s.scale + s.drift", 4) + " AS value FROM "
    f"(SELECT *, {uniform_sql('unit_id', 'draw', 4, 6)} AS u FROM rw) r JOIN bands s ON r.u >= s.lo AND r.u < s.hi "
    "JOIN (SELECT unit_id, asset, horizon, avg(value) AS centre FROM rw GROUP BY 1, 2, 3) m ON m.unit_id = r.unit_id AND m.asset = r.asset AND m.horizon = r.horizon",
    {"bands": "SELECT * FROM (VALUES ('base', CAST(0 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)), ('cut', CAST(0.5 AS DOUBLE), CAST(0.75 AS DOUBLE), CAST(500 AS DOUBLE), CAST(1.5 AS DOUBLE)), "
              "('hold', CAST(0.75 AS DOUBLE), CAST(1 AS DOUBLE), CAST(-800 AS DOUBLE), CAST(0.75 AS DOUBLE))) AS b(scenario, lo, hi, drift, scale)"},
)
def scenario_mix(t):
    cases = F.explode(F.array(*[
        F.struct(F.lit(n).alias("scenario"), F.lit(w).alias("weight"), F.lit(d).alias("drift"), F.lit(s).alias("scale"))
        for n, w, d, s in (("base", 0.5, 0.0, 1.0), ("cut", 0.25, 500.0, 1.5), ("hold", 0.25, -800.0, 0.75))
    ]))
    scenarios = t.units.select("unit_id", cases.alias("c")).select("unit_id", "c.*")
    out = FC.scenario_mix(t.rw.drop("submission_id"), scenarios, 4)
    return rounded(out.select("unit_id", F.col("draw").cast("long").alias("draw"), "asset", "horizon", "scenario", "value"), 4)


@query(
    "fc12_continue_paths",
    f"SELECT unit_id, draw, asset, horizon, {rd('last + sum(step) OVER (PARTITION BY unit_id, draw, asset ORDER BY horizon ROWS UNBOUNDED PRECEDING)', 4)} AS value FROM "
    f"(SELECT c.unit_id, d.draw, c.asset, c.horizon, c.last, c.mu * c.seg + c.sigma * sqrt(CAST(c.seg AS DOUBLE)) * {normal_sql('c.unit_id', 'd.draw', 'c.cell', 8)} AS step FROM "
    "(SELECT e.unit_id, e.asset, e.horizon, e.cell, m.last, m.mu, m.sigma, e.horizon - coalesce(lag(e.horizon) OVER (PARTITION BY e.unit_id, e.asset ORDER BY e.horizon), 0) AS seg "
    f"FROM cells e JOIN moments m ON m.unit_id = e.unit_id AND m.asset = e.asset) c CROSS JOIN {_range(N)} d)",
)
def continue_paths(t):
    return _draws(FC.continue_paths(t.moments, t.units, N, 8))


@query(
    "fc13_validate_draw_shape",
    "SELECT u.unit_id, h.n_rows, h.n_draws, h.n_assets, h.n_horizons, h.n_rows = 200 * len(u.asset_ids) * len(u.horizons) AND h.n_draws = 200 AS valid FROM units u JOIN "
    "(SELECT unit_id, count(*) AS n_rows, max(draw) + 1 AS n_draws, count(DISTINCT asset) AS n_assets, count(DISTINCT horizon) AS n_horizons FROM mix GROUP BY 1) h ON h.unit_id = u.unit_id",
    {"mix": "SELECT unit_id, draw, asset, horizon, value FROM hist WHERE unit_id LIKE 'F1-%' OR unit_id LIKE 'F3-%' UNION ALL SELECT unit_id, draw, asset, horizon, value FROM rw WHERE unit_id LIKE 'F2-%' OR unit_id LIKE 'F4-%'"},
)
def validate_draw_shape(t):
    mixed = t.hist.where("unit_id LIKE 'F1-%' OR unit_id LIKE 'F3-%'").unionByName(t.rw.where("unit_id LIKE 'F2-%' OR unit_id LIKE 'F4-%'"))
    shape = FC.validate_draw_shape(mixed, t.units, 200)
    present = mixed.select("unit_id").distinct()
    return shape.join(present, "unit_id", "left_semi").select(
        "unit_id", "n_rows", *[F.col(c).cast("long").alias(c) for c in ("n_draws", "n_assets", "n_horizons")], "valid"
    )


@query("fc14_ablate", f"SELECT unit_id, asset, horizon, 'full' AS variant, count(*) AS n, {rd('avg(value)', 3)} AS mean, {rd('stddev_samp(value)', 3)} AS sd FROM adj GROUP BY 1, 2, 3 UNION ALL "
       f"SELECT unit_id, asset, horizon, 'ablated', count(*), {rd('avg(value)', 3)}, {rd('stddev_samp(value)', 3)} FROM hist GROUP BY 1, 2, 3")
def ablate(t):
    both = FC.ablate(t.hist.drop("submission_id"), t.adjustments, t.scale_stats)
    return rounded(both.groupBy("unit_id", "asset", "horizon", "variant").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")
    ), 3)


def recent_changes(history: pd.DataFrame, unit: dict) -> pd.DataFrame:
    """A sample plugged-in model: the most recent h-step changes of each series are its draws."""
    out = []
    for asset in unit["asset_ids"]:
        values = history.loc[history["asset"] == asset, "value"].to_numpy()
        for h in unit["horizons"]:
            moves = (values[h:] - values[:-h])[::-1][: unit["n_draws"]]
            out.append(pd.DataFrame({"draw": range(len(moves)), "asset": asset, "horizon": int(h), "value": values[-1] + moves}))
    return pd.concat(out)


@query(
    "udf1_forecaster_hook",
    f"SELECT unit_id, draw, asset, horizon, {rd('value')} AS value FROM moved WHERE unit_id IN (SELECT m.unit_id FROM moved m JOIN (SELECT unit_id, count(*) AS k FROM cells GROUP BY 1) c ON c.unit_id = m.unit_id GROUP BY m.unit_id HAVING count(*) = 200 * max(c.k))",
    {"recent": "SELECT * FROM (SELECT unit_id, asset, value, row_number() OVER (PARTITION BY unit_id, asset ORDER BY date DESC) - 1 AS draw, "
               + ", ".join(f"lag(value, {h}) OVER (PARTITION BY unit_id, asset ORDER BY date) AS before_{h}" for h in HORIZONS) + " FROM cut) WHERE draw < 200",
     "moved": "SELECT * FROM (SELECT s.unit_id, s.draw, s.asset, c.horizon, a.last + (s.value - CASE c.horizon " + " ".join(f"WHEN {h} THEN s.before_{h}" for h in HORIZONS) + " END) AS value FROM recent s "
              "JOIN cells c ON c.unit_id = s.unit_id AND c.asset = s.asset JOIN anchors a ON a.unit_id = s.unit_id AND a.asset = s.asset) WHERE value IS NOT NULL"},
)
def forecaster_hook(t):
    draws, _ = FC.run_forecaster(t.unit_panel, t.units, recent_changes, MIN_DRAWS)
    return rounded(draws.withColumn("draw", F.col("draw").cast("long")))


def erring_model(history: pd.DataFrame, unit: dict) -> pd.DataFrame:
    """A plugged-in model that fails in one way per quarter."""
    month = unit["asof"].month
    if month == 3:
        raise RuntimeError("no model")
    cells = [(a, int(h)) for a in unit["asset_ids"] for h in unit["horizons"]]
    last = history.groupby("asset")["value"].last()
    rows = [(d, a, h, last[a] + d * h) for d in range(unit["n_draws"] - (month == 6)) for a, h in cells]
    out = pd.DataFrame(rows, columns=["draw", "asset", "horizon", "value"])
    return out.assign(value=out["value"].where(out.index != 5)) if month == 9 else out


@query(
    "udf1_forecaster_outcomes",
    "SELECT u.unit_id, CASE month(u.asof) WHEN 3 THEN 'model_error' WHEN 6 THEN 'shape_invalid' WHEN 9 THEN 'nonfinite_values' ELSE 'ok' END AS status, CASE WHEN month(u.asof) = 12 THEN 200 * count(*) ELSE 0 END AS n_rows "
    "FROM units u JOIN cells c ON c.unit_id = u.unit_id WHERE u.unit_id IN (SELECT unit_id FROM cut) GROUP BY u.unit_id, u.asof",
)
def forecaster_outcomes(t):
    """A model that raises, falls short or returns NaN costs its own units only."""
    return FC.run_forecaster(t.unit_panel, t.units, erring_model, MIN_DRAWS)[1]
