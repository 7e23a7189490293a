"""Forecast generators: every one returns draws ``(submission_id?, unit_id, draw, asset, horizon,
value)`` for all units at once.

Draw ids come from ``explode(sequence(...))`` per cell, so generation is embarrassingly parallel;
random numbers are keyed hashes (see :mod:`fanchart.functions.hashing`).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanchart.contract import (
    DEFAULT_DRAWS,
    DRIFT_SD_CLAMP,
    MAX_DRAWS,
    MIN_DRAWS,
    TEXT_BLIND_MODELS,
    VOL_SCALE_RANGE,
)
from fanchart.functions.columns import clamp, is_finite
from fanchart.functions.hashing import normal, uniform
from fanchart.operators import panel as P
from fanchart.sources.materialize import materialized

CELL = ["unit_id", "asset", "horizon"]
DRAW = ["unit_id", "draw", "asset", "horizon", "value"]


def draw_count(units: DataFrame, requested: int | None = None) -> DataFrame:
    """Draws each unit must produce; ``refused`` marks a count above the ceiling."""
    floor = F.greatest(
        F.coalesce("n_draws_min", F.lit(0)), F.lit(DEFAULT_DRAWS), F.lit(MIN_DRAWS)
    )
    n = floor if not requested else F.greatest(F.lit(requested), floor)
    return units.select("unit_id", n.alias("n_draws")).withColumn(
        "refused", F.col("n_draws") > MAX_DRAWS
    )


def _with_draws(cells: DataFrame, n_draws: int) -> DataFrame:
    return cells.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))


def rw_independent(moments: DataFrame, units: DataFrame, n_draws: int, seed: int = 0) -> DataFrame:
    """Random walk with drift, independent per cell: ``last + mu h + sigma sqrt(h) Z``."""
    cells = P.grid(units).join(moments, P.SERIES)
    z = normal("unit_id", "draw", "cell", seed)
    h = F.col("horizon").cast("double")
    value = F.col("last") + F.col("mu") * h + F.col("sigma") * F.sqrt(h) * z
    return _with_draws(cells, n_draws).select("unit_id", "draw", "asset", "horizon", value.alias("value"))


def correlation_factors(aligned: DataFrame, units: DataFrame) -> DataFrame:
    """Per unit: asset order, daily deviations and a row-major factor of the correlation.

    Correlations and deviations are Spark aggregates; only the finished ``d x d`` matrix of a unit,
    bounded by its grid, reaches the vectorised helper that clips eigenvalues and factorises.
    """
    order = units.select("unit_id", F.posexplode("asset_ids").alias("i", "asset"))
    sd = P.sample_sd(aligned).select(*P.SERIES, "daily_sd")
    rows = order.join(sd, P.SERIES)
    left = rows.select("unit_id", "i", F.col("asset").alias("asset_a"), "daily_sd")
    right = order.select("unit_id", F.col("i").alias("j"), F.col("asset").alias("asset_b"))
    entries = (
        P.corr_matrix(aligned).join(left, ["unit_id", "asset_a"]).join(right, ["unit_id", "asset_b"])
    )
    matrix = entries.groupBy("unit_id").agg(
        F.sort_array(F.collect_list(F.struct("i", "j", "corr"))).alias("_m"),
        F.sort_array(F.collect_set(F.struct("i", "asset_a", "daily_sd"))).alias("_a"),
    )
    return matrix.select(
        "unit_id",
        F.col("_a.asset_a").alias("assets"),
        F.col("_a.daily_sd").alias("daily_sd"),
        _factor(F.col("_m.corr")).alias("factor"),
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _factor(matrices: pd.Series) -> pd.Series:
    def one(flat):
        d = int(round(len(flat) ** 0.5))
        w, v = np.linalg.eigh(np.asarray(flat, dtype=float).reshape(d, d))
        return np.linalg.cholesky((v * np.clip(w, 1e-8, None)) @ v.T).ravel()

    return matrices.map(one)


def joint_shocks(factors: DataFrame, units: DataFrame, n_draws: int, seed: int = 0) -> DataFrame:
    """One correlated shock vector per (draw, horizon), in daily units.

    A row holds the normals of one (draw, horizon); each asset takes the dot product with its row of
    the factor. No shuffle: everything a draw needs travels with the unit's factor.
    """
    d = F.size("assets")
    z = F.transform(
        F.sequence(F.lit(0), d - 1), lambda j: normal("unit_id", "draw", "horizon", j, seed)
    )
    vectors = _with_draws(
        factors.join(units.select("unit_id", "horizons"), "unit_id").withColumn(
            "horizon", F.explode("horizons")
        ),
        n_draws,
    ).withColumn("_z", z)
    weights = F.slice("factor", F.col("i") * d + 1, d)
    dot = F.aggregate(
        F.zip_with(weights, "_z", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x
    )
    return vectors.select("*", F.posexplode("assets").alias("i", "asset")).select(
        "unit_id", "draw", "asset", "horizon",
        (dot * F.element_at("daily_sd", F.col("i") + 1)).alias("shock"),
    )


def rw_joint(factors: DataFrame, anchors: DataFrame, units: DataFrame, n_draws: int, seed: int = 0) -> DataFrame:
    """Driftless joint walk: assets are correlated, horizons are drawn independently."""
    shocks = joint_shocks(factors, units, n_draws, seed)
    return shocks.join(anchors.select(*P.SERIES, "last"), P.SERIES).select(
        "unit_id", "draw", "asset", "horizon",
        (F.col("last") + F.col("shock") * F.sqrt(F.col("horizon").cast("double"))).alias("value"),
    )


def model_registry(moments: DataFrame, units: DataFrame, n_draws: int,
                   models: dict[str, int] = TEXT_BLIND_MODELS) -> DataFrame:
    """Every named text-blind adapter with its seed; ``fallback`` says it ran the statistical walk."""
    names = F.explode(
        F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("seed")) for n, s in models.items()])
    )
    cells = P.grid(units).join(moments, P.SERIES).withColumn("model", names)
    z = normal("unit_id", "draw", "cell", F.col("model.seed"))
    h = F.col("horizon").cast("double")
    value = F.col("last") + F.col("mu") * h + F.col("sigma") * F.sqrt(h) * z
    return _with_draws(cells, n_draws).select(
        F.col("model.name").alias("submission_id"), "unit_id", "draw", "asset", "horizon",
        value.alias("value"), F.lit(True).alias("fallback"),
    )


def adjust(draws: DataFrame, adjustments: DataFrame, scale: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Scale each cell's draws about their centre and shift them, within fixed clamps.

    ``adjustments`` is ``(keys.., asset, drift_bp, vol_scale)``; ``scale`` is ``(unit_id, asset,
    last, sd_h)`` with the deviation at the longest horizon. A missing or non-finite adjustment
    leaves the draws alone. Centres are partial averages joined back, not a window over all draws.
    """
    keys = keys or ["unit_id"]
    plan = clamped_adjustments(adjustments, scale, keys)
    cell = [*keys, "asset", "horizon"]
    centre = draws.groupBy(*cell).agg(F.avg("value").alias("_centre"))
    factors = centre.join(plan.select(*keys, "asset", "vol", "shift"), [*keys, "asset"], "left")
    vol, shift = F.coalesce("vol", F.lit(1.0)), F.coalesce("shift", F.lit(0.0))
    moved = F.col("_centre") + (F.col("value") - F.col("_centre")) * vol + shift
    return draws.join(factors, cell).select(*draws.drop("value").columns, moved.alias("value"))


def clamped_adjustments(adjustments: DataFrame, scale: DataFrame, keys: list[str]) -> DataFrame:
    """Volatility factor, shift and note per (keys, asset)."""
    drift = F.col("drift_bp").try_cast("double")
    vol = F.col("vol_scale").try_cast("double")
    readable = (drift.isNotNull() | F.col("drift_bp").isNull()) & (
        vol.isNotNull() | F.col("vol_scale").isNull()
    )
    drift, vol = F.coalesce(drift, F.lit(0.0)), F.coalesce(vol, F.lit(1.0))
    finite = is_finite(drift) & is_finite(vol)
    usable = readable & finite
    drift = F.when(usable, drift).otherwise(0.0)
    vol = F.when(usable, vol).otherwise(1.0)
    want = F.abs("last") * drift / 10_000.0
    ceiling = F.col("sd_h") * DRIFT_SD_CLAMP
    note = (
        F.when(F.abs(want) > ceiling, "drift clamped")
        .when(~readable, "unreadable adjustment dropped")
        .when(~finite, "non-finite adjustment dropped")
        .otherwise("")
    )
    return adjustments.join(scale, ["unit_id", "asset"]).select(
        *keys, "asset",
        drift.alias("drift_bp"),
        clamp(vol, *VOL_SCALE_RANGE).alias("vol"),
        F.when(F.abs(want) > ceiling, F.signum(want) * ceiling).otherwise(want).alias("shift"),
        note.alias("note"),
    )


def _field(name: str) -> Column:
    """A key that is present but null is unreadable, unlike a key that is absent."""
    value = F.element_at("_spec", F.lit(name))
    return F.when(value.isNull() & F.map_contains_key("_spec", name), F.lit("null")).otherwise(value)


def parse_adjustments(replies: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model replies ``(unit_id, reply)`` to adjustments and a per-unit outcome.

    The JSON object is the text between the first and the last brace. Targets may sit under
    ``assets`` or at the top level: the nested form counts when it names any target. A reply that
    matches no target is a skipped run with a reason, never a silent zero.
    """
    text = F.regexp_extract("reply", r"(?s)\{.*\}", 0)
    parsed = replies.join(units.select("unit_id", "asset_ids"), "unit_id").select(
        "unit_id", "asset_ids", text.alias("_json"),
        F.from_json(text, "map<string,string>", {"allowSingleQuotes": "false"}).alias("_top"),
    )
    nested = F.from_json(F.element_at("_top", F.lit("assets")), "map<string,string>")
    names_any = F.coalesce(F.arrays_overlap(F.map_keys("_nested"), "asset_ids"), F.lit(False))
    chosen = parsed.withColumn("_nested", nested).withColumn(
        "_specs", F.when(names_any, F.col("_nested")).otherwise(F.col("_top"))
    )
    spec = F.from_json(F.element_at("_specs", F.col("asset")), "map<string,string>")
    rows = (
        chosen.select("unit_id", "_specs", F.explode("asset_ids").alias("asset"))
        .select("unit_id", "asset", spec.alias("_spec"))
        .where(F.col("_spec").isNotNull())
        .select(
            "unit_id", "asset",
            _field("drift_bp").alias("drift_bp"),
            _field("vol_scale").alias("vol_scale"),
            F.substring(F.coalesce(F.element_at("_spec", F.lit("because")), F.lit("")), 1, 300).alias("because"),
        )
    )
    matched = rows.groupBy("unit_id").agg(F.count("asset").alias("_n"))
    outcome = chosen.join(matched, "unit_id", "left").select(
        "unit_id",
        F.coalesce("_n", F.lit(0)).alias("matched"),
        (F.coalesce("_n", F.lit(0)) > 0).alias("reasoning_applied"),
        F.when(F.col("_json") == "", "reply contained no JSON object")
        .when(F.col("_top").isNull(), "reply JSON did not parse")
        .when(F.col("_n").isNull(), "reply named none of the requested assets")
        .otherwise("").alias("reason"),
    )
    return rows, outcome


def bootstrap_paths(step_rows: DataFrame, anchors: DataFrame, units: DataFrame, n_draws: int,
                    block: int = 5, seed: int = 0) -> DataFrame:
    """Stationary block bootstrap of demeaned steps.

    ``step_rows`` is ``(unit_id, asset, date, step_value)`` on aligned dates. A path restarts at a
    random row with probability ``1 / block``, else it continues with the next row (circularly).
    The start row and age of each step are found from the hashed restart flags with a running
    ``max`` over the path, whose length is the longest horizon. All assets share the rows.
    """
    days = step_rows.select("unit_id", "date").distinct()
    day_idx = days.withColumn(
        "t", F.row_number().over(Window.partitionBy("unit_id").orderBy("date")) - 1
    )
    n = day_idx.groupBy("unit_id").agg(F.count("t").alias("n"))
    centred = (
        step_rows.withColumn(
            "_c", F.col("step_value") - F.avg("step_value").over(Window.partitionBy(*P.SERIES))
        ).join(day_idx, ["unit_id", "date"]).select("unit_id", "asset", "t", "_c")
    )
    path = _with_draws(units.select("unit_id", F.array_max("horizons").alias("max_h")), n_draws).select(
        "unit_id", "draw", F.explode(F.sequence(F.lit(1), F.col("max_h"))).alias("s")
    ).join(n, "unit_id")
    restart = (F.col("s") == 1) | (uniform("unit_id", "draw", "s", seed, 3) < 1.0 / block)
    start = F.floor(uniform("unit_id", "draw", "s", seed, 4) * F.col("n"))
    w = Window.partitionBy("unit_id", "draw").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    placed = path.withColumn(
        "_from", F.max(F.when(restart, F.struct("s", start.alias("t0")))).over(w)
    ).select(
        "unit_id", "draw", "s",
        F.pmod(F.col("_from.t0") + F.col("s") - F.col("_from.s"), F.col("n")).alias("t"),
    )
    walked = placed.join(centred, ["unit_id", "t"])
    cells = P.grid(units).select("unit_id", "asset", "horizon")
    return (
        walked.join(cells, ["unit_id", "asset"]).where(F.col("s") <= F.col("horizon"))
        .groupBy("unit_id", "draw", "asset", "horizon").agg(F.sum("_c").alias("_move"))
        .join(anchors.select(*P.SERIES, "last"), P.SERIES)
        .select("unit_id", "draw", "asset", "horizon", (F.col("last") + F.col("_move")).alias("value"))
    )


def historical_sim(aligned: DataFrame, anchors: DataFrame, units: DataFrame) -> DataFrame:
    """Every past h-change is a draw, the same date across all cells of a unit.

    ``aligned`` holds ``(unit_id, asset, date, value, n_rows)`` on common dates. Draw 0 is the most recent
    date on which the change of the longest horizon exists. No randomness.
    """
    w = Window.partitionBy(*P.SERIES).orderBy("date")
    reach = units.select("unit_id", F.array_max("horizons").alias("max_h"), "horizons")
    rows = (
        aligned.join(reach, "unit_id")
        .withColumn("_rn", F.row_number().over(w))
        .withColumn("draw", (F.col("n_rows") - F.col("_rn")).cast("int"))
    )
    # the h-back value is found by row number, so any number of horizons costs one join
    back = rows.select(*P.SERIES, F.col("_rn").alias("_back"), F.col("value").alias("_was"))
    now = rows.where(F.col("_rn") > F.col("max_h")).select(
        *P.SERIES, "draw", "_rn", "value", F.explode("horizons").alias("horizon")
    ).withColumn("_back", F.col("_rn") - F.col("horizon"))
    return (
        now.join(back, [*P.SERIES, "_back"])
        .join(anchors.select(*P.SERIES, "last"), P.SERIES)
        .select(
            "unit_id", "draw", "asset", "horizon",
            (F.col("last") + (F.col("value") - F.col("_was"))).alias("value"),
        )
    )


def student_t(moments: DataFrame, units: DataFrame, n_draws: int, df: int = 5, seed: int = 0) -> DataFrame:
    """Fat-tailed walk: a normal over the root of a scaled chi-square with ``df`` degrees.

    The shock is rescaled to unit variance so that sigma keeps its meaning (``df > 2``).
    """
    cells = P.grid(units).join(moments, P.SERIES)
    squares: Column = F.lit(0.0)
    for i in range(df):
        z = normal("unit_id", "draw", "cell", seed, 10 + i)
        squares = squares + z * z
    t = normal("unit_id", "draw", "cell", seed) / F.sqrt(squares / float(df))
    unit_t = t * ((df - 2.0) / df) ** 0.5
    h = F.col("horizon").cast("double")
    value = F.col("last") + F.col("mu") * h + F.col("sigma") * F.sqrt(h) * unit_t
    return _with_draws(cells, n_draws).select("unit_id", "draw", "asset", "horizon", value.alias("value"))


def regime_blend(recent: DataFrame, full: DataFrame, weight: float = 0.6, seed: int = 0) -> DataFrame:
    """Whole joint draws from ``recent`` with probability ``weight``, else from ``full``."""
    pick = uniform("unit_id", "draw", seed, 5) < weight
    return recent.where(pick).select(*DRAW).unionByName(full.where(~pick).select(*DRAW))


def scenario_mix(draws: DataFrame, scenarios: DataFrame, seed: int = 0) -> DataFrame:
    """Weighted scenarios shift and scale whole joint draws.

    ``scenarios`` is ``(unit_id, scenario, weight, drift, scale)``. A hashed uniform falls into one
    interval of the cumulative weights; a scenario's scale acts about each cell's centre.
    """
    w = Window.partitionBy("unit_id").orderBy("scenario")
    total = F.sum("weight").over(Window.partitionBy("unit_id"))
    bands = scenarios.select(
        "unit_id", "scenario", "drift", "scale",
        (F.sum("weight").over(w) / total).alias("hi"),
        ((F.sum("weight").over(w) - F.col("weight")) / total).alias("lo"),
    )
    centre = draws.groupBy(*CELL).agg(F.avg("value").alias("_centre"))
    return (
        draws.withColumn("_u", uniform("unit_id", "draw", seed, 6))
        .join(bands, "unit_id").where((F.col("_u") >= F.col("lo")) & (F.col("_u") < F.col("hi")))
        .join(centre, CELL)
        .select(
            "unit_id", "draw", "asset", "horizon", "scenario",
            (F.col("_centre") + (F.col("value") - F.col("_centre")) * F.col("scale") + F.col("drift")).alias("value"),
        )
    )


def continue_paths(moments: DataFrame, units: DataFrame, n_draws: int, seed: int = 0) -> DataFrame:
    """Longer horizon = shorter horizon plus an independent increment.

    Shocks share one normal per (draw, horizon segment, asset); the running sum runs over a unit's
    horizons only, so each window group has as many rows as the grid has horizons.
    """
    w = Window.partitionBy("unit_id", "asset").orderBy("horizon")
    cells = (
        P.grid(units).join(moments, P.SERIES)
        .withColumn("seg", F.col("horizon") - F.coalesce(F.lag("horizon").over(w), F.lit(0)))
    )
    step = F.col("mu") * F.col("seg") + F.col("sigma") * F.sqrt(F.col("seg").cast("double")) * normal(
        "unit_id", "draw", "cell", seed
    )
    path = Window.partitionBy("unit_id", "draw", "asset").orderBy("horizon").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return _with_draws(cells, n_draws).select(
        "unit_id", "draw", "asset", "horizon",
        (F.col("last") + F.sum(step).over(path)).alias("value"),
    )


def validate_draw_shape(draws: DataFrame, units: DataFrame, n_draws: int | Column) -> DataFrame:
    """Axis counts of each unit's draws against its grid.

    Rows fold by their whole key first, so a repeated row cannot stand in for a missing one, and labels outside the
    grid are counted, never gathered.
    """
    cells = draws.groupBy("unit_id", "asset", "horizon", "draw").agg(F.count(F.lit(1)).alias("k")).groupBy("unit_id", "asset", "horizon").agg(
        F.sum("k").alias("n"), F.count(F.lit(1)).alias("distinct"), F.min("draw").alias("lo"), F.max("draw").alias("hi")
    )
    axes = units.select("unit_id", "asset_ids", "horizons")
    inside = F.coalesce(F.array_contains("asset_ids", F.col("asset")) & F.array_contains("horizons", F.col("horizon")), F.lit(False))
    got = cells.join(axes, "unit_id").groupBy("unit_id").agg(
        F.sum("n").alias("n_rows"), F.sum("distinct").alias("distinct"), F.count_if(~inside).alias("outside"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.count_distinct("asset").alias("n_assets"), F.count_distinct("horizon").alias("n_horizons"),
    )
    want = n_draws if isinstance(n_draws, Column) else F.lit(n_draws)
    size = want * F.size("asset_ids") * F.size("horizons")
    ok = (
        (F.col("n_rows") == size) & (F.col("distinct") == size) & (F.col("outside") == 0)
        & (F.col("lo") == 0) & (F.col("hi") == want - 1)
    )
    return units.join(got, "unit_id", "left").select(
        "unit_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        (F.coalesce("hi", F.lit(-1)) + 1).alias("n_draws"),
        F.coalesce("n_assets", F.lit(0)).alias("n_assets"), F.coalesce("n_horizons", F.lit(0)).alias("n_horizons"),
        F.coalesce(ok, F.lit(False)).alias("valid"),
    )


def ablate(draws: DataFrame, adjustments: DataFrame, scale: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The full run next to the same run with an empty corpus, tagged ``variant``."""
    full = adjust(draws, adjustments, scale, keys).withColumn("variant", F.lit("full"))
    empty = adjust(draws, adjustments.where(F.lit(False)), scale, keys).withColumn("variant", F.lit("ablated"))
    return full.unionByName(empty)


#: What became of a unit's run.
RUN_OK, RUN_ERROR, RUN_SHAPE, RUN_NONFINITE, RUN_NO_HISTORY = "ok", "model_error", "shape_invalid", "nonfinite_values", "no_history"
RUNS = "unit_id string, status string, draw int, asset string, horizon int, value double"


def forecaster_runs(panel: DataFrame, units: DataFrame, forecast: Callable, n_draws: int) -> DataFrame:
    """``(unit_id, status, draw, asset, horizon, value)``: the draws of each unit whose model run holds, else one row with
    the reason and no draw.

    ``forecast(history: pandas.DataFrame, unit: dict) -> pandas.DataFrame`` gets one unit's cut panel, which a calendar
    bounds; Spark spreads the units. What it returns is proven in the same pass: the grid's cells times draws 0 to n_draws - 1,
    each once, and finite. A model that raises or returns anything else costs its own unit only.
    """
    facts = units.select(F.col("unit_id").alias("unit"), "asof", "asset_ids", "horizons", "target_type")
    history = P.asof_cut(panel, units).select("unit_id", "asset", "date", "value")

    def one_unit(key, past, unit):
        if unit.empty:
            return pd.DataFrame(columns=["unit_id", "status", *DRAW[1:]])
        spec = unit.iloc[0].to_dict() | {"n_draws": n_draws}
        failed = lambda status: pd.DataFrame({"unit_id": [key[0]], "status": [status], "draw": [None], "asset": [None], "horizon": [None], "value": [None]})
        if past.empty:
            return failed(RUN_NO_HISTORY)
        try:
            out = forecast(past.sort_values(["asset", "date"]), spec)
            out = out[["draw", "asset", "horizon", "value"]].astype({"draw": "int64", "asset": str, "horizon": "int64", "value": float})
        except Exception:  # noqa: BLE001 - whatever a plugged-in model raises is that unit's outcome
            return failed(RUN_ERROR)
        cells = {(str(a), int(h)) for a in spec["asset_ids"] for h in spec["horizons"]}
        whole = len(out) == len(cells) * n_draws and not out.duplicated(["draw", "asset", "horizon"]).any()
        if not whole or set(zip(out["asset"], out["horizon"])) != cells or not out["draw"].between(0, n_draws - 1).all():
            return failed(RUN_SHAPE)
        if not np.isfinite(out["value"]).all():
            return failed(RUN_NONFINITE)
        return out.assign(unit_id=key[0], status=RUN_OK)[["unit_id", "status", *DRAW[1:]]]

    return history.groupBy("unit_id").cogroup(facts.groupBy("unit")).applyInPandas(one_unit, RUNS)


def run_forecaster(panel: DataFrame, units: DataFrame, forecast: Callable, n_draws: int) -> tuple[DataFrame, DataFrame]:
    """Plug in any model: the draws of the units whose runs hold, and ``(unit_id, status, n_rows)`` of all units.

    Runs are written once, so the model is not called again for the second table.
    """
    runs = materialized(forecaster_runs(panel, units, forecast, n_draws), "forecaster-runs")
    outcomes = runs.groupBy("unit_id").agg(F.min("status").alias("status"), F.count("draw").alias("n_rows"))
    return runs.where(F.col("status") == RUN_OK).drop("status"), outcomes
