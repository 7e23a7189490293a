"""Proper scores and calibration statistics over draw tables.

All marginal statistics come from one ranked pass: a single shuffle of the draws on (submission,
unit, asset, horizon), one sort, one aggregate on the same partitioning. No pair of draws is ever
formed except by the energy score, which has no rank form and is blocked.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanchart.contract import (
    CELL_KEYS,
    DEFAULT_JOINT,
    DEFAULT_TAIL_METRIC,
    UNIT_KEYS,
    UNSCORED_REASON,
)
from fanchart.functions.columns import is_finite, pinball
from fanchart.operators.ranking import folded, ranked

REALIZED_KEYS = ["unit_id", "asset", "horizon"]


def with_outcome(draws: DataFrame, realized: DataFrame) -> DataFrame:
    """Attach each cell's outcome ``y``. The sealed target date is never selected."""
    y = realized.select(*REALIZED_KEYS, F.col("value").alias("y"))
    return draws.join(y, REALIZED_KEYS)


def _at_rank(position: Column) -> Column:
    return F.max(F.when((F.col("lo") <= position) & (position <= F.col("hi")), F.col("value")))


def quantile_of(level: float) -> Column:
    """Linearly interpolated quantile as an aggregate over ranked rows."""
    place = F.lit(level) * (F.col("m") - 1)
    low = F.floor(place)
    lower, upper = _at_rank(low + 1), _at_rank(F.least(low + 2, F.col("m")))
    part = F.max(place - low)
    return lower + (upper - lower) * part


def cell_statistics(draws: DataFrame, realized: DataFrame, levels: list[float] | tuple[float, ...],
                    split_above: int | None = None) -> DataFrame:
    """One row per (submission, unit, asset, horizon) with everything the marginal scores need.

    Columns: ``m, y, mean, crps, below`` (share of draws <= y) and ``q`` (array of quantiles in the
    order of ``levels``). The spread term is ``(1/m^2) sum_i (2i - m - 1) x_(i)``. Cells without a bound on their
    size (``split_above``) fold equal values before anything is joined or sorted.
    """
    if split_above is not None:
        draws = folded(draws, CELL_KEYS)
    rows = ranked(with_outcome(draws, realized), CELL_KEYS, carry=["y"], split_above=split_above)
    n, m, x, y = F.col("n"), F.col("m"), F.col("value"), F.col("y")
    near = F.sum(n * F.abs(x - y)) / F.max(m)
    spread = F.sum(n * (F.col("lo") + F.col("hi") - m - 1) * x) / F.max(m) / F.max(m)
    return rows.groupBy(*CELL_KEYS).agg(
        F.max("m").alias("m"),
        F.max("y").alias("y"),
        (F.sum(n * x) / F.max(m)).alias("mean"),
        (near - spread).alias("crps"),
        (F.sum(F.when(x <= y, n).otherwise(0)) / F.max(m)).alias("below"),
        F.array(*[quantile_of(a) for a in levels]).alias("q"),
    )


def crps_marginal(draws: DataFrame, realized: DataFrame, split_above: int | None = None) -> DataFrame:
    """Mean over cells of the sample CRPS, one row per (submission, unit)."""
    return cell_statistics(draws, realized, (), split_above).groupBy(*UNIT_KEYS).agg(
        F.avg("crps").alias("marginal"), F.count("crps").alias("cell_count"), F.max("m").alias("n_draws")
    )


def _by_level(cells: DataFrame, levels: tuple[float, ...] | list[float]) -> DataFrame:
    pairs = F.arrays_zip(F.array(*[F.lit(a) for a in levels]).alias("a"), F.col("q").alias("v"))
    return cells.select(*CELL_KEYS, "y", F.explode(pairs).alias("p")).select(
        *CELL_KEYS, "y", F.col("p.a").alias("level"), F.col("p.v").alias("quantile")
    )


def level_scores(cells: DataFrame, levels: tuple[float, ...] | list[float]) -> DataFrame:
    """Per (submission, unit, level): mean pinball and coverage over cells."""
    return _by_level(cells, levels).groupBy(*UNIT_KEYS, "level").agg(
        F.avg(pinball(F.col("y"), F.col("quantile"), F.col("level"))).alias("pinball"),
        F.avg((F.col("y") <= F.col("quantile")).cast("double")).alias("coverage"),
    )


def tail_pinball(cells: DataFrame, levels: tuple[float, ...] | list[float]) -> DataFrame:
    """Pinball loss: mean over cells, then over levels."""
    return level_scores(cells, levels).groupBy(*UNIT_KEYS).agg(F.avg("pinball").alias("tail"))


def tail_coverage(cells: DataFrame, levels: tuple[float, ...] | list[float]) -> DataFrame:
    """Sum over levels of the distance between coverage and level."""
    return level_scores(cells, levels).groupBy(*UNIT_KEYS).agg(
        F.sum(F.abs(F.col("coverage") - F.col("level"))).alias("tail")
    )


#: Tail metrics by the name a unit asks for; an unknown name is a fault, never a default.
TAIL_METRICS: dict[str, Callable[..., Column]] = {
    "pinball": lambda: F.avg("pinball"),
    "coverage": lambda: F.sum(F.abs(F.col("coverage") - F.col("level"))),
}


def select_tail(cells: DataFrame, units: DataFrame, levels: tuple[float, ...] | list[float]) -> DataFrame:
    """Every registered tail metric in one pass, then each unit's own choice.

    ``levels`` is the union of what units ask for; a unit with its own ``tail_levels`` is scored on
    those alone.
    """
    own = F.col("tail_levels") if "tail_levels" in units.columns else F.lit(None).cast("array<double>")
    wanted = units.select(
        "unit_id", F.coalesce("tail_metric", F.lit(DEFAULT_TAIL_METRIC)).alias("tail_metric"), own.alias("_own")
    )
    asked = F.col("_own").isNull() | F.array_contains("_own", F.col("level"))
    scored = level_scores(cells, levels).join(wanted, "unit_id").where(asked).groupBy(*UNIT_KEYS, "tail_metric").agg(
        *[build().alias(f"_{name}") for name, build in TAIL_METRICS.items()]
    )
    choice = F.coalesce(
        *[F.when(F.col("tail_metric") == n, F.col(f"_{n}")) for n in TAIL_METRICS]
    )
    return scored.select(*UNIT_KEYS, "tail_metric", choice.alias("tail"))


def variogram(draws: DataFrame, realized: DataFrame, p: float = 0.5, pair_weight: float = 2.0,
              max_cells: int | None = None) -> DataFrame:
    """Sum over cell pairs of ``(|y_i - y_j|^p - mean |x_i - x_j|^p)^2``; 0 on one cell.

    Draws must fill their grid exactly once, which the gates guarantee. Cells are numbered within
    their unit; the partner of a cell ``k`` places on is a window ``lead`` inside the draw, so no
    pair becomes a row: each task folds its draws to one running mean per (unit, cell, k). The
    shuffle key holds the draw, so a unit with a third of all rows spreads over all tasks. The
    default ``pair_weight`` counts both orders of a pair. ``max_cells`` is the widest grid; when it
    is not given, one number is fetched from ``realized``.
    """
    order = Window.partitionBy("unit_id").orderBy("asset", "horizon")  # one grid per group
    cells = realized.select(*REALIZED_KEYS, F.col("value").alias("y")).withColumn(
        "cell", F.row_number().over(order) - 1
    )
    if max_cells is None:
        max_cells = (cells.agg(F.max("cell")).first()[0] or 0) + 1
    steps = range(1, max_cells)
    power = (lambda gap: F.sqrt(gap)) if p == 0.5 else (lambda gap: F.pow(gap, F.lit(p)))

    seen = cells.select(
        "unit_id", "cell", *[power(F.abs(F.col("y") - F.lead("y", k).over(order))).alias(f"s{k}") for k in steps]
    )
    in_draw = Window.partitionBy(*UNIT_KEYS, "draw").orderBy("cell")
    rows = draws.join(cells.select(*REALIZED_KEYS, "cell"), REALIZED_KEYS).select(
        *UNIT_KEYS, "draw", "cell", "value"
    )
    partners = rows.select(*UNIT_KEYS, "cell", "value", *[F.lead("value", k).over(in_draw).alias(f"x{k}") for k in steps])
    means = partners.groupBy(*UNIT_KEYS, "cell").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.avg(power(F.abs(F.col("value") - F.col(f"x{k}")))).alias(f"e{k}") for k in steps],
    )
    total = sum(
        (F.coalesce(F.pow(F.col(f"s{k}") - F.col(f"e{k}"), F.lit(2.0)), F.lit(0.0)) for k in steps), F.lit(0.0)
    )
    return means.join(seen, ["unit_id", "cell"]).groupBy(*UNIT_KEYS).agg(
        (F.sum(total) * pair_weight).alias("joint")
    )


@F.pandas_udf(T.DoubleType())
def _block_distance(left: pd.Series, right: pd.Series, d: pd.Series) -> pd.Series:
    """Sum of Euclidean distances between two blocks of row-major vectors."""

    def one(a, b, k):
        x, y = np.asarray(a).reshape(-1, k), np.asarray(b).reshape(-1, k)
        total = 0.0
        for row in range(0, len(x), 256):
            gap = x[row : row + 256, None, :] - y[None, :, :]
            total += float(np.sqrt((gap * gap).sum(axis=2)).sum())
        return total

    return pd.Series([one(a, b, int(k)) for a, b, k in zip(left, right, d, strict=True)])


def energy(draws: DataFrame, realized: DataFrame, block: int = 128) -> DataFrame:
    """Energy score: ``mean |x - y| - 1/2 mean |x_s - x_t|`` with Euclidean distances.

    Quadratic in draws by definition. Draws are packed into blocks and blocks, not draws, are paired: each pair is one
    row, a large unit spreads over many tasks, and each block travels once per block. A block of a unit with m draws
    has ``sqrt(block * m)`` vectors, so that m draws travel sqrt(m / block) times, and a pair's memory grows with
    sqrt(m) only. The draw must be an integer.
    """
    y = with_outcome(draws, realized)
    vectors = y.groupBy(*UNIT_KEYS, "draw").agg(
        F.sort_array(F.collect_list(F.struct("asset", "horizon", "value"))).alias("c"),
        F.sqrt(F.sum(F.pow(F.col("value") - F.col("y"), F.lit(2.0)))).alias("near"),
    ).select(*UNIT_KEYS, "draw", "near", F.col("c.value").alias("x"))
    near = vectors.groupBy(*UNIT_KEYS).agg(F.avg("near").alias("near"), F.count("draw").alias("m"))
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("m") * F.lit(float(block)))))
    blocks = vectors.join(near.select(*UNIT_KEYS, "m"), UNIT_KEYS).groupBy(
        *UNIT_KEYS, F.pmod(F.col("draw"), F.ceil(F.col("m") / size)).alias("blk")
    ).agg(F.flatten(F.collect_list("x")).alias("xs"), F.max(F.size("x")).alias("d"))
    last = blocks.groupBy(*UNIT_KEYS).agg(F.max("blk").alias("last_blk"))
    placed = blocks.join(last, UNIT_KEYS)
    # the pair itself is the join key, so one large unit still spreads over every task
    left = placed.select(
        *UNIT_KEYS, "d", F.col("xs").alias("xs_a"), F.col("blk").alias("blk_a"),
        F.explode(F.sequence("blk", "last_blk")).alias("blk_b"),
    )
    right = placed.select(
        *UNIT_KEYS, F.col("xs").alias("xs_b"), F.col("blk").alias("blk_b"),
        F.explode(F.sequence(F.lit(0).cast("long"), "blk")).alias("blk_a"),
    )
    pairs = left.join(right, [*UNIT_KEYS, "blk_a", "blk_b"])
    times = F.when(F.col("blk_a") == F.col("blk_b"), 1.0).otherwise(2.0)
    spread = (
        pairs.withColumn("s", _block_distance("xs_a", "xs_b", "d"))
        .groupBy(*UNIT_KEYS).agg(F.sum(F.col("s") * times).alias("spread"))
    )
    return near.join(spread, UNIT_KEYS).select(
        *UNIT_KEYS,
        (F.col("near") - F.col("spread") / (2.0 * F.col("m") * F.col("m"))).alias("joint"),
    )


#: Joint metrics by the name a unit asks for.
JOINT_METRICS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "variogram": variogram,
    "energy": energy,
}


def joint_scores(draws: DataFrame, realized: DataFrame, units: DataFrame,
                 names: tuple[str, ...] = ("variogram",)) -> DataFrame:
    """Each unit's own joint metric; ``names`` lists those in use, so unused ones cost nothing. Units of other metrics
    have no row; :func:`metric_faults` names them and stops the run."""
    choice = units.select("unit_id", F.coalesce("joint", F.lit(DEFAULT_JOINT)).alias("_joint"))
    parts = []
    for name in names:
        ids = choice.where(F.col("_joint") == name).select("unit_id")
        parts.append(JOINT_METRICS[name](draws.join(ids, "unit_id", "left_semi"), realized))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def metric_faults(units: DataFrame, levels: tuple[float, ...] | list[float] | None = None,
                  joint: tuple[str, ...] | None = None) -> DataFrame:
    """Units asking for a metric nobody registered, or for one this run does not compute."""
    tail = F.coalesce("tail_metric", F.lit(DEFAULT_TAIL_METRIC))
    name = F.coalesce("joint", F.lit(DEFAULT_JOINT))
    uncomputed = F.lit(False)
    if levels is not None and "tail_levels" in units.columns:
        known = F.array(*[F.lit(float(a)) for a in levels])
        uncomputed = F.coalesce(F.size(F.array_except("tail_levels", known)) > 0, F.lit(False))
    fault = (
        F.when(~tail.isin(*TAIL_METRICS), "unknown tail metric")
        .when(~name.isin(*JOINT_METRICS), "unknown joint metric")
        .when(~name.isin(*(joint or JOINT_METRICS)), "joint metric not computed")
        .when(uncomputed, "tail level not computed")
    )
    return units.select("unit_id", fault.alias("fault")).where(F.col("fault").isNotNull())


def renorm_weights(units: DataFrame) -> DataFrame:
    """Effective weights: the joint weight of a one-cell grid goes to the terms that exist."""
    cells = F.size("asset_ids") * F.size("horizons")
    live = F.col("w_marginal") + F.col("w_tail")
    single = cells == 1
    return units.select(
        "unit_id", cells.alias("cell_count"),
        F.when(single, "single").otherwise("multi").alias("rank_group"),
        F.when(single, F.try_divide("w_marginal", live)).otherwise(F.col("w_marginal")).alias("w_marginal"),
        F.when(single, F.lit(0.0)).otherwise(F.col("w_joint")).alias("w_joint"),
        F.when(single, F.try_divide("w_tail", live)).otherwise(F.col("w_tail")).alias("w_tail"),
    )


def apply_scale(components: DataFrame, scale: DataFrame, weights: DataFrame) -> DataFrame:
    """Divide components by the unit's scale.

    A missing joint scale is 1 when the joint weight is 0; otherwise the unit gets ``fault``.
    """
    s = scale.select(
        "unit_id", F.col("marginal").alias("s_m"), F.col("joint").alias("s_j"), F.col("tail").alias("s_t")
    )
    absent = F.col("s_m").isNull() | (F.col("s_j").isNull() & (F.col("w_joint") != 0.0))
    return (
        components.join(weights, "unit_id").join(s, "unit_id", "left")
        .withColumn("fault", F.when(absent, "no usable scale"))
        .withColumn("n_marginal", F.col("marginal") / F.col("s_m"))
        .withColumn("n_joint", F.col("joint") / F.when(F.col("w_joint") == 0.0, F.coalesce("s_j", F.lit(1.0))).otherwise(F.col("s_j")))
        .withColumn("n_tail", F.col("tail") / F.col("s_t"))
        .drop("s_m", "s_j", "s_t")
    )


def components(draws: DataFrame, realized: DataFrame, units: DataFrame, levels: list[float] | tuple[float, ...],
               joint: tuple[str, ...] = ("variogram",), split_above: int | None = None) -> DataFrame:
    """Raw marginal, joint and tail per (submission, unit)."""
    cells = cell_statistics(draws, realized, levels, split_above)
    marginal = cells.groupBy(*UNIT_KEYS).agg(
        F.avg("crps").alias("marginal"), F.max("m").alias("n_draws")
    )
    tail = select_tail(cells, units, levels)
    return marginal.join(tail, UNIT_KEYS).join(joint_scores(draws, realized, units, joint), UNIT_KEYS)


def composite(comps: DataFrame, units: DataFrame, scale: DataFrame | None = None) -> DataFrame:
    """Weighted sum of components, normalised when a scale is given."""
    weights = renorm_weights(units)
    if scale is None:
        rows = comps.join(weights, "unit_id").select(
            "*", F.lit(None).cast("string").alias("fault"), F.col("marginal").alias("n_marginal"),
            F.col("joint").alias("n_joint"), F.col("tail").alias("n_tail"),
        )
    else:
        rows = apply_scale(comps, scale, weights)
    score = (
        F.col("w_marginal") * F.col("n_marginal")
        + F.col("w_joint") * F.col("n_joint")
        + F.col("w_tail") * F.col("n_tail")
    )
    return rows.withColumn("composite", score).withColumn(
        "fault",
        F.coalesce("fault", F.when(~is_finite("composite"), F.lit("non-finite composite"))),
    )


def score_payload(scored: DataFrame, mode: str, grid_source: str) -> tuple[DataFrame, DataFrame]:
    """Published fields of scored units, and the faults that abort the evaluation."""
    payload = scored.where(F.col("fault").isNull()).select(
        *UNIT_KEYS, F.col("composite").alias("score"), "marginal", "joint", "tail", "composite",
        F.array("w_marginal", "w_joint", "w_tail").alias("weights_effective"),
        "tail_metric", "n_draws", "cell_count", "rank_group",
        F.lit(mode).alias("normalization_mode"), F.lit(grid_source).alias("grid_source"),
    )
    return payload, scored.where(F.col("fault").isNotNull()).select(*UNIT_KEYS, "fault")


def unscored(units: DataFrame, realized: DataFrame, roster: DataFrame) -> DataFrame:
    """Units with no outcome: unscored with a fixed reason off the roster, a fault on it."""
    bare = units.select("unit_id").join(realized.select("unit_id").distinct(), "unit_id", "left_anti")
    on_roster = roster.select("unit_id", F.lit(True).alias("_r"))
    committed = F.coalesce("_r", F.lit(False))
    return bare.join(on_roster, "unit_id", "left").select(
        "unit_id", F.lit(None).cast("double").alias("score"),
        F.when(~committed, F.lit(UNSCORED_REASON)).alias("unscored_reason"),
        committed.alias("fault"),
    )


def make_ref_scale(baseline: DataFrame, realized: DataFrame, units: DataFrame,
                   levels: list[float] | tuple[float, ...], split_above: int | None = None) -> DataFrame:
    """Components of a text-blind baseline as each unit's scale: the baseline then scores 1."""
    return scale_from_components(components(baseline, realized, units, levels, split_above=split_above), units)


def scale_from_components(comps: DataFrame, units: DataFrame) -> DataFrame:
    """The scale of each unit from the baseline's own component rows; no joint on one cell."""
    shape = units.select("unit_id", (F.size("asset_ids") * F.size("horizons")).alias("_cells"))
    return comps.join(shape, "unit_id").select(
        "unit_id", "marginal", F.when(F.col("_cells") > 1, F.col("joint")).alias("joint"), "tail"
    )


def pit(cells: DataFrame) -> DataFrame:
    """Share of draws at or below the outcome, per cell."""
    return cells.select(*CELL_KEYS, F.col("below").alias("pit"))


def pit_histogram(pits: DataFrame, bins: int = 10) -> DataFrame:
    bucket = F.least(F.floor(F.col("pit") * bins) + 1, F.lit(bins))
    return pits.groupBy("submission_id", bucket.cast("int").alias("bin")).agg(
        F.count("pit").alias("n_cells")
    )


def interval_coverage(cells: DataFrame) -> DataFrame:
    """Share of outcomes inside the central 50 % and 90 % intervals.

    ``cells`` must carry the quantiles 0.05, 0.25, 0.75, 0.95 in that order.
    """
    inside = lambda lo, hi: F.avg(
        F.col("y").between(F.col("q")[lo], F.col("q")[hi]).cast("double")
    )
    return cells.groupBy("submission_id").agg(
        F.count("y").alias("n_cells"), inside(1, 2).alias("pit_50"), inside(0, 3).alias("pit_90")
    )


def tail_flag(cells: DataFrame, levels: tuple[float, ...] | list[float], tolerance: float = 0.05) -> DataFrame:
    """Coverage per level over all cells of a submission, flagged outside the tolerance."""
    return _by_level(cells, levels).groupBy("submission_id", "level").agg(
        F.avg((F.col("y") <= F.col("quantile")).cast("double")).alias("coverage")
    ).withColumn("flagged", F.abs(F.col("coverage") - F.col("level")) > tolerance)


def pit_concentration(cells: DataFrame, spread: DataFrame, band: float = 0.1, tight: float = 0.5) -> DataFrame:
    """Screen for centres implausibly tight at the truth.

    Share of cells whose PIT lies within ``band`` of one half while the 90 % interval (quantiles 0
    and 3 of ``q``) is narrower than ``tight`` times what the panel's own change spread implies.
    ``spread`` is ``(unit_id, asset, horizon, sd_change)``.
    """
    width = F.col("q")[3] - F.col("q")[0]
    implied = F.col("sd_change") * 3.289707253902945  # two-sided 90 % width of a normal
    near = F.abs(F.col("below") - 0.5) <= band
    return cells.join(spread, REALIZED_KEYS).groupBy("submission_id").agg(
        F.count("below").alias("n_cells"),
        F.avg(near.cast("double")).alias("share_near_centre"),
        F.avg((near & (width < implied * tight)).cast("double")).alias("share_suspect"),
    )
