"""Panel preparation: as-of cuts, calendars, gap-aware differences, alignment and moments.

A panel holds one row per (unit, asset, date), so a series is no longer than its calendar; windows
over ``(unit_id, asset)`` therefore sort a bounded group however large the whole table is. No
operator collects a series: everything is a window, a join or a partially aggregated ``groupBy``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fanchart.contract import (
    GAP_FACTOR,
    GAP_FLOOR_DAYS,
    MIN_ALIGNED_ROWS,
    RELATIVE_VOL_FLOOR,
    RETURN_TARGETS,
    VOL_FLOOR,
)
from fanchart.functions.columns import is_finite, iso_date

SERIES = ["unit_id", "asset"]


def _by_date(keys: list[str] = SERIES) -> Window:
    return Window.partitionBy(*keys).orderBy("date")


def normalize_panel(df: DataFrame) -> DataFrame:
    """One spelling for the asset column and a DATE for any date representation."""
    names = [c for c in ("asset", "asset_id") if c in df.columns]
    asset = F.coalesce(*[F.col(c).cast("string") for c in names])
    keep = [c for c in df.columns if c not in ("asset", "asset_id", "date", "value")]
    return df.select(
        *keep,
        iso_date("date").alias("date"),
        asset.alias("asset"),
        F.col("value").cast("double").alias("value"),
    )


def panel_from_wide(df: DataFrame, asset: str) -> DataFrame:
    """A per-asset frame; its value is the first existing column of value, close, return."""
    source = next(c for c in ("value", "close", "return") if c in df.columns)
    return df.select("date", F.lit(asset).alias("asset"), F.col(source).cast("double").alias("value"))


def unpivot_panel(df: DataFrame, ids: list[str], assets: list[str]) -> DataFrame:
    """A many-column wide frame to long form; absent observations are left out."""
    return df.melt(ids, assets, "asset", "value").where(F.col("value").isNotNull())


def grid(units: DataFrame) -> DataFrame:
    """One row per cell, asset-major in declared order."""
    by_asset = units.select(
        "unit_id", "horizons", F.posexplode("asset_ids").alias("a_pos", "asset")
    )
    return by_asset.select(
        "unit_id", "asset", "a_pos", F.size("horizons").alias("n_h"),
        F.posexplode("horizons").alias("h_pos", "horizon"),
    ).select(
        "unit_id", "asset", "a_pos", "horizon", "h_pos",
        (F.col("a_pos") * F.col("n_h") + F.col("h_pos")).alias("cell"),
    )


def asof_cut(panel: DataFrame, units: DataFrame) -> DataFrame:
    """Rows at or before each unit's own as-of."""
    asof = units.select("unit_id", F.col("asof").alias("_asof"))
    return panel.join(asof, "unit_id").where(F.col("date") <= F.col("_asof")).drop("_asof")


def lag_cut(panel: DataFrame, units: DataFrame, lag_days: int = 45) -> DataFrame:
    """Rows already published at the as-of when publication lags by ``lag_days``."""
    asof = units.select("unit_id", F.date_sub("asof", lag_days).alias("_asof"))
    return panel.join(asof, "unit_id").where(F.col("date") <= F.col("_asof")).drop("_asof")


def select_panel(panel: DataFrame) -> DataFrame:
    """Per (unit, asset), the rows of the first panel by name among those already cut at the as-of.

    The first name is a partially aggregated ``min``, joined back: no window over raw rows.
    """
    first = panel.groupBy(*SERIES).agg(F.min("panel_id").alias("panel_id"))
    return panel.join(first, [*SERIES, "panel_id"], "left_semi")


def require_assets(panel: DataFrame, units: DataFrame) -> DataFrame:
    """Target assets with no row at or before the as-of, with every asset the panels do carry.

    The listing is a set of distinct names, de-duplicated before it is gathered.
    """
    wanted = units.select("unit_id", F.explode("asset_ids").alias("asset"))
    absent = wanted.join(asof_cut(panel, units).select(*SERIES).distinct(), SERIES, "left_anti")
    names = panel.select(*SERIES).distinct()
    available = names.groupBy("unit_id").agg(
        F.array_join(F.sort_array(F.collect_set("asset")), ",").alias("available")
    )
    return absent.join(available, "unit_id", "left").select(
        "unit_id", "asset", F.coalesce("available", F.lit("")).alias("available")
    )


def drop_nonfinite(panel: DataFrame) -> DataFrame:
    return panel.where(is_finite("value"))


def anchor(panel: DataFrame) -> DataFrame:
    """Last value of each series of a panel already cut at the as-of."""
    return panel.groupBy(*SERIES).agg(
        F.max_by("value", "date").alias("last"), F.max("date").alias("last_date")
    )


def first_diff(panel: DataFrame) -> DataFrame:
    """Value minus the previous value, with the day step between them."""
    w = _by_date()
    return (
        panel.withColumn("diff", F.col("value") - F.lag("value").over(w))
        .withColumn("step", F.date_diff("date", F.lag("date").over(w)))
        .where(F.col("diff").isNotNull())
    )


def gap_guard(diffs: DataFrame) -> DataFrame:
    """Drop a difference that spans a hole: a step above ``max(10 x median step, 5 days)``.

    A series without any dates has no steps and stays unguarded. The median shares the window's hash partitioning, so it adds no shuffle.
    """
    limit = F.greatest(F.col("_median") * GAP_FACTOR, F.lit(GAP_FLOOR_DAYS))
    return (
        diffs.withColumn("_median", F.median("step").over(Window.partitionBy(*SERIES)))
        .where(F.col("_median").isNull() | (F.col("step") <= limit))
        .drop("_median")
    )


def steps(panel: DataFrame, units: DataFrame) -> DataFrame:
    """Per-step changes: the row itself for return targets, the guarded difference for levels."""
    kind = units.select("unit_id", is_return_target("target_type").alias("is_return"))
    tagged = panel.join(kind, "unit_id")
    returns = tagged.where("is_return").select(
        *SERIES, "date", F.col("value").alias("step_value")
    )
    levels = gap_guard(first_diff(tagged.where("not is_return"))).select(
        *SERIES, "date", F.col("diff").alias("step_value")
    )
    return returns.unionByName(levels)


def is_return_target(c: str) -> Column:
    return F.lower(F.trim(F.col(c))).isin(*RETURN_TARGETS)


def moments(panel: DataFrame, units: DataFrame) -> DataFrame:
    """Start, drift and floored volatility per target asset of a finite, cut panel.

    Return targets start at 0; a series with no history walks from 0 with unit volatility.
    """
    wanted = units.select(
        "unit_id", is_return_target("target_type").alias("is_return"),
        F.explode("asset_ids").alias("asset"),
    )
    stats = steps(panel, units).groupBy(*SERIES).agg(
        F.avg("step_value").alias("mu"), F.stddev_pop("step_value").alias("sd")
    )
    last = anchor(panel).select(*SERIES, "last")
    floor = F.when(F.col("is_return"), F.lit(VOL_FLOOR)).otherwise(
        F.greatest(F.abs("last") * RELATIVE_VOL_FLOOR, F.lit(VOL_FLOOR))
    )
    empty = F.col("last").isNull()
    return (
        wanted.join(last, SERIES, "left")
        .join(stats, SERIES, "left")
        .select(
            *SERIES,
            F.when(empty | F.col("is_return"), F.lit(0.0)).otherwise(F.col("last")).alias("last"),
            F.coalesce("mu", F.lit(0.0)).alias("mu"),
            F.when(empty, F.lit(1.0))
            .otherwise(F.greatest(F.coalesce("sd", F.lit(0.0)), floor))
            .alias("sigma"),
        )
    )


def align(diffs: DataFrame, units: DataFrame, min_rows: int = MIN_ALIGNED_ROWS) -> DataFrame:
    """Keep the dates on which every target asset has a row, adding ``n_rows`` per unit.

    Units with fewer than ``min_rows`` common dates are left out; see :func:`short_history`.
    """
    return aligned_all(diffs, units).where(F.col("n_rows") >= min_rows)


def aligned_all(rows: DataFrame, units: DataFrame) -> DataFrame:
    wanted = units.select(
        "unit_id", F.explode("asset_ids").alias("asset"), F.size("asset_ids").alias("_n_assets")
    )
    # a (unit, date) group has at most one row per asset, a (unit, asset) group one per date
    present = F.count(F.lit(1)).over(Window.partitionBy("unit_id", "date"))
    return (
        rows.join(wanted, SERIES)
        .withColumn("_present", present)
        .where(F.col("_present") == F.col("_n_assets"))
        .withColumn("n_rows", F.count(F.lit(1)).over(Window.partitionBy(*SERIES)))
        .drop("_n_assets", "_present")
    )


def short_history(diffs: DataFrame, units: DataFrame, min_rows: int = MIN_ALIGNED_ROWS) -> DataFrame:
    """Units whose common history is below the floor, with the rows they have."""
    counts = (
        aligned_all(diffs, units).groupBy("unit_id").agg(F.first("n_rows").alias("n_rows"))
    )
    return (
        units.select("unit_id").join(counts, "unit_id", "left")
        .select("unit_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
        .where(F.col("n_rows") < min_rows)
    )


def sample_sd(aligned: DataFrame, value: str = "diff") -> DataFrame:
    return aligned.groupBy(*SERIES).agg(
        F.stddev_samp(value).alias("daily_sd"), F.count(value).alias("n_rows")
    )


def corr_matrix(aligned: DataFrame, value: str = "diff") -> DataFrame:
    """Pearson correlation of every asset pair of a unit; undefined is 0, the diagonal is 1.

    Pairs form on (unit, date) and are folded map-side at once, so what is shuffled is one
    accumulator per asset pair and partition.
    """
    a = aligned.select("unit_id", "date", F.col("asset").alias("asset_a"), F.col(value).alias("_a"))
    b = aligned.select("unit_id", "date", F.col("asset").alias("asset_b"), F.col(value).alias("_b"))
    r = F.try_divide(
        F.covar_pop("_a", "_b"), F.stddev_pop("_a") * F.stddev_pop("_b")
    )
    return (
        a.join(b, ["unit_id", "date"])
        .groupBy("unit_id", "asset_a", "asset_b")
        .agg(r.alias("_r"))
        .select(
            "unit_id", "asset_a", "asset_b",
            F.when(F.col("asset_a") == F.col("asset_b"), F.lit(1.0))
            .otherwise(F.coalesce(F.nanvl("_r", F.lit(0.0)), F.lit(0.0)))
            .alias("corr"),
        )
    )


def business_days(panel: DataFrame, holidays: DataFrame) -> DataFrame:
    """Drop weekends and listed holidays (``holidays.date``)."""
    return panel.where(F.weekday("date") < 5).join(holidays.select("date"), "date", "left_anti")


def locf(panel: DataFrame, calendar: DataFrame, max_days: int = 3, max_missing: int = 1) -> DataFrame:
    """Carry the last value over at most ``max_days`` calendar rows, then drop sparse days.

    The frame of calendar x assets is the union of the calendar and the known asset names per unit.
    A day stays when at most ``max_missing`` series are still missing on it.
    """
    names = panel.select("unit_id", "asset").distinct()
    frame = calendar.join(names, "unit_id")
    w = _by_date().rowsBetween(-max_days, 0)
    filled = frame.join(panel.select(*SERIES, "date", "value"), [*SERIES, "date"], "left").select(
        *SERIES, "date", F.last("value", ignorenulls=True).over(w).alias("filled"),
        F.col("value").isNotNull().alias("observed"),
    )
    missing = filled.groupBy("unit_id", "date").agg(
        F.count_if(F.col("filled").isNull()).alias("_missing")
    )
    return (
        filled.join(missing, ["unit_id", "date"])
        .where((F.col("_missing") <= max_missing) & F.col("filled").isNotNull())
        .select(*SERIES, "date", F.col("filled").alias("value"), "observed")
    )


def rename_series(panel: DataFrame, mapping: DataFrame) -> DataFrame:
    """Source ids to canonical ids through ``mapping(source_id, asset)``; others keep their name."""
    names = mapping.select(F.col("source_id").alias("asset"), F.col("asset").alias("_to"))
    return panel.join(names, "asset", "left").withColumn(
        "asset", F.coalesce("_to", "asset")
    ).drop("_to")


def vintage_asof(releases: DataFrame, units: DataFrame) -> DataFrame:
    """Per (unit, asset, date): the value known at the as-of, and the first one ever published.

    ``releases`` is ``(unit_id, asset, date, release_date, value)``. Both are one-pass aggregates,
    so an observation revised any number of times is folded map-side.
    """
    asof = units.select("unit_id", "asof")
    known = F.col("release_date") <= F.col("asof")
    return (
        releases.join(asof, "unit_id")
        .groupBy(*SERIES, "date")
        .agg(
            F.max_by(F.when(known, F.col("value")), F.when(known, F.col("release_date"))).alias(
                "known_value"
            ),
            F.min_by("value", "release_date").alias("first_value"),
            F.count("value").alias("n_vintages"),
        )
    )


def derived_spread(panel: DataFrame, long_leg: str, short_leg: str) -> DataFrame:
    """Difference of two series on their common dates."""
    leg = lambda a: F.max(F.when(F.col("asset") == a, F.col("value")))
    return (
        panel.where(F.col("asset").isin(long_leg, short_leg))
        .groupBy("unit_id", "date")
        .agg(leg(long_leg).alias("_l"), leg(short_leg).alias("_s"))
        .where(F.col("_l").isNotNull() & F.col("_s").isNotNull())
        .select("unit_id", "date", (F.col("_l") - F.col("_s")).alias("spread"))
    )


def business_calendar(dates: DataFrame, holidays: DataFrame) -> DataFrame:
    """Every day between the first and last of ``dates.date``: ``(date, is_open, idx)``.

    ``idx`` counts business days so far, so a closed day carries the index of the previous open one.
    """
    span = dates.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("date"))
    closed = holidays.select("date", F.lit(True).alias("_h")).distinct()
    is_open = (F.weekday("date") < 5) & F.col("_h").isNull()
    flagged = days.join(closed, "date", "left").select("date", is_open.alias("is_open"))
    # one row per calendar day: this ordering spans a calendar, not data
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return flagged.withColumn("idx", F.sum(F.col("is_open").cast("int")).over(w))


def target_dates(units: DataFrame, calendar: DataFrame) -> DataFrame:
    """As-of plus h business days. An as-of on a closed day counts from the previous open day."""
    cells = units.select("unit_id", F.col("asof").alias("date"), F.explode("horizons").alias("horizon"))
    due = cells.join(calendar.select("date", "idx"), "date").select(
        "unit_id", "horizon", (F.col("idx") + F.col("horizon")).alias("idx")
    )
    opened = calendar.where("is_open").select("idx", F.col("date").alias("target_date"))
    return due.join(opened, "idx").select("unit_id", "horizon", "target_date")


def panel_step_targets(panel: DataFrame, units: DataFrame) -> DataFrame:
    """Targets counted in panel rows: the h-th row after the as-of of each target series."""
    wanted = units.select("unit_id", "asof", F.explode("asset_ids").alias("asset"), "horizons")
    later = (
        panel.join(wanted, SERIES).where(F.col("date") > F.col("asof"))
        .withColumn("horizon", F.row_number().over(_by_date()))
    )
    return later.where(F.array_contains("horizons", F.col("horizon"))).select(
        *SERIES, "horizon", F.col("date").alias("target_date"), "value"
    )


def realize(panel: DataFrame, units: DataFrame) -> DataFrame:
    """Outcome per cell: the value at the target row, or the sum of step returns up to it."""
    wanted = units.select(
        "unit_id", "asof", is_return_target("target_type").alias("is_return"),
        F.explode("asset_ids").alias("asset"), "horizons",
    )
    w = _by_date()
    later = (
        panel.join(wanted, SERIES).where(F.col("date") > F.col("asof"))
        .withColumn("horizon", F.row_number().over(w))
        .withColumn("_sum", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    )
    return later.where(F.array_contains("horizons", F.col("horizon"))).select(
        *SERIES, "horizon",
        F.when(F.col("is_return"), F.col("_sum")).otherwise(F.col("value")).alias("value"),
        F.col("date").alias("target_date"),
    )


def h_changes(panel: DataFrame, h: int) -> DataFrame:
    """Overlapping h-step changes with the preceding h-step run-up."""
    w = _by_date()
    return (
        panel.withColumn("change", F.col("value") - F.lag("value", h).over(w))
        .withColumn("run_up", F.lag("value", h).over(w) - F.lag("value", 2 * h).over(w))
        .where(F.col("change").isNotNull())
    )


def h_change_stats(panel: DataFrame, h: int) -> DataFrame:
    """Spread of h-step changes and their mean-reversion slope on the prior run-up."""
    return h_changes(panel, h).groupBy(*SERIES).agg(
        F.count("change").alias("n_changes"),
        F.avg("change").alias("mean_change"),
        F.stddev_samp("change").alias("sd_change"),
        F.regr_slope("change", "run_up").alias("reversion_slope"),
    )


def recent_rows(panel: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of each series; only as many leave a task before the shuffle."""
    newest = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("date")))
    return panel.withColumn("_age", newest).where(F.col("_age") <= n).drop("_age")


def vol_regime(panel: DataFrame, window: int = 21, decay: float = 0.94) -> DataFrame:
    """EWMA and trailing-window volatility of guarded differences, next to the full history.

    Weights are ``decay ** age`` with age counted back from the last difference; ages whose weight
    underflows a double contribute exactly nothing and are skipped to avoid arithmetic faults.
    """
    age = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("date"))) - 1
    aged = gap_guard(first_diff(panel)).withColumn("age", age)
    weight = F.pow(F.lit(decay), F.col("age"))
    recent = F.when(F.col("age") < window, F.col("diff"))
    return aged.groupBy(*SERIES).agg(
        F.sqrt(F.sum(weight * F.col("diff") * F.col("diff")) / F.sum(weight)).alias("ewma_vol"),
        F.stddev_samp(recent).alias("window_vol"),
        F.stddev_samp("diff").alias("full_vol"),
    )


def proxy_anchor(panel: DataFrame, target: str, proxy: str, before: str) -> DataFrame:
    """Level and spread of an absent target from a related series.

    The regression uses the early window (``date < before``) in which both exist; it is applied to
    the proxy's last value and volatility.
    """
    t = panel.where(F.col("asset") == target).select("unit_id", "date", F.col("value").alias("_t"))
    p = panel.where(F.col("asset") == proxy).select("unit_id", "date", F.col("value").alias("_p"))
    beta = (
        t.join(p, ["unit_id", "date"]).where(F.col("date") < F.to_date(F.lit(before)))
        .groupBy("unit_id").agg(
            F.regr_slope("_t", "_p").alias("beta"),
            F.regr_intercept("_t", "_p").alias("alpha"),
            F.count("_t").alias("n_overlap"),
        )
    )
    side = p.groupBy("unit_id").agg(F.max_by("_p", "date").alias("proxy_last"))
    vol = (
        gap_guard(first_diff(panel.where(F.col("asset") == proxy)))
        .groupBy("unit_id").agg(F.stddev_samp("diff").alias("proxy_sd"))
    )
    return beta.join(side, "unit_id").join(vol, "unit_id").select(
        "unit_id", "n_overlap", "alpha", "beta",
        (F.col("alpha") + F.col("beta") * F.col("proxy_last")).alias("implied_level"),
        (F.abs("beta") * F.col("proxy_sd")).alias("implied_sd"),
    )


def implied_move_rank(moves: DataFrame, changes: DataFrame) -> DataFrame:
    """Share of historical changes at or below the forecast's centre move.

    ``moves`` is ``(unit_id, asset, horizon, move)``, ``changes`` is ``(unit_id, asset, horizon,
    change)``.
    """
    keys = [*SERIES, "horizon"]
    below = (F.col("change") <= F.col("move")).cast("double")
    return changes.join(moves, keys).groupBy(*keys, "move").agg(
        F.avg(below).alias("move_rank"), F.count("change").alias("n_changes")
    )


def deoverlap(changes: DataFrame, h: int, gap: int | None = None) -> DataFrame:
    """Collapse overlapping windows: every h-th change, and the episode each one belongs to.

    A new episode starts when consecutive change dates lie more than ``gap`` days apart.
    """
    w = _by_date()
    flag = F.when(
        F.date_diff("date", F.lag("date").over(w)) > (gap if gap is not None else 2 * h), 1
    ).otherwise(0)
    return (
        changes.withColumn("_rn", F.row_number().over(w))
        .withColumn("_flag", flag)
        .withColumn("episode", F.sum("_flag").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .where((F.col("_rn") - 1) % h == 0)
        .drop("_rn", "_flag")
    )
