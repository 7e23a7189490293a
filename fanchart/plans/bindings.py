"""Engine tables derived from the driver tables, and the same definitions as SQL.

Every table below is computed by Spark from whole driver tables. ``CTES`` states the same content in
plain SQL for the result checks; :func:`with_ctes` puts the ones a query needs in front of it.
"""

from __future__ import annotations

import math
import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fanchart.contract import DEFAULT_TAIL_LEVELS
from fanchart.operators import generators as FC
from fanchart.operators import metrics as M
from fanchart.operators import panel as P
from fanchart.sources.materialize import materialized

LEVELS = DEFAULT_TAIL_LEVELS
LINE_LEVELS = (0.01, 0.05, 0.25, 0.75, 0.95, 0.99)
BASE_DRAWS = 200
BASE_SEED = 7
# a line-item cell has no contract bound on its size, so ranking checks it
LINE_SPLIT = 2_000_000

FAMILIES = {
    # family: assets, horizons, tail metric
    "F1": (["A"], [5], "pinball"),
    "F2": (["A", "N"], [5], "coverage"),
    "F3": (["A", "N", "R"], [5], "pinball"),
    "F4": (["A", "N", "R"], [5, 21], "pinball"),
}
#: Every horizon of the families.
HORIZONS = tuple(sorted({h for _, horizons, _ in FAMILIES.values() for h in horizons}))


def _array(values: list, quote: bool) -> str:
    return "array(" + ", ".join(f"'{v}'" if quote else str(v) for v in values) + ")"


class Tables:
    """Lazy engine tables over one directory of driver tables."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf}/{name}.parquet")

    # ---- panels ------------------------------------------------------------------------------

    def _daily(self, df: DataFrame, stamp: str, asset: str, value: str, name: str) -> DataFrame:
        # integer cents make the mean the same double whatever the order of summation
        cents = F.sum(F.round(F.col(value) * 100).cast("long"))
        return df.groupBy(F.col(stamp).cast("date").alias("date"), F.col(asset).alias("asset")).agg(
            (cents.cast("double") / (F.count(F.lit(1)) * 100).cast("double")).alias("value")
        ).withColumn("panel_id", F.lit(name))

    @cached_property
    def panel(self) -> DataFrame:
        """Written once, as panels arrive as files."""
        daily = self._daily(self.read("lineitem"), "l_shipdate", "l_returnflag", "l_extendedprice", "ship_daily")
        return materialized(daily, "panel")

    @cached_property
    def panel_holey(self) -> DataFrame:
        return self._daily(self.read("orders"), "o_orderdate", "o_orderpriority", "o_totalprice", "order_daily")

    @cached_property
    def panel_small(self) -> DataFrame:
        return self._daily(self.read("events"), "ts", "event_type", "value", "event_daily")

    @cached_property
    def returns(self) -> DataFrame:
        w = Window.partitionBy("asset").orderBy("date")
        step = F.log(F.col("value") / F.lag("value").over(w))
        return self.panel.withColumn("value", step).where(F.col("value").isNotNull()).withColumn(
            "panel_id", F.lit("ship_returns")
        )

    # ---- units -------------------------------------------------------------------------------

    @cached_property
    def units(self) -> DataFrame:
        rows = ", ".join(
            f"('{f}', {_array(a, True)}, {_array(h, False)}, '{t}')" for f, (a, h, t) in FAMILIES.items()
        )
        families = self.spark.sql(f"SELECT * FROM VALUES {rows} AS t(family, asset_ids, horizons, tail_metric)")
        quarter = F.explode(F.expr("sequence(DATE'1996-03-01', DATE'2001-06-01', INTERVAL 3 MONTH)"))
        return families.withColumn("q", quarter).withColumn("asof", F.last_day("q")).select(
            F.concat_ws("-", "family", F.col("asof").cast("string")).alias("unit_id"), "family", "asof",
            "asset_ids", "horizons", F.lit("level").alias("target_type"), "tail_metric",
            F.lit("variogram").alias("joint"), F.lit(0).alias("n_draws_min"),
            F.lit(0.5).alias("w_marginal"), F.lit(0.3).alias("w_joint"), F.lit(0.2).alias("w_tail"),
        )

    @cached_property
    def mixed_units(self) -> DataFrame:
        kind = F.when(F.col("family") == "F2", "log_return").otherwise("level")
        return self.units.withColumn("target_type", kind)

    def per_unit(self, panel: DataFrame, units: DataFrame | None = None) -> DataFrame:
        wanted = (self.units if units is None else units).select("unit_id", F.explode("asset_ids").alias("asset"))
        return wanted.join(panel, "asset").select("unit_id", "panel_id", "date", "asset", "value")

    @cached_property
    def unit_panel(self) -> DataFrame:
        return self.per_unit(self.panel)

    @cached_property
    def mixed_panel(self) -> DataFrame:
        levels = self.per_unit(self.panel, self.units.where("family <> 'F2'"))
        return levels.unionByName(self.per_unit(self.returns, self.units.where("family = 'F2'")))

    @cached_property
    def cut(self) -> DataFrame:
        return P.asof_cut(self.unit_panel, self.units)

    @cached_property
    def mixed_cut(self) -> DataFrame:
        return P.asof_cut(self.mixed_panel, self.mixed_units)

    @cached_property
    def transfer(self) -> DataFrame:
        """F2 units whose first asset lost three years but for the as-of row."""
        units = self.units.where("family = 'F2'").select("unit_id", F.col("asof").alias("_asof"))
        hole = (F.col("asset") == "A") & F.col("date").between("1997-01-01", "1999-12-31")
        anchors = P.anchor(self.cut.where("asset = 'A'")).select("unit_id", F.col("last_date").alias("_last"))
        return (
            self.cut.join(units, "unit_id").join(anchors, "unit_id")
            .where(~hole | (F.col("date") == F.col("_last"))).drop("_asof", "_last")
        )

    @cached_property
    def diffs(self) -> DataFrame:
        return P.gap_guard(P.first_diff(self.cut))

    @cached_property
    def aligned(self) -> DataFrame:
        return P.align(self.diffs, self.units)

    @cached_property
    def anchors(self) -> DataFrame:
        return P.anchor(self.cut)

    @cached_property
    def moments(self) -> DataFrame:
        return P.moments(self.cut, self.units)

    @cached_property
    def scale_stats(self) -> DataFrame:
        reach = self.units.select("unit_id", F.sqrt(F.array_max("horizons").cast("double")).alias("_r"))
        return (
            P.sample_sd(self.aligned).join(self.anchors, P.SERIES).join(reach, "unit_id")
            .select(*P.SERIES, "last", (F.col("daily_sd") * F.col("_r")).alias("sd_h"))
        )

    @cached_property
    def holey_units(self) -> DataFrame:
        return self.spark.sql(
            "SELECT 'orders' AS unit_id, DATE'2001-06-30' AS asof, "
            "array('1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW') AS asset_ids, "
            "array(5, 21) AS horizons, 'level' AS target_type"
        )

    @cached_property
    def holey(self) -> DataFrame:
        return self.panel_holey.withColumn("unit_id", F.lit("orders"))

    @cached_property
    def holidays(self) -> DataFrame:
        return self.spark.sql(
            "SELECT explode(array(DATE'1996-01-01', DATE'1997-01-01', DATE'1998-01-01', DATE'1999-01-01', "
            "DATE'1996-12-25', DATE'1997-12-25', DATE'1998-12-25', DATE'2000-12-25', DATE'1996-07-04')) AS date"
        )

    # ---- forecasts and outcomes --------------------------------------------------------------

    @cached_property
    def hist(self) -> DataFrame:
        draws = FC.historical_sim(P.aligned_all(self.cut, self.units), self.anchors, self.units)
        return materialized(draws.select(F.lit("hist").alias("submission_id"), *FC.DRAW), "hist")

    @cached_property
    def adjustments(self) -> DataFrame:
        a = self.units.select("unit_id", F.explode("asset_ids").alias("asset"))
        return a.select(
            "unit_id", "asset",
            F.when(F.col("asset") == "A", 50.0).when(F.col("asset") == "N", -120.0).otherwise(1e9).alias("drift_bp"),
            F.when(F.col("asset") == "A", 1.25).when(F.col("asset") == "N", 3.0).otherwise(0.1).alias("vol_scale"),
        )

    @cached_property
    def adj(self) -> DataFrame:
        moved = FC.adjust(self.hist.drop("submission_id"), self.adjustments, self.scale_stats)
        return moved.select(F.lit("adj").alias("submission_id"), *FC.DRAW)

    @cached_property
    def rw(self) -> DataFrame:
        draws = FC.rw_independent(self.moments, self.units, BASE_DRAWS, BASE_SEED)
        return draws.select(F.lit("rw").alias("submission_id"), *FC.DRAW)

    @cached_property
    def draws(self) -> DataFrame:
        """Three submissions, written once as any submitted draws are."""
        return materialized(self.hist.unionByName(self.adj).unionByName(self.rw), "draws")

    @cached_property
    def realized(self) -> DataFrame:
        return materialized(P.panel_step_targets(self.unit_panel, self.units), "realized")

    @cached_property
    def scale(self) -> DataFrame:
        return M.make_ref_scale(self.rw, self.realized, self.units, LEVELS)

    @cached_property
    def comps(self) -> DataFrame:
        """Components of all three submissions; the scale and the scores both read them."""
        return materialized(M.components(self.draws, self.realized, self.units, LEVELS), "components")

    @cached_property
    def scored(self) -> DataFrame:
        baseline = self.comps.where("submission_id = 'rw'")
        return M.composite(self.comps, self.units, M.scale_from_components(baseline, self.units))

    @cached_property
    def results(self) -> DataFrame:
        """Scored rows; the second submission fails every unit of the year-end as-ofs."""
        failed = (F.col("submission_id") == "adj") & (F.month("asof") == 12)
        rows = self.scored.join(self.units.select("unit_id", "asof", "family"), "unit_id")
        return rows.select(
            "submission_id", "unit_id", "family", "rank_group", "marginal", "joint", "tail", "asof",
            F.when(failed, "failure").otherwise("success").alias("state"),
            F.when(~failed, F.col("composite")).alias("score"),
        )

    # ---- line items as forecasts: every line is one joint draw for the next quarter ------------

    @cached_property
    def line_draws(self) -> DataFrame:
        line = self.read("lineitem")
        cell = lambda name, c: F.struct(F.lit(name).alias("asset"), c.alias("value"))
        cells = F.array(
            cell("discount", F.col("l_discount")), cell("price", F.col("l_extendedprice") / 1000.0),
            cell("quantity", F.col("l_quantity")), cell("tax", F.col("l_tax")),
        )
        return line.select(
            F.concat(F.lit("flag-"), "l_returnflag").alias("submission_id"),
            self._quarter("l_shipdate").alias("unit_id"),
            F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("draw"),
            F.explode(cells).alias("c"),
        ).select("submission_id", "unit_id", "draw", "c.asset", F.lit(1).alias("horizon"), "c.value")

    @staticmethod
    def _quarter(c: str):
        d = F.col(c).cast("date")
        return F.concat(F.year(d), F.lit("Q"), F.quarter(d))

    @cached_property
    def line_realized(self) -> DataFrame:
        def mean(c: str, unit: float):
            total = F.sum(F.round(F.col(c) * 100).cast("long")).cast("double")
            return total / (F.count(F.lit(1)) * 100).cast("double") / unit

        before = F.add_months(F.trunc(F.col("l_shipdate").cast("date"), "quarter"), -3)
        wide = self.read("lineitem").groupBy(before.alias("d")).agg(
            mean("l_discount", 1.0).alias("discount"), mean("l_extendedprice", 1000.0).alias("price"),
            mean("l_quantity", 1.0).alias("quantity"), mean("l_tax", 1.0).alias("tax"),
        )
        long = wide.select(
            self._quarter("d").alias("unit_id"), "discount", "price", "quantity", "tax"
        ).melt(["unit_id"], ["discount", "price", "quantity", "tax"], "asset", "value")
        return materialized(long.withColumn("horizon", F.lit(1)), "line-realized")

    # ---- corpus ------------------------------------------------------------------------------

    @cached_property
    def doc_units(self) -> DataFrame:
        sources = self.read("documents").select(F.col("source").alias("unit_id")).distinct()
        return sources.withColumn("asof", F.to_date(F.lit("2000-02-09")))

    @cached_property
    def docs(self) -> DataFrame:
        d = self.read("documents")
        return d.select(
            F.col("source").alias("unit_id"), F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("path"), "text"
        )

    @cached_property
    def index(self) -> DataFrame:
        """The dated index: some entries lack a date, some files lack an entry."""
        d = self.read("documents")
        i = F.col("doc_id")
        stamp = F.date_add(F.to_date(F.lit("1996-01-01")), (i % 2000).cast("int")).cast("string")
        return d.where(i % 23 != 0).select(
            F.col("source").alias("unit_id"), i.alias("pos"), i.cast("string").alias("doc_id"),
            F.when(i % 17 == 0, "undated").otherwise(stamp).alias("timestamp"),
            F.col("lang").alias("doc_type"), "source",
            F.concat(F.when(i % 19 == 0, "./gone_").otherwise("doc_"), "doc_id", F.lit(".txt")).alias("path"),
        )


# ---- the same tables as SQL ------------------------------------------------------------------

def rd(expr: str, digits: int = 6) -> str:
    """Rounded double with no negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def md5_sql(*keys: object) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + "))"


def word_sql(digest: str, index: int) -> str:
    raw = f"CAST(CAST('0x' || substr({digest}, {1 + 8 * index}, 8) AS BIGINT) AS DOUBLE)"
    return f"(({raw} + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE))"


def uniform_sql(*keys: object) -> str:
    return word_sql(md5_sql(*keys), 0)


def normal_sql(*keys: object) -> str:
    d = md5_sql(*keys)
    return f"(sqrt(CAST(-2 AS DOUBLE) * ln({word_sql(d, 0)})) * cos(CAST({2 * math.pi!r} AS DOUBLE) * {word_sql(d, 1)}))"


def _daily_sql(table: str, stamp: str, asset: str, value: str, name: str) -> str:
    return (
        f"SELECT CAST({stamp} AS DATE) AS date, {asset} AS asset, "
        f"CAST(sum(CAST(round({value} * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) * 100 AS DOUBLE) AS value, "
        f"'{name}' AS panel_id FROM {table} GROUP BY 1, 2"
    )


def _families_sql() -> str:
    rows = ", ".join(f"('{f}', {a!r}, {h!r}, '{t}')" for f, (a, h, t) in FAMILIES.items())
    return f"SELECT * FROM (VALUES {rows}) AS t(family, asset_ids, horizons, tail_metric)"


def _level_list(levels: tuple[float, ...]) -> str:
    return "[" + ", ".join(f"CAST({a} AS DOUBLE)" for a in levels) + "]"


def cell_stats_sql(draws: str, realized: str, levels: tuple[float, ...]) -> str:
    return f"""
SELECT submission_id, unit_id, asset, horizon, count(*) AS m, max(y) AS y, avg(x) AS mean,
  avg(abs(x - y)) - sum((2 * rk - n - 1) * x) / max(n) / max(n) AS crps,
  avg(CASE WHEN x <= y THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS below,
  quantile_cont(x, {_level_list(levels)}) AS q
FROM (SELECT d.submission_id, d.unit_id, d.asset, d.horizon, d.value AS x, r.value AS y,
        CAST(row_number() OVER (PARTITION BY d.submission_id, d.unit_id, d.asset, d.horizon ORDER BY d.value) AS DOUBLE) AS rk,
        CAST(count(*) OVER (PARTITION BY d.submission_id, d.unit_id, d.asset, d.horizon) AS DOUBLE) AS n
      FROM {draws} d JOIN {realized} r ON d.unit_id = r.unit_id AND d.asset = r.asset AND d.horizon = r.horizon)
GROUP BY ALL"""


def by_level_sql(cells: str, levels: tuple[float, ...]) -> str:
    return (
        f"SELECT submission_id, unit_id, asset, horizon, y, unnest({_level_list(levels)}) AS level, "
        f"unnest(q) AS quantile FROM {cells}"
    )


PINBALL_SQL = (
    "CASE WHEN y >= quantile THEN level * (y - quantile) ELSE (CAST(1 AS DOUBLE) - level) * (quantile - y) END"
)

CTES: dict[str, str] = {
    "panel": _daily_sql("lineitem", "l_shipdate", "l_returnflag", "l_extendedprice", "ship_daily"),
    "panel_holey": _daily_sql("orders", "o_orderdate", "o_orderpriority", "o_totalprice", "order_daily"),
    "panel_small": _daily_sql("events", "ts", "event_type", "value", "event_daily"),
    "returns": "SELECT date, asset, v AS value, 'ship_returns' AS panel_id FROM (SELECT date, asset, "
               "ln(value / lag(value) OVER (PARTITION BY asset ORDER BY date)) AS v FROM panel) WHERE v IS NOT NULL",
    "families": _families_sql(),
    "asofs": "SELECT last_day(CAST(d AS DATE)) AS asof FROM generate_series(TIMESTAMP '1996-03-01', "
             "TIMESTAMP '2001-06-01', INTERVAL 3 MONTH) AS g(d)",
    "units": "SELECT family || '-' || CAST(asof AS VARCHAR) AS unit_id, family, asof, asset_ids, horizons, tail_metric "
             "FROM families CROSS JOIN asofs",
    "unit_assets": "SELECT unit_id, family, asof, unnest(asset_ids) AS asset, unnest(range(len(asset_ids))) AS a_pos, "
                   "len(asset_ids) AS n_assets, horizons FROM units",
    "cells": "SELECT unit_id, family, asof, asset, a_pos, unnest(horizons) AS horizon, unnest(range(len(horizons))) AS h_pos, "
             "len(horizons) AS n_h, a_pos * len(horizons) + unnest(range(len(horizons))) AS cell FROM unit_assets",
    "unit_panel": "SELECT u.unit_id, u.asof, p.panel_id, p.date, p.asset, p.value FROM unit_assets u JOIN panel p ON u.asset = p.asset",
    "mixed_panel": "SELECT * FROM unit_panel WHERE unit_id NOT LIKE 'F2-%' UNION ALL "
                   "SELECT u.unit_id, u.asof, p.panel_id, p.date, p.asset, p.value FROM unit_assets u JOIN returns p "
                   "ON u.asset = p.asset WHERE u.family = 'F2'",
    "cut": "SELECT unit_id, panel_id, date, asset, value FROM unit_panel WHERE date <= asof",
    "mixed_cut": "SELECT unit_id, panel_id, date, asset, value FROM mixed_panel WHERE date <= asof",
    "anchors": "SELECT unit_id, asset, arg_max(value, date) AS last, max(date) AS last_date FROM cut GROUP BY 1, 2",
    "transfer": "SELECT c.* FROM cut c JOIN anchors a ON a.unit_id = c.unit_id AND a.asset = 'A' WHERE c.unit_id LIKE 'F2-%' "
                "AND (NOT (c.asset = 'A' AND c.date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31') OR c.date = a.last_date)",
    "raw_diffs": "SELECT * FROM (SELECT unit_id, asset, date, value - lag(value) OVER w AS diff, "
                 "date_diff('day', lag(date) OVER w, date) AS step FROM cut WINDOW w AS (PARTITION BY unit_id, asset ORDER BY date)) "
                 "WHERE diff IS NOT NULL",
    "diffs": "SELECT d.* FROM raw_diffs d JOIN (SELECT unit_id, asset, greatest(10 * quantile_cont(step, 0.5), 5) AS lim "
             "FROM raw_diffs GROUP BY 1, 2) g ON d.unit_id = g.unit_id AND d.asset = g.asset WHERE d.step <= g.lim",
    "aligned": "SELECT d.*, c.n_rows FROM diffs d JOIN (SELECT unit_id, date, count(*) OVER (PARTITION BY unit_id) AS n_rows FROM "
               "(SELECT d.unit_id, d.date FROM diffs d JOIN units u ON d.unit_id = u.unit_id "
               "GROUP BY d.unit_id, d.date, len(u.asset_ids) HAVING count(*) = len(u.asset_ids))) c "
               "ON d.unit_id = c.unit_id AND d.date = c.date WHERE c.n_rows >= 30",
    "sds": "SELECT unit_id, asset, stddev_samp(diff) AS daily_sd, count(*) AS n_rows FROM aligned GROUP BY 1, 2",
    "moments": "SELECT a.unit_id, a.asset, coalesce(n.last, CAST(0 AS DOUBLE)) AS last, coalesce(d.mu, CAST(0 AS DOUBLE)) AS mu, "
               "CASE WHEN n.last IS NULL THEN CAST(1 AS DOUBLE) ELSE greatest(coalesce(d.sd, CAST(0 AS DOUBLE)), "
               "abs(n.last) * CAST(0.0001 AS DOUBLE), CAST(0.000001 AS DOUBLE)) END AS sigma FROM unit_assets a "
               "LEFT JOIN anchors n ON a.unit_id = n.unit_id AND a.asset = n.asset "
               "LEFT JOIN (SELECT unit_id, asset, avg(diff) AS mu, stddev_pop(diff) AS sd FROM diffs GROUP BY 1, 2) d "
               "ON a.unit_id = d.unit_id AND a.asset = d.asset",
    "scale_stats": "SELECT s.unit_id, s.asset, a.last, s.daily_sd * sqrt(CAST(list_max(u.horizons) AS DOUBLE)) AS sd_h "
                   "FROM sds s JOIN anchors a ON a.unit_id = s.unit_id AND a.asset = s.asset JOIN units u ON u.unit_id = s.unit_id",
    "common": "SELECT c.unit_id, c.asset, c.date, c.value, row_number() OVER w AS rn, "
              "count(*) OVER (PARTITION BY c.unit_id, c.asset) AS n FROM cut c JOIN "
              "(SELECT c.unit_id, c.date FROM cut c JOIN units u ON c.unit_id = u.unit_id "
              "GROUP BY c.unit_id, c.date, len(u.asset_ids) HAVING count(*) = len(u.asset_ids)) k "
              "ON c.unit_id = k.unit_id AND c.date = k.date WINDOW w AS (PARTITION BY c.unit_id, c.asset ORDER BY c.date)",
    "hist": "SELECT 'hist' AS submission_id, c.unit_id, c.n - c.rn AS draw, c.asset, e.horizon, "
            "a.last + (c.value - b.value) AS value FROM common c JOIN cells e ON e.unit_id = c.unit_id AND e.asset = c.asset "
            "JOIN units u ON u.unit_id = c.unit_id "
            "JOIN common b ON b.unit_id = c.unit_id AND b.asset = c.asset AND b.rn = c.rn - e.horizon "
            "JOIN anchors a ON a.unit_id = c.unit_id AND a.asset = c.asset WHERE c.rn > list_max(u.horizons)",
    "adjustments": "SELECT unit_id, asset, CASE asset WHEN 'A' THEN CAST(50 AS DOUBLE) WHEN 'N' THEN CAST(-120 AS DOUBLE) ELSE CAST(1000000000 AS DOUBLE) END AS drift_bp, "
                   "CASE asset WHEN 'A' THEN CAST(1.25 AS DOUBLE) WHEN 'N' THEN CAST(3 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS vol_scale FROM unit_assets",
    "clamped": "SELECT unit_id, asset, drift_bp, least(greatest(vol_scale, CAST(0.5 AS DOUBLE)), CAST(2 AS DOUBLE)) AS vol, "
               "CASE WHEN abs(want) > 3 * sd_h THEN sign(want) * 3 * sd_h ELSE want END AS shift, "
               "CASE WHEN abs(want) > 3 * sd_h THEN 'drift clamped' ELSE '' END AS note FROM "
               "(SELECT j.*, s.sd_h, abs(s.last) * j.drift_bp / 10000 AS want FROM adjustments j JOIN scale_stats s ON j.unit_id = s.unit_id AND j.asset = s.asset)",
    "adj": "SELECT 'adj' AS submission_id, h.unit_id, h.draw, h.asset, h.horizon, "
           "c.centre + (h.value - c.centre) * coalesce(k.vol, CAST(1 AS DOUBLE)) + coalesce(k.shift, CAST(0 AS DOUBLE)) AS value FROM hist h "
           "JOIN (SELECT unit_id, asset, horizon, avg(value) AS centre FROM hist GROUP BY 1, 2, 3) c "
           "ON h.unit_id = c.unit_id AND h.asset = c.asset AND h.horizon = c.horizon "
           "LEFT JOIN clamped k ON k.unit_id = h.unit_id AND k.asset = h.asset",
    "rw": f"SELECT 'rw' AS submission_id, unit_id, draw, asset, horizon, last + mu * horizon + sigma * sqrt(CAST(horizon AS DOUBLE)) * z AS value "
          f"FROM (SELECT c.unit_id, c.asset, c.horizon, m.last, m.mu, m.sigma, d.draw, "
          f"{normal_sql('c.unit_id', 'd.draw', 'c.cell', BASE_SEED)} AS z FROM cells c JOIN moments m ON c.unit_id = m.unit_id AND c.asset = m.asset "
          f"CROSS JOIN (SELECT unnest(range({BASE_DRAWS})) AS draw) d)",
    "draws": "SELECT * FROM hist UNION ALL SELECT * FROM adj UNION ALL SELECT * FROM rw",
    "realized": "SELECT p.unit_id, p.asset, p.rn AS horizon, p.date AS target_date, p.value FROM (SELECT unit_id, asset, date, value, "
                "row_number() OVER (PARTITION BY unit_id, asset ORDER BY date) AS rn FROM unit_panel WHERE date > asof) p "
                "JOIN cells c ON c.unit_id = p.unit_id AND c.asset = p.asset AND c.horizon = p.rn",
    "cell_stats": cell_stats_sql("draws", "realized", LEVELS),
    "level_rows": by_level_sql("cell_stats", LEVELS),
    "level_scores": f"SELECT submission_id, unit_id, level, avg({PINBALL_SQL}) AS pinball, "
                    "avg(CASE WHEN y <= quantile THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS coverage FROM level_rows GROUP BY 1, 2, 3",
    "tails": "SELECT submission_id, unit_id, avg(pinball) AS pinball, sum(abs(coverage - level)) AS coverage FROM level_scores GROUP BY 1, 2",
    "pair_means": "SELECT x.submission_id, x.unit_id, x.asset AS asset_a, x.horizon AS horizon_a, z.asset AS asset_b, z.horizon AS horizon_b, "
                  "avg(sqrt(abs(x.value - z.value))) AS expected FROM draws x JOIN draws z ON x.submission_id = z.submission_id "
                  "AND x.unit_id = z.unit_id AND x.draw = z.draw AND (x.asset < z.asset OR (x.asset = z.asset AND x.horizon < z.horizon)) GROUP BY ALL",
    "joints": "SELECT d.submission_id, d.unit_id, coalesce(v.joint, CAST(0 AS DOUBLE)) AS joint FROM (SELECT DISTINCT submission_id, unit_id FROM draws) d LEFT JOIN "
              "(SELECT p.submission_id, p.unit_id, 2 * sum(power(sqrt(abs(a.value - b.value)) - p.expected, 2)) AS joint FROM pair_means p "
              "JOIN realized a ON a.unit_id = p.unit_id AND a.asset = p.asset_a AND a.horizon = p.horizon_a "
              "JOIN realized b ON b.unit_id = p.unit_id AND b.asset = p.asset_b AND b.horizon = p.horizon_b GROUP BY 1, 2) v "
              "ON v.submission_id = d.submission_id AND v.unit_id = d.unit_id",
    "comps": "SELECT m.submission_id, m.unit_id, m.marginal, m.n_draws, u.family, u.tail_metric, CASE u.tail_metric WHEN 'coverage' THEN t.coverage ELSE t.pinball END AS tail, "
             "j.joint, len(u.asset_ids) * len(u.horizons) AS cell_count FROM "
             "(SELECT submission_id, unit_id, avg(crps) AS marginal, max(m) AS n_draws FROM cell_stats GROUP BY 1, 2) m "
             "JOIN tails t ON t.submission_id = m.submission_id AND t.unit_id = m.unit_id "
             "JOIN joints j ON j.submission_id = m.submission_id AND j.unit_id = m.unit_id JOIN units u ON u.unit_id = m.unit_id",
    "weights": "SELECT unit_id, len(asset_ids) * len(horizons) AS cell_count, "
               "CASE WHEN len(asset_ids) * len(horizons) = 1 THEN 'single' ELSE 'multi' END AS rank_group, "
               "CASE WHEN len(asset_ids) * len(horizons) = 1 THEN CAST(0.5 AS DOUBLE) / (CAST(0.5 AS DOUBLE) + CAST(0.2 AS DOUBLE)) ELSE CAST(0.5 AS DOUBLE) END AS w_marginal, "
               "CASE WHEN len(asset_ids) * len(horizons) = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS w_joint, "
               "CASE WHEN len(asset_ids) * len(horizons) = 1 THEN CAST(0.2 AS DOUBLE) / (CAST(0.5 AS DOUBLE) + CAST(0.2 AS DOUBLE)) ELSE CAST(0.2 AS DOUBLE) END AS w_tail FROM units",
    "scale": "SELECT unit_id, marginal, CASE WHEN cell_count > 1 THEN joint END AS joint, tail FROM comps WHERE submission_id = 'rw'",
    "scored": "SELECT c.*, w.rank_group, w.w_marginal, w.w_joint, w.w_tail, w.w_marginal * c.marginal / s.marginal "
              "+ w.w_joint * c.joint / coalesce(s.joint, CAST(1 AS DOUBLE)) + w.w_tail * c.tail / s.tail AS composite FROM comps c "
              "JOIN weights w ON w.unit_id = c.unit_id JOIN scale s ON s.unit_id = c.unit_id",
    "results": "SELECT s.submission_id, s.unit_id, s.family, s.rank_group, s.marginal, s.joint, s.tail, u.asof, "
               "CASE WHEN s.submission_id = 'adj' AND month(u.asof) = 12 THEN 'failure' ELSE 'success' END AS state, "
               "CASE WHEN s.submission_id = 'adj' AND month(u.asof) = 12 THEN NULL ELSE s.composite END AS score FROM scored s JOIN units u ON u.unit_id = s.unit_id",
    "counted": "SELECT *, CASE WHEN state = 'failure' THEN CAST(4 AS DOUBLE) ELSE least(greatest(score, CAST(0 AS DOUBLE)), CAST(4 AS DOUBLE)) END AS counted FROM results",
    "line_wide": "SELECT 'flag-' || l_returnflag AS submission_id, year(l_shipdate) || 'Q' || quarter(l_shipdate) AS unit_id, "
                 "l_discount AS discount, l_extendedprice / CAST(1000 AS DOUBLE) AS price, l_quantity AS quantity, l_tax AS tax FROM lineitem",
    "line_draws": "SELECT submission_id, unit_id, unnest(['discount', 'price', 'quantity', 'tax']) AS asset, 1 AS horizon, "
                  "unnest([discount, price, quantity, tax]) AS value FROM line_wide",
    "line_means": "SELECT year(d) || 'Q' || quarter(d) AS unit_id, discount, price / CAST(1000 AS DOUBLE) AS price, quantity, tax FROM (SELECT date_trunc('quarter', l_shipdate) - INTERVAL 3 MONTH AS d, "
                  + ", ".join(
                      f"CAST(sum(CAST(round({c} * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) * 100 AS DOUBLE) AS {n}"
                      for c, n in (("l_discount", "discount"), ("l_extendedprice", "price"), ("l_quantity", "quantity"), ("l_tax", "tax"))
                  )
                  + " FROM lineitem GROUP BY 1)",
    "line_realized": "SELECT unit_id, unnest(['discount', 'price', 'quantity', 'tax']) AS asset, 1 AS horizon, "
                     "unnest([discount, price, quantity, tax]) AS value FROM line_means",
    "line_stats": cell_stats_sql("line_draws", "line_realized", LINE_LEVELS),
    "doc_units": "SELECT DISTINCT source AS unit_id, DATE '2000-02-09' AS asof FROM documents",
    "docs": "SELECT source AS unit_id, 'doc_' || doc_id || '.txt' AS path, text FROM documents",
    "doc_index": "SELECT source AS unit_id, doc_id AS pos, CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 17 = 0 THEN 'undated' "
                 "ELSE CAST(CAST(DATE '1996-01-01' + CAST(doc_id % 2000 AS INTEGER) AS DATE) AS VARCHAR) END AS timestamp, lang AS doc_type, source, "
                 "CASE WHEN doc_id % 19 = 0 THEN './gone_' ELSE 'doc_' END || doc_id || '.txt' AS path FROM documents WHERE doc_id % 23 <> 0",
}


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by every table definition it needs, in dependency order."""
    known = {**CTES, **(extra or {})}
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return _quote(body)
    # results that several readers share are computed once
    heavy = {"hist", "adj", "rw", "draws", "cell_stats", "comps", "cut", "panel", "diffs", "scored", "line_stats"}
    parts = [f"{n} AS {'MATERIALIZED ' if n in heavy else ''}({known[n]})" for n in order]
    return _quote("WITH " + ",\n".join(parts) + "\n" + body)


def _quote(sql: str) -> str:
    """``asof`` is a keyword of the checking engine, and its ``count_if`` is no BIGINT."""
    return re.sub(r"\basof\b", '"asof"', _filtered_counts(sql))


def _filtered_counts(sql: str) -> str:
    """``count_if(x)`` spelled ``count(*) FILTER (WHERE x)``."""
    head, found, tail = sql.partition("count_if(")
    if not found:
        return sql
    depth, end = 1, 0
    while depth:
        depth += {"(": 1, ")": -1}.get(tail[end], 0)
        end += 1
    return f"{head}count(*) FILTER (WHERE {tail[: end - 1]}){_filtered_counts(tail[end:])}"
