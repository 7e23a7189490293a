"""Exact ranks within groups of any size.

CRPS, quantiles, PIT and coverage all follow from the rank of each draw in its cell. A cell of an
admissible submission has at most 20,000 draws, so one window does it. Raw tables give no such
bound: one cell may hold a third of all rows. There equal values fold to one row with their count first, and hot
groups are split into value ranges, ranked range by range and shifted by the size of the lower ranges, which gives
the same ranks exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fanchart.sources.materialize import materialized

#: Above this many rows a group is ranked in slices.
SPLIT_ABOVE = 2_000_000
#: Distinct values of one slice; their number, not ``split_above``, says how many slices there are.
SLICE = 500_000


def folded(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Rows ``(keys, value, _n)``: each group's distinct values with their counts, written once for all readers."""
    return materialized(df.groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("_n")), "rank-values")


def ranked(df: DataFrame, keys: list[str], value: str = "value", carry: list[str] | None = None,
           split_above: int | None = None) -> DataFrame:
    """Rows ``(keys, value, carry, n, lo, hi, m)``: ``n`` equal values at ranks ``lo..hi`` of ``m``.

    ``split_above=None`` says that groups are bounded by contract. Otherwise equal values fold first (``df`` may come
    from :func:`folded` already), groups of more than ``split_above`` rows take the sliced way, and all others one
    window over their distinct values. ``carry`` columns must be functions of ``keys``.
    """
    carry = carry or []
    if split_above is None:
        return _windowed(df, keys, value, carry)
    if "_n" not in df.columns:
        own = df.select(*keys, *carry).dropDuplicates(keys) if carry else None
        df = folded(df, keys, value)
        df = df.join(own, keys) if carry else df
        value = "value"
    sizes = df.groupBy(*keys).agg(F.sum("_n").alias("_m"), F.count(F.lit(1)).alias("_values"))
    hot = sizes.where(F.col("_m") > split_above)
    hot_values = hot.agg(F.sum("_values")).first()[0]
    if not hot_values:
        return _counted(df, keys, value, carry)
    cold = df.join(hot.select(*keys), keys, "left_anti")
    parallel = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(parallel, math.ceil(hot_values / SLICE))
    return _counted(cold, keys, value, carry).unionByName(
        _sliced(df.join(hot.select(*keys, "_m"), keys), keys, value, carry, slices)
    )


def _windowed(df: DataFrame, keys: list[str], value: str, carry: list[str]) -> DataFrame:
    group = Window.partitionBy(*keys)
    rows = df.select(
        *keys, F.col(value).alias("value"), *carry,
        F.row_number().over(group.orderBy(value)).cast("long").alias("lo"),
        F.count(F.lit(1)).over(group).alias("m"),
    )
    return rows.select(*keys, "value", *carry, F.lit(1).cast("long").alias("n"), "lo", F.col("lo").alias("hi"), "m")


def _counted(rows: DataFrame, keys: list[str], value: str, carry: list[str]) -> DataFrame:
    group, n = Window.partitionBy(*keys), F.col("_n")
    hi = F.sum(n).over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(
        *keys, F.col(value).alias("value"), *carry, n.alias("n"), (hi - n + 1).alias("lo"), hi.alias("hi"), F.sum(n).over(group).alias("m")
    )


def _sliced(rows: DataFrame, keys: list[str], value: str, carry: list[str], slices: int) -> DataFrame:
    distinct = rows.select(*keys, F.col(value).alias("value"), F.col("_n").alias("n"), F.col("_m").alias("m"), *carry)
    # contiguous value ranges of even size; written once so that both readers see the same slices
    sliced = materialized(
        distinct.repartitionByRange(slices, *keys, "value").withColumn("_slice", F.spark_partition_id()),
        "rank-slices",
    )
    within = Window.partitionBy(*keys, "_slice").orderBy("value").rowsBetween(
        Window.unboundedPreceding, 0
    )
    local = sliced.withColumn("_hi", F.sum("n").over(within))
    below = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "_slice").agg(F.sum("n").alias("_c"))
        .withColumn("_offset", F.coalesce(F.sum("_c").over(below), F.lit(0)))
        .drop("_c")
    )
    hi = F.col("_offset") + F.col("_hi")
    return local.join(offsets, [*keys, "_slice"]).select(
        *keys, "value", *carry, "n", (hi - F.col("n") + 1).alias("lo"), hi.alias("hi"), "m"
    )


def _in_ranges(df: DataFrame, order: list) -> tuple[DataFrame, DataFrame]:
    """The rows with the number of their sorted range, written once, and the rows below each range."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialized(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    # one row per range, whose number is a setting of the session
    below = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.sum("_n") if "_n" in df.columns else F.count(F.lit(1))
    offsets = cut.groupBy("_range").agg(weight.alias("_c")).select(
        F.col("_range").alias("_of"), F.coalesce(F.sum("_c").over(below), F.lit(0)).alias("_below")
    )
    return cut, offsets


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with each row's position from 1 in a total order, as ``name``.

    Rows are dealt to sorted ranges; a row's position is its place in its range plus the rows of the ranges below. Rows
    that agree in all of ``order`` are numbered next to each other in no given order.
    """
    cut, offsets = _in_ranges(df, order)
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    out = cut.withColumn("_place", place).join(offsets, F.col("_range") == F.col("_of"))
    return out.withColumn(name, F.col("_place") + F.col("_below")).drop("_range", "_of", "_place", "_below")


def global_rank(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """``df`` with 1 + the number of rows of a smaller ``value``; null values rank first, as in an ascending window.

    Equal values fold to one row with their count before values are dealt to sorted ranges, so a value that a third of
    the rows share is one row there; the ranks come back by an equi-join, which adaptive execution splits where one value is hot.
    """
    distinct = df.groupBy(F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    cut, offsets = _in_ranges(distinct, [F.col("_value")])
    within = Window.partitionBy("_range").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    ranks = cut.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(offsets, F.col("_range") == F.col("_of"))
    ranks = ranks.select("_value", (F.col("_below") + F.col("_before") + 1).alias(name))
    return df.join(ranks, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")
