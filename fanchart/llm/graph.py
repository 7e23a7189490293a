"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanchart.sources.materialize import materialized


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31)), F.sum(F.col("v") % (1 << 31))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours hang on the least node around. Large stars move greater neighbours, small stars the rest."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "at")
    joined = both.join(least, F.col("u") == F.col("at"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("at").alias("u"), F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (id, root): every id that has a link, with the least id of its component.

    Alternating large and small stars shrink components in a logarithmic number of rounds; every round is a
    minimum per node with partial aggregation, so a hub's links never meet in one task before it.
    """
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialized(ends, "star")
    mark = _mark(edges)
    while mark[0]:
        edges = materialized(_star(_star(edges, True), False), "star")
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
