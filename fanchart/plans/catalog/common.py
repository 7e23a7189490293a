"""Helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double so that two engines' summation orders agree."""
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def ten_thousandths(c: str) -> str:
    """SQL: the sum of ``c`` cut to ten-thousandths, in those; a sum of integers does not depend on its order."""
    return f"CAST(sum(CAST(floor({c} * 10000) AS BIGINT)) AS BIGINT)"


def whole_sum(c: str) -> Column:
    """The same as a column."""
    return F.sum(F.floor(F.col(c) * 10000))


def text(c: str) -> Column:
    return F.col(c).cast("string").alias(c)


def counts(df: DataFrame, *names: str) -> DataFrame:
    """Spread a refusal's counts into columns; an absent count is -1."""
    keep = [c for c in df.columns if c != "counts"]
    return df.select(
        *keep, *[F.coalesce(F.element_at("counts", F.lit(n)), F.lit(-1).cast("long")).alias(n) for n in names]
    )
