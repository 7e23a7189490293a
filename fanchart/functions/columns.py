"""Column helpers shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_PATTERN = r"^\d{4}-\d{2}-\d{2}$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: str | Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def is_iso(c: str | Column) -> Column:
    return F.coalesce(col(c).rlike(ISO_PATTERN), F.lit(False))


def iso_text(c: str | Column) -> Column:
    """First ten characters of a date, timestamp or string, or null when that is no ISO date."""
    text = F.substring(col(c).cast("string"), 1, 10)
    return F.when(text.rlike(ISO_PATTERN), text)


def iso_date(c: str | Column) -> Column:
    return F.to_date(iso_text(c))


def clamp(c: str | Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def pinball(y: Column, q: Column, level: Column) -> Column:
    """Quantile loss; the tie ``y == q`` costs nothing on either branch."""
    return F.when(y >= q, level * (y - q)).otherwise((F.lit(1.0) - level) * (q - y))
