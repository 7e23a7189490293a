"""Keyed random numbers.

``rand``/``randn`` depend on how rows are partitioned, so a retried or reshuffled stage would
change a forecast. Here every number is a pure function of its keys (the leading words of the MD5
of the joined keys), so lost executors recompute the same draws and any SQL engine can reproduce
the stream.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = float(1 << 32)


def _digest(keys: tuple[Column | str | int, ...]) -> Column:
    parts = []
    for k in keys:
        if isinstance(k, int):
            k = F.lit(k)
        elif isinstance(k, str):
            k = F.col(k)
        parts.append(k.cast("string"))
    return F.md5(F.concat_ws("|", *parts))


def _word(digest: Column, index: int) -> Column:
    return F.conv(F.substring(digest, 1 + 8 * index, 8), 16, 10).cast("double")


def uniform(*keys: Column | str | int) -> Column:
    """Uniform on the open interval (0, 1). Strings name columns."""
    return (_word(_digest(keys), 0) + 0.5) / WORD


def normal(*keys: Column | str | int) -> Column:
    """Standard normal from two words of one digest (Box-Muller)."""
    digest = _digest(keys)
    u = (_word(digest, 0) + 0.5) / WORD
    v = (_word(digest, 1) + 0.5) / WORD
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * v)
