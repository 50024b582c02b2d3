"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLITTER = 134217729.0  # 2**27 + 1, Veltkamp split of a double


def py_round(c: Column, digits: int) -> Column:
    """Round to ``digits`` decimals like Python's ``round``: half-to-even on the
    exact binary value.

    ``p = x * 10**d`` is rounded; its exact error ``e`` comes from an
    error-free product (Veltkamp split, all steps exact in IEEE doubles).  Only
    when ``p`` is exactly halfway can the rounding direction differ from
    ``rint(p)``, and then the sign of ``e`` decides (2.675 -> 2.67, since
    2.675 is stored as 2.67499999...).  Spark's ``round`` is HALF_UP on the
    decimal form and ``bround`` misses such cases.
    """
    s = F.lit(float(10 ** digits))
    p = c * s
    t = c * F.lit(SPLITTER)
    hi = t - (t - c)
    lo = c - hi
    err = (hi * s - p) + lo * s
    tie = (p - F.floor(p)) == F.lit(0.5)
    r = (F.when(tie & (err > 0), F.ceil(p).cast("double"))
         .when(tie & (err < 0), F.floor(p).cast("double"))
         .otherwise(F.rint(p)))
    return r / s


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))
