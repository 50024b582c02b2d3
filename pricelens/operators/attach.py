"""Attach per-search values to rows without gathering a search in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that one search's rows are dealt into.
SALTS = 64


def attach(rows: DataFrame, per_key: DataFrame, key: str, spread: str, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join ``rows`` with a table of one row per ``key``.

    The small table is repeated ``salts`` times and the rows are dealt by the
    hash of ``spread``, so a key that holds a third of all rows is joined by
    many tasks and no exchange is keyed on ``key`` alone.
    """
    small = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return dealt.join(small, [key, "_salt"], how).drop("_salt")
