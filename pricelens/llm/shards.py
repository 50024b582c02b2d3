"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each pair of key and shard has a draw ``u`` in (0, 1) from the MD5 of
``key:shard``; a key goes to the shard of least ``-ln(u) / weight``.  A shard
so gets keys in proportion to its weight, and a further shard changes only the
rows that it wins itself: nothing moves between the others.  Any system that
knows MD5 finds the same shard.

Slots number the rows of a shard without gaps, in key order.  Rows without
their texts are sorted by range over shard and key, so a shard may span many
tasks; each task numbers its rows and adds the count of that shard's rows in
the tasks before.  Only built-in functions run.

A null key counts as one key of its own, a null text is empty.  Rows that
repeat a key share its shard, as the law asks, and have slots of their own;
a key that holds a third of all rows fills its shard, but no single task.
Ties in key order go by size and checksum of the text, then by place.  An
empty table gives no rows.  ``assign`` and ``write_shards`` keep all columns of
the input; their own columns take other names where one is taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, staged

#: Hexadecimal digits of a draw: exact in a double.
DIGITS = 13
#: Bytes that a row costs beside its text.
ROW_BYTES = 16
_PLACE_BITS = 33


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 up, that ``key`` belongs to; weights must be positive, a weight of 0 takes a shard out."""
    live = [(i, float(w)) for i, w in enumerate(weights) if w]
    if not live or any(w < 0 for _, w in live):
        raise ValueError("weights must not be negative, and one at least positive")
    name = F.coalesce(key.cast("string"), F.lit(""))

    def cost(x: Column) -> Column:
        digits = F.substring(F.md5(F.concat(name, F.lit(":"), x["shard"].cast("string"))), 1, DIGITS)
        u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16 ** DIGITS))
        return F.struct((-F.log(u) / x["weight"]).alias("cost"), x["shard"].alias("shard"))

    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(w).alias("weight")) for i, w in live])
    return F.array_min(F.transform(shards, cost))["shard"]


def assign(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", name: str = "shard") -> DataFrame:
    """``docs`` with its shard in a new column ``name``."""
    return docs.withColumn(fresh(name, docs.columns), shard_of(F.col(key), weights))


def slots(rows: DataFrame, order: Sequence[str], shard: str = "shard") -> DataFrame:
    """Narrow ``rows`` with ``slot``: their place in the shard, gapless from 0, in the order given."""
    told = staged(rows.withColumn("_at", F.monotonically_increasing_id()), "shard-rows")
    placed = staged(told.repartitionByRange(shard, *order, "_at").sortWithinPartitions(shard, *order, "_at").withColumn("_at", F.monotonically_increasing_id())
                    .withColumns({"_part": F.shiftright("_at", _PLACE_BITS), "_place": F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))}), "shard-places")
    parts = placed.groupBy(shard, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(shard).orderBy("_part")) - F.col("_n")
    parts = parts.select(shard, "_part", (before - F.col("_first")).alias("_shift"))
    return placed.join(parts, [shard, "_part"]).withColumn("slot", F.col("_place") + F.col("_shift")).drop("_at", "_part", "_place", "_shift")


def shard_rows(docs: DataFrame, weights: Sequence[float], grown: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: key, size, text_crc32, shard, slot, and its shard under the weights ``grown``."""
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body).cast("long") + ROW_BYTES).alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    narrow = narrow.withColumns({"shard": shard_of(F.col("doc_id"), weights), "grown_shard": shard_of(F.col("doc_id"), grown)})
    return slots(narrow, ["doc_id", "size", "text_crc32"])


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], key: str = "doc_id", max_rows: int = 1_000_000) -> DataFrame:
    """Write ``docs`` to one folder a shard, sorted by key, in files of ``max_rows`` at most; returns the table read back.

    Rows are dealt by range over shard and key, so a large shard has many writers.
    """
    name = fresh("shard", docs.columns)
    (assign(docs, weights, key, name).repartitionByRange(name, key, F.xxhash64(*docs.columns)).sortWithinPartitions(name, key)
     .write.option("maxRecordsPerFile", max_rows).partitionBy(name).parquet(path))
    return docs.sparkSession.read.parquet(path)
