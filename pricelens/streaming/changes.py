"""Change-only price history of the feed as a stateful stream (X2).

``price_changes_stream`` keeps one row per (listing, search): its latest price
and when it was seen.  Each micro-batch's rows of a key are ordered by
``(seen_at, seq)`` and a row is emitted when its price differs from the one
before, with that price, as in ``operators.history.price_changes``.  Rows
that are not after the key's latest row (replayed or late ones) change
nothing (``streaming.late`` handles late rows of counts).

With ``idle`` the state of a key goes once the watermark is that far past its
latest row (an event-time timer); a listing that comes back later starts anew.

State lives in RocksDB; the checkpoint restores it, and a micro-batch that is
run again finds the state before it, so it emits the same rows.  A task holds
one key's rows of one micro-batch (three numbers each): ``maxFilesPerTrigger``
bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "seen_us bigint, seq bigint, price bigint"
_OUT = "listing_id string, query string, price bigint, seen_us bigint, seq bigint, previous_price bigint"


class _Changes(StatefulProcessor):
    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.latest.get() if self.latest.exists() else None
        at, price = ((known[0], known[1]), known[2]) if known is not None else (None, None)
        before = at
        for seen, seq, now in sorted((r.seen_us, r.seq, r.price) for r in rows):
            if at is not None and (seen, seq) <= at:
                continue
            if now != price:
                yield Row(listing_id=key[0], query=key[1], price=now, seen_us=seen, seq=seq, previous_price=price)
            at, price = (seen, seq), now
        if at != before:
            self.latest.update((*at, price))
            if self.idle_ms is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(at[0] // 1000 + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.latest.clear()
        return iter(())

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def price_changes_stream(feed: DataFrame, delay: str = "1 hour", idle: str | None = None) -> DataFrame:
    """listing_id, query, price, seen_at, seq, previous_price and ``is_drop`` of each change; append mode."""
    spark = feed.sparkSession
    use_state_store(spark)
    idle_ms = None
    if idle is not None:
        span = spark.range(1).select((F.lit(datetime(2000, 1, 1, tzinfo=timezone.utc)) + F.expr(f"INTERVAL {idle}")).alias("t")).select(F.unix_millis("t") - 946684800000)
        idle_ms = int(span.first()[0])
    seen = F.col("scraped_at").cast("timestamp")
    rows = feed.where(F.col("price_nok") != 0).withColumn("scraped_at", seen)
    rows = rows.select(F.col("id").alias("listing_id"), "query", F.col("price_nok").cast("bigint").alias("price"), F.unix_micros("scraped_at").alias("seen_us"), F.col("seq").cast("bigint").alias("seq"), "scraped_at")
    if idle is not None:
        rows = rows.withWatermark("scraped_at", delay)
    found = rows.groupBy("listing_id", "query").transformWithState(
        _Changes(idle_ms), outputStructType=_OUT, outputMode="append", timeMode="none" if idle is None else "eventTime")
    return found.select("listing_id", "query", "price", F.timestamp_micros("seen_us").alias("seen_at"), "seq", "previous_price",
                        F.coalesce(F.col("price") < F.col("previous_price"), F.lit(False)).alias("is_drop"))


def start(changes: DataFrame, path: str, checkpoint: str):
    """Write the changes to Parquet ``path``, what has landed so far, exactly once."""
    return changes.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
