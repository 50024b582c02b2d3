"""Observation feed as a stream.

* ``latest_price_stream`` (X1): latest price per listing, update mode; state
  is one partial aggregate per key.
* ``apply_feed`` (X2 + X3): every micro-batch goes through the per-scan batch
  path of ``sources.store`` under its batch id, so its price changes (with the
  previous price, hence live drop flags) are found by the same built-in
  expressions as in batch, and a batch that is run again writes the same rows.
* ``scan_activity_stream`` (X4): observations per search and tumbling window
  with a watermark, append mode (a window is emitted once the watermark
  passes its end).  ``scan_activity`` is the batch twin: the windows a
  drained stream has emitted.
* Table maintenance (X5) runs per landed scan, see ``streaming.maintenance``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricelens.sources.store import ListingStore


def latest_price_stream(feed: DataFrame) -> DataFrame:
    """``(id, query) -> latest (scraped_at, seq, price)``; run in update mode."""
    return (feed.filter(F.col("price_nok") != 0)
            .groupBy("id", "query")
            .agg(F.max(F.struct("scraped_at", "seq", "price_nok")).alias("l"))
            .select("id", "query", F.col("l.price_nok").alias("price"),
                    F.col("l.scraped_at").alias("seen_at")))


def apply_feed(feed: DataFrame, store: ListingStore, checkpoint: str, name: str = "feed") -> StreamingQuery:
    """Apply what has landed on ``feed`` to ``store``, one scan per micro-batch.

    Partial by nature, so no listing turns inactive.  Inside a micro-batch the
    rows of a key apply in ``seq`` order."""

    def apply(batch: DataFrame, number: int) -> None:
        scan_id = f"{name}-{number:012d}"
        path = f"{store.root}/scans/scan_id={scan_id}"
        if not store.applied(scan_id):
            batch.write.mode("overwrite").parquet(path)
            store.apply_scan(batch.sparkSession.read.schema(batch.schema).parquet(path), scan_id, prune_missing=False)

    return feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def price_drops_found(history: DataFrame) -> DataFrame:
    """Recorded changes with ``is_drop``."""
    return history.withColumn("is_drop", F.coalesce(F.col("price") < F.col("previous_price"), F.lit(False)))


def scan_activity_stream(feed: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Observations per search and tumbling window, emitted once final."""
    return (feed.withWatermark("scraped_at", delay)
            .groupBy("query", F.window("scraped_at", window).alias("w"))
            .agg(F.count(F.lit(1)).alias("n_obs"))
            .select("query", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "n_obs"))


def scan_activity(obs: DataFrame, window: str = "1 day", delay_seconds: int = 3600) -> DataFrame:
    """Batch twin of ``scan_activity_stream``: the windows whose end is at or
    before the final watermark ``max(scraped_at) - delay`` (a scalar subquery,
    no join)."""
    wm = obs.select(F.max("scraped_at")).scalar() - F.expr(f"INTERVAL {delay_seconds} SECONDS")
    agg = (obs.groupBy("query", F.window("scraped_at", window).alias("w"))
           .agg(F.count(F.lit(1)).alias("n_obs")))
    return (agg.filter(F.col("w.end") <= wm)
            .select("query", F.col("w.start").alias("window_start"),
                    F.col("w.end").alias("window_end"), "n_obs"))


def read_feed(spark, path: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files landing in ``path`` as a stream (explicit schema)."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)
