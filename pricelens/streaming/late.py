"""Window counts of the feed with replays dropped and late rows corrected (X4).

Two streams read the feed.  ``counted`` drops replayed rows within the
watermark and counts per search and window; a window is emitted once the
watermark passes its end, and rows older than the watermark are not counted.
``aside`` puts the rows that are older than the watermark may ever have been
when they came into a side table, one folder for each micro-batch, so a
batch that is run again writes the same.  ``corrections`` is a batch job: it
counts the windows that side rows fall into anew from the landed feed, by
distinct row, and returns those whose count is missing or differs;
``corrected`` patches the emitted windows with them.  Windows without side rows
are never read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEYS = ("query", "window_start", "window_end")
_WINDOWS = "query string, window_start timestamp, window_end timestamp, n_obs long"
_LATE = "query string, window_start timestamp, window_end timestamp, seq long, scraped_at timestamp"


def _windowed(rows: DataFrame, window: str) -> DataFrame:
    w = F.window("scraped_at", window)
    return rows.withColumn("w", w).select("query", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "seq", "scraped_at")


def counted(feed: DataFrame, path: str, checkpoint: str, window: str = "1 day", delay: str = "1 hour") -> StreamingQuery:
    """Write the counts of closed windows to ``path``; rows with the same ``seq`` count once."""
    once = feed.withWatermark("scraped_at", delay).dropDuplicatesWithinWatermark(["seq"])
    counts = (once.groupBy("query", F.window("scraped_at", window).alias("w")).agg(F.count(F.lit(1)).alias("n_obs"))
              .select("query", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_obs"))
    return counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def aside(feed: DataFrame, root: str, checkpoint: str, window: str = "1 day", delay: str = "1 hour") -> StreamingQuery:
    """Write rows older than the greatest time seen, less ``delay``, to ``root/late``.

    The greatest times of the batches are kept in ``root/marks``.  A batch's
    own time counts too, so every row that ``counted`` may have left out is here."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.agg(F.max("scraped_at").alias("top")).write.mode("overwrite").parquet(f"{root}/marks/batch={number}")
        top = spark.read.schema("top timestamp, batch long").parquet(f"{root}/marks").where(F.col("batch") <= number).agg(F.max("top")).first()[0]
        if top is not None:
            old = F.col("scraped_at") < F.lit(top) - F.expr(f"INTERVAL {delay}")
            _windowed(batch.where(old), window).write.mode("overwrite").parquet(f"{root}/late/batch={number}")

    return feed.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(spark, root: str) -> DataFrame:
    return spark.read.schema(f"{_LATE}, batch long").parquet(f"{root}/late")


def corrections(landed: DataFrame, windows: DataFrame, late: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Closed windows with late rows whose emitted count (``windows``) is missing or not that of the feed as it landed."""
    closed = landed.select((F.max("scraped_at") - F.expr(f"INTERVAL {delay}")).alias("at")).scalar()
    touched = late.where(F.col("window_end") <= closed).select(*KEYS).distinct()
    counts = _windowed(landed, window).join(touched, list(KEYS), "left_semi").groupBy(*KEYS).agg(F.countDistinct("seq").alias("n_obs"))
    return counts.join(windows.select(*KEYS, F.col("n_obs").alias("emitted")), list(KEYS), "left").where(~F.col("n_obs").eqNullSafe(F.col("emitted"))).select(*KEYS, "n_obs")


def corrected(windows: DataFrame, patches: DataFrame) -> DataFrame:
    """Emitted windows, patched."""
    return windows.join(patches.select(*KEYS), list(KEYS), "left_anti").unionByName(patches)


def read_windows(spark, path: str) -> DataFrame:
    return spark.read.schema(_WINDOWS).parquet(path)
