"""Read models over the listing table: saved searches, freshness, deals."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.times import ts_lit


def _active(listings: DataFrame) -> DataFrame:
    return listings.filter(F.coalesce(F.col("is_active"), F.lit(True)))


def saved_searches(listings: DataFrame) -> DataFrame:
    """Per search: active listing count and last scan time, newest first."""
    return newest_first(_active(listings).groupBy("query").agg(F.count(F.lit(1)).alias("n_active"), F.max("scraped_at").alias("last_seen")))


def newest_first(summaries: DataFrame) -> DataFrame:
    return summaries.orderBy(F.col("last_seen").desc(), "query")


def search_freshness(listings: DataFrame, now: datetime, ttl_hours: float) -> DataFrame:
    """Per search: last scan of its active listings and whether it is still
    fresh (``now - last <= ttl``); ``ttl <= 0`` means never fresh."""
    return with_freshness(_active(listings).groupBy("query").agg(F.max("scraped_at").alias("last_scan")), now, ttl_hours)


def with_freshness(last: DataFrame, now: datetime, ttl_hours: float) -> DataFrame:
    """Add ``fresh`` to (query, last_scan)."""
    if ttl_hours <= 0:
        fresh = F.lit(False)
    else:
        fresh = F.coalesce(F.col("last_scan") >= ts_lit(now - timedelta(hours=ttl_hours)), F.lit(False))
    return last.withColumn("fresh", fresh)


def is_fresh(listings: DataFrame, query: str, now: datetime, ttl_hours: float) -> DataFrame:
    """One search's freshness; a never-scanned search is not fresh (no row -> False)."""
    f = search_freshness(listings.filter(F.col("query") == query), now, ttl_hours)
    return f


def best_deals(listings: DataFrame, limit: int = 10, query: str | None = None) -> DataFrame:
    """Most negative price scores among active, scored listings (global top-k)."""
    df = _active(listings).filter(F.col("price_score").isNotNull())
    if query is not None:
        df = df.filter(F.col("query") == query)
    return df.orderBy(F.col("price_score").asc(), "query", "id").limit(limit)


def listings_by_query(listings: DataFrame, query: str, active_only: bool = False) -> DataFrame:
    """One search's listings by price score, unscored first."""
    df = listings.filter(F.col("query") == query)
    if active_only:
        df = _active(df)
    return df.orderBy(F.col("price_score").asc_nulls_first(), "id")


def has_report(ai_report_col: str = "ai_report"):
    """A stored review exists: condition set or a non-empty summary."""
    r = F.col(ai_report_col)
    return F.coalesce(r["condition_score"].isNotNull() | (r["summary"] != ""), F.lit(False))


def top_reviewed(listings: DataFrame, limit: int) -> DataFrame:
    """Per search: reviewed listings by composite score (NULL as 0), top ``limit``.

    ``row_number() <= limit`` lets Spark keep only ``limit`` rows per search on
    each map task before the shuffle (partial WindowGroupLimit)."""
    w = Window.partitionBy("query").orderBy(
        F.coalesce(F.col("composite_score"), F.lit(0.0)).desc(), "id")
    return (listings.filter(has_report())
            .withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= limit))
