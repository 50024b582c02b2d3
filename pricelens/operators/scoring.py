"""Composite deal scores, keyword hits, bands and display columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions import scoring as SC
from pricelens.functions import text as TX
from pricelens.params import NEGATIVE_KEYWORDS, POSITIVE_KEYWORDS


def score_listings(scored: DataFrame, reviewed_battery: str | None = None) -> DataFrame:
    """Add ``composite_score`` (needs title, description, price_score)."""
    rb = F.col(reviewed_battery) if reviewed_battery else None
    return SC.with_composite_score(scored, reviewed_battery=rb)


def best_first(scored: DataFrame) -> DataFrame:
    """Descending composite score, NULL as 0; ties by (query, id).

    The rows are dealt by id first: a sort samples its input before it sorts,
    and would score every text twice."""
    return scored.repartition("id").orderBy(F.coalesce(F.col("composite_score"), F.lit(0.0)).desc(), "query", "id")


def keyword_hits(listings: DataFrame) -> DataFrame:
    text = listings.select("id", "query", SC.score_text(F.col("title"), F.col("description")).alias("_text"))
    return text.select("id", "query", SC.keyword_hits("_text", POSITIVE_KEYWORDS).alias("positive_hits"),
                       SC.keyword_hits("_text", NEGATIVE_KEYWORDS).alias("negative_hits"))


def battery_pct(listings: DataFrame) -> DataFrame:
    text = listings.select("id", "query", SC.score_text(F.col("title"), F.col("description")).alias("_text"))
    found = text.select("id", "query", TX.battery_digits("_text").alias("_digits")).select("id", "query", TX.battery_number("_digits").alias("battery_match"))
    return found.withColumn("battery_pct", F.when(F.col("battery_match").between(50, 100), F.col("battery_match")))


def deal_bands(df: DataFrame, condition_col: str | None = None) -> DataFrame:
    out = df.withColumn("price_band", SC.price_band("price_score"))
    if condition_col:
        out = out.withColumn("condition_band", SC.condition_band(condition_col))
    return out


def listing_display(df: DataFrame, reviewed_battery: str | None = None) -> DataFrame:
    """Display columns of the listings table: battery, storage, city, price text."""
    text = F.concat_ws(" ", F.coalesce(F.col("title"), F.lit("")),
                       F.coalesce(F.col("description"), F.lit("")))
    battery = TX.battery_match(text)
    if reviewed_battery:
        battery = F.coalesce(F.nullif(F.col(reviewed_battery), F.lit(0)), battery)
    return df.select(
        "id", "query",
        battery.alias("battery_display"),
        F.coalesce(TX.storage_of("title"), F.lit("—")).alias("storage"),
        TX.city_of("location").alias("city"),
        TX.format_price("price_nok").alias("price_text"),
    )
