"""Explicit schemas of the tables the engine reads and writes (never inferred)."""

from pyspark.sql import types as T

AI_REPORT = T.StructType([
    T.StructField("condition_score", T.IntegerType()),
    T.StructField("battery_pct", T.IntegerType()),
    T.StructField("red_flags", T.ArrayType(T.StringType())),
    T.StructField("summary", T.StringType()),
])

# The observation feed: one row per listing card seen in a scan.
OBSERVATIONS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("query", T.StringType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("price_nok", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("scraped_at", T.TimestampType()),
    T.StructField("seq", T.LongType()),
    T.StructField("image_urls", T.ArrayType(T.StringType())),
    T.StructField("description", T.StringType()),
    T.StructField("scan_id", T.StringType()),
])

SCANS = T.StructType([
    T.StructField("scan_id", T.StringType(), False),
    T.StructField("query", T.StringType(), False),
    T.StructField("scanned_at", T.TimestampType()),
    T.StructField("complete", T.BooleanType()),
])

# Latest state of every listing, key (id, query).
LISTINGS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("query", T.StringType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("price_nok", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("scraped_at", T.TimestampType()),
    T.StructField("image_urls", T.ArrayType(T.StringType())),
    T.StructField("description", T.StringType()),
    T.StructField("price_score", T.DoubleType()),
    T.StructField("composite_score", T.DoubleType()),
    T.StructField("ai_report", AI_REPORT),
    T.StructField("is_active", T.BooleanType()),
])

# Change-only price history (append only).  ``previous_price`` is the price
# recorded before this row for the key (NULL for the first), kept so drops
# need only the latest row per key.
PRICE_HISTORY = T.StructType([
    T.StructField("listing_id", T.StringType(), False),
    T.StructField("query", T.StringType(), False),
    T.StructField("price", T.LongType(), False),
    T.StructField("seen_at", T.TimestampType()),
    T.StructField("seq", T.LongType()),
    T.StructField("previous_price", T.LongType()),
])

# Raw model-review output, before sanitizing.
RAW_ASSESSMENTS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("query", T.StringType(), False),
    T.StructField("condition_score", T.StringType()),
    T.StructField("battery_pct", T.StringType()),
    T.StructField("red_flags", T.ArrayType(T.StringType())),
    T.StructField("summary", T.StringType()),
])

# A captured result page.
PAGES = T.StructType([
    T.StructField("page_id", T.LongType(), False),
    T.StructField("query", T.StringType()),
    T.StructField("page_num", T.IntegerType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

# Listing rows as the store keeps them: plus the last price written to the
# history, so an append needs no history scan.
STORED_LISTINGS = T.StructType(list(LISTINGS.fields) + [T.StructField("recorded_price", T.LongType())])
