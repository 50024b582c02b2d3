"""Listing-shaped views over the driver's tables.

The engine's own inputs are an observation feed and captured pages; the
benchmark data is TPC-H-like, so each view renames real columns into that
shape (no rows are invented, none dropped).  The oracle SQL builds the same
views as CTEs.

- ``obs``       events     -> one observation per event (user = listing, type = search)
- ``listings_v``obs        -> latest state per (id, query), active = seen on the query's last day
- ``catalog``   part       -> listings of brand searches
- ``market_big``lineitem⋈part -> unit-price observations per brand, the large market
- ``posts``     documents  -> text listings per language (first line = title)
- ``reviews``   labels     -> raw model-review rows
- ``captured``  pages      -> captured result pages
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.functions.scoring import with_composite_score
from pricelens.functions.text import py_strip
from pricelens.operators.attach import attach
from pricelens.operators.market import score_against_market, market_report
from pricelens.params import BASE_URL
from pricelens.plans import splices as SP
from pricelens.sources.tables import read_table


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    return e.select(
        F.col("user_id").cast("string").alias("id"),
        F.col("event_type").alias("query"),
        F.floor("value").cast("bigint").alias("price_nok"),
        F.col("ts").alias("scraped_at"),
        F.col("event_id").alias("seq"),
        F.to_date("ts").alias("scan_day"),
    )


def latest_base(o: DataFrame) -> DataFrame:
    """Listing state from observation rows without scores: the latest row per
    (id, query) (partial aggregate), active when seen on its search's last day."""
    latest = (o.groupBy("id", "query")
              .agg(F.max(F.struct("scraped_at", "seq", "price_nok", "scan_day")).alias("l"))
              .select("id", "query", "l.*"))
    last_day = o.groupBy("query").agg(F.max("scan_day").alias("last_day"))
    return attach(latest, last_day, "query", "id", "inner").select(
        "query", "id", "scraped_at", "seq", "price_nok",
        (F.col("scan_day") == F.col("last_day")).alias("is_active"),
        F.concat(F.lit("listing "), F.col("id")).alias("title"),
        F.concat(F.lit(BASE_URL + "/item/"), F.col("id")).alias("url"),
        F.expr(SP.LISTING_TEXT).alias("description"))


def latest_state(o: DataFrame) -> DataFrame:
    """``latest_base`` price-scored against each search's median and composite-scored."""
    cur = latest_base(o)
    scored = score_against_market(cur, market_report(cur))
    return with_composite_score(scored)


def listings_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest observation per (id, query) with active flag and scores."""
    return latest_state(obs(spark, sf_dir))


def listings_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``listings_v`` without the score columns (for read models that need none)."""
    return latest_base(obs(spark, sf_dir))


def _split_last_scan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Observations before each search's last scan day, and that day's scan."""
    o = obs(spark, sf_dir)
    last = o.groupBy("query").agg(F.max("scan_day").alias("_last"))
    oj = attach(o, last, "query", "seq", "inner")
    before = oj.filter(F.col("scan_day") < F.col("_last")).drop("_last")
    batch = oj.filter(F.col("scan_day") == F.col("_last")).drop("_last")
    return before, batch


def table_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored listing state before each search's last scan."""
    return latest_state(_split_last_scan(spark, sf_dir)[0]).drop("seq")


def history_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelens.operators.history import price_changes
    return price_changes(_split_last_scan(spark, sf_dir)[0])


def last_scan_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last scan of every search, in feed shape (scores unset)."""
    b = _split_last_scan(spark, sf_dir)[1]
    return b.select("id", "query", F.concat(F.lit("listing "), F.col("id")).alias("title"),
                    "price_nok", F.concat(F.lit(BASE_URL + "/item/"), F.col("id")).alias("url"),
                    "scraped_at", F.expr(SP.LISTING_TEXT).alias("description"),
                    F.lit(None).cast("double").alias("price_score"),
                    F.lit(None).cast("double").alias("composite_score"), "seq")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_retailprice")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_brand").alias("query"),
        F.col("p_name").alias("title"),
        F.floor("p_retailprice").cast("bigint").alias("price_nok"),
    )


def market_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity", "l_extendedprice")
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_brand")
    return (li.join(p, li.l_partkey == p.p_partkey)
            .select(F.col("p_brand").alias("query"),
                    F.when(F.col("l_quantity") > 0,
                           F.floor(F.col("l_extendedprice") / F.col("l_quantity")))
                    .cast("bigint").alias("price_nok")))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "n_chars", "source")
    d = d.withColumn("_title", py_strip(F.split_part(F.col("text"), F.lit("\n"), F.lit(1))))
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("lang").alias("query"),
        F.expr(SP.POST_TITLE.format(title="_title")).alias("title"),
        F.expr(SP.POST_TEXT).alias("description"),
        F.col("n_chars").alias("price_nok"),
        F.col("source").alias("location"),
        "doc_id",
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw review rows as a model would return them (strings, out-of-range values)."""
    lab = read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    d = read_table(spark, sf_dir, "documents", "doc_id", "lang")
    return (lab.join(d, "doc_id").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("lang").alias("query"),
        F.expr(SP.CONDITION).alias("condition_score"),
        (F.col("doc_id") % 130).cast("string").alias("battery_pct"),
        F.when(F.col("toxic") == 1, F.array(F.lit("toxic language"), F.lit("check seller")))
         .otherwise(F.array().cast("array<string>")).alias("red_flags"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("summary"),
    ))


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured pages; the search is the language path segment, page from ``page=``."""
    p = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    page = F.regexp_extract("url", r"[?&]page=([0-9]+)", 1)
    return p.select(
        "page_id",
        F.regexp_extract("url", r"^[a-z]+://[^/]*/([a-z]{2})/", 1).alias("query"),
        F.when(page != "", page.try_cast("bigint")).otherwise(F.lit(1)).alias("page_num"),
        "url", F.expr(SP.HTML).alias("html"))


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured detail pages (see ``plans.splices``)."""
    return read_table(spark, sf_dir, "pages", "page_id", "url", "html").select("page_id", F.expr(SP.DETAIL_HTML).alias("html"))


def posts_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with a price score against their language's median length."""
    p = posts(spark, sf_dir)
    return score_against_market(p, market_report(p))


def catalog_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return score_against_market(c, market_report(c))


def stored_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review fields as a row store keeps them: flat columns, flags as JSON text
    (sometimes empty or malformed), condition sometimes 0/NULL."""
    lab = read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    d = read_table(spark, sf_dir, "documents", "doc_id", "lang")
    q, t = F.col("quality"), F.col("toxic")
    return lab.join(d, "doc_id").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("lang").alias("query"),
        F.when(q == 1, F.lit(8)).when(t == 1, F.lit(0)).cast("int").alias("condition_score"),
        (F.col("doc_id") % 101).cast("int").alias("battery_pct"),
        F.when(t == 1, F.lit("")).otherwise(F.concat(F.lit("quality "), q.cast("string")))
         .alias("ai_summary"),
        F.when(t == 1, F.lit('["toxic language", "check seller"]'))
         .when(q == 0, F.lit("not json")).when(q == 1, F.lit("[]")).alias("ai_red_flags"),
    )


HREFS_RE = r"<a\b[^>]*\shref=\"([^\"]*)\""
CDN_PREFIX = "https://images.finncdn.no/dynamic/"


def image_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per captured page, image candidates derived from its links (three rounds
    over them): each href becomes a CDN path with a width from the page id and
    position (some are thumbnails), every fourth one on a foreign host; the
    first one is the card's existing image."""
    p = read_table(spark, sf_dir, "pages", "page_id", "html")
    once = F.regexp_extract_all("html", F.lit(HREFS_RE), 1)
    hrefs = F.concat(once, once, once)
    pid = F.col("page_id")

    def cand(h, i):
        w = F.lit(40) + (pid * 7 + i * 13) % 400
        return F.struct(F.concat(F.when(i % 4 == 3, F.lit("https://evil.example.org/dynamic/")).otherwise(F.lit(CDN_PREFIX)), w.cast("string"), F.lit("x"), w.cast("string"),
                                 F.lit("c"), h).alias("src"), w.cast("int").alias("width"))

    c = p.select("page_id", F.transform(hrefs, cand).alias("candidates"))
    return c.withColumn("existing", F.when(F.size("candidates") > 0,
                                           F.array(F.col("candidates")[0]["src"]))
                        .otherwise(F.array().cast("array<string>")))
