"""Registered queries: key -> ``(spark, sf_dir) -> DataFrame``.

Every key reads the driver's tables through ``sources.standins`` so its work
grows with the data; the oracle twin of each key is in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricelens.operators import history as H
from pricelens.operators import market as M
from pricelens.plans import splices as SP
from pricelens.sources import standins as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _history(spark, sf):
    return H.price_changes(S.obs(spark, sf))


# --- history ---------------------------------------------------------------

@register("price_changes")
def q_price_changes(spark, sf):
    return _history(spark, sf)


@register("latest_price")
def q_latest_price(spark, sf):
    return H.latest_price(_history(spark, sf))


def _history_prev(spark, sf):
    return H.price_changes(S.obs(spark, sf), keep_previous=True)


@register("price_drops")
def q_price_drops(spark, sf):
    return H.price_drops(_history_prev(spark, sf), S.listings_base(spark, sf))


@register("top_price_drops")
def q_top_price_drops(spark, sf):
    return H.price_drops(_history_prev(spark, sf), S.listings_base(spark, sf), limit=10)


@register("price_history_changes")
def q_price_history_changes(spark, sf):
    return H.step_changes(_history(spark, sf))


@register("listing_histories")
def q_listing_histories(spark, sf):
    return H.listing_histories(_history(spark, sf), S.listings_base(spark, sf))


# --- market ----------------------------------------------------------------

@register("market_report")
def q_market_report(spark, sf):
    return M.market_report(S.market_big(spark, sf))


@register("catalog_report")
def q_catalog_report(spark, sf):
    return M.market_report(S.catalog(spark, sf))


# --- scoring / relevance / text -------------------------------------------

from pyspark.sql import functions as F  # noqa: E402

from pricelens.functions import text as TX  # noqa: E402
from pricelens.operators import relevance as R  # noqa: E402
from pricelens.operators import scoring as SC  # noqa: E402
from pricelens.plans import keyparams as KP  # noqa: E402
from pricelens.sources.tables import read_table  # noqa: E402


@register("price_scores")
def q_price_scores(spark, sf):
    return M.cheapest_first(S.catalog_scored(spark, sf)).select(
        "query", "id", "price_nok", "price_score")


@register("composite_scores")
def q_composite_scores(spark, sf):
    return SC.best_first(SC.score_listings(S.posts_scored(spark, sf)).select(
        "id", "query", "price_score", "composite_score"))


@register("keyword_hits")
def q_keyword_hits(spark, sf):
    return SC.keyword_hits(S.posts(spark, sf))


@register("battery_pct")
def q_battery_pct(spark, sf):
    return SC.battery_pct(S.posts(spark, sf))


@register("market_percentiles")
def q_market_percentiles(spark, sf):
    return M.percentiles(M.price_frequencies(S.posts(spark, sf)), [0, 10, 25, 50, 75, 90, 100])


@register("select_candidates")
def q_select_candidates(spark, sf):
    return M.select_candidates(S.listings_v(spark, sf), KP.CANDIDATE_LIMIT).select(
        "query", "id", "rank", "price_nok", "price_score", "composite_score")


@register("relevant_listings")
def q_relevant_listings(spark, sf):
    return R.relevant_listings(S.catalog(spark, sf), KP.CATALOG_MIN_PRICE,
                               KP.CATALOG_TERMS).select("query", "id", "title", "price_nok")


@register("filter_stats")
def q_filter_stats(spark, sf):
    return R.filter_stats(S.catalog(spark, sf), KP.CATALOG_MIN_PRICE, KP.CATALOG_TERMS)


@register("relevant_posts")
def q_relevant_posts(spark, sf):
    return R.relevant_listings(S.posts(spark, sf), KP.POSTS_MIN_PRICE).select(
        "query", "id", "price_nok")


@register("deal_bands")
def q_deal_bands(spark, sf):
    return SC.deal_bands(S.listings_v(spark, sf)).select("id", "query", "price_score", "price_band")


@register("listing_display")
def q_listing_display(spark, sf):
    return SC.listing_display(S.posts(spark, sf))


@register("normalize_query")
def q_normalize_query(spark, sf):
    d = read_table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", TX.normalize_query("text").alias("normalized"))


@register("parse_price")
def q_parse_price(spark, sf):
    d = read_table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", TX.parse_price("text").alias("price_nok"))


@register("listing_id")
def q_listing_id(spark, sf):
    p = read_table(spark, sf, "pages", "page_id", "url")
    return p.select("page_id", TX.listing_id_from_url(F.expr(SP.LISTING_URL)).alias("listing_id"))


# --- table maintenance -----------------------------------------------------

from pricelens.operators import tables as TB  # noqa: E402

_UPSERT_COLS = ("id", "query", "title", "price_nok", "url", "scraped_at", "description",
                "price_score", "composite_score", "is_active")


def _upserted(spark, sf):
    return TB.upsert_listings(S.table_before(spark, sf), S.last_scan_batch(spark, sf))


@register("upsert_listings")
def q_upsert_listings(spark, sf):
    return _upserted(spark, sf).select(*_UPSERT_COLS)


@register("deactivate_missing")
def q_deactivate_missing(spark, sf):
    return TB.deactivated(S.table_before(spark, sf), _upserted(spark, sf)).select(*_UPSERT_COLS)


@register("append_history")
def q_append_history(spark, sf):
    return TB.append_history(S.history_before(spark, sf), S.last_scan_batch(spark, sf)).select(
        "listing_id", "query", "price", "seen_at", "seq")


@register("prune_listings")
def q_prune_listings(spark, sf):
    return TB.prune_listings(S.listings_base(spark, sf), KP.NOW, KP.RETENTION_DAYS).select(
        "id", "query", "price_nok", "scraped_at", "is_active")


@register("prune_history")
def q_prune_history(spark, sf):
    return TB.prune_history(_history(spark, sf), S.listings_base(spark, sf), KP.NOW, KP.RETENTION_DAYS)


@register("prune_counts")
def q_prune_counts(spark, sf):
    return TB.prune_counts(_history(spark, sf), S.listings_base(spark, sf), KP.NOW, KP.RETENTION_DAYS)


# --- read models -----------------------------------------------------------

from pricelens.operators import assessments as AS  # noqa: E402
from pricelens.operators import searches as SE  # noqa: E402
from pricelens.sources import export as EX  # noqa: E402


@register("saved_searches")
def q_saved_searches(spark, sf):
    return SE.saved_searches(S.listings_base(spark, sf))


@register("search_freshness")
def q_search_freshness(spark, sf):
    l = S.listings_base(spark, sf)  # finer searches, so that some are stale
    l = l.withColumn("query", F.concat("query", F.lit("/"), (F.col("id").cast("long") % 50).cast("string")))
    return SE.search_freshness(l, KP.NOW, KP.CACHE_TTL_HOURS)


@register("best_deals")
def q_best_deals(spark, sf):
    return SE.best_deals(S.listings_v(spark, sf), KP.DEALS_LIMIT).select(
        "id", "query", "price_nok", "price_score")


@register("listings_by_query")
def q_listings_by_query(spark, sf):
    return SE.listings_by_query(S.listings_v(spark, sf), KP.EXPORT_QUERY).select(
        "id", "query", "price_nok", "price_score", "is_active")


# --- reviews ---------------------------------------------------------------

def _sanitized(spark, sf):
    return AS.sanitize_assessments(S.reviews(spark, sf))


def _reviewed_posts(spark, sf):
    """Scored posts with their sanitized review attached and rescored."""
    merged = AS.merge_assessments(S.posts_scored(spark, sf), _sanitized(spark, sf))
    return AS.rescore_reviewed(merged)


@register("sanitize_assessments")
def q_sanitize_assessments(spark, sf):
    return _sanitized(spark, sf).withColumn("red_flags", F.array_join("red_flags", "; "))


@register("merge_assessments")
def q_merge_assessments(spark, sf):
    m = AS.merge_assessments(S.posts_scored(spark, sf), _sanitized(spark, sf))
    return m.select("id", "query", "price_score",
                    F.col("ai_report.condition_score").alias("condition_score"),
                    F.col("ai_report.battery_pct").alias("battery_pct"))


@register("rescore_reviewed")
def q_rescore_reviewed(spark, sf):
    return _reviewed_posts(spark, sf).select(
        "id", "query", F.col("ai_report.battery_pct").alias("battery_pct"), "composite_score")


@register("top_reviewed")
def q_top_reviewed(spark, sf):
    return SE.top_reviewed(_reviewed_posts(spark, sf), KP.CANDIDATE_LIMIT).select(
        "query", "id", "rank", "composite_score")


@register("review_worklist")
def q_review_worklist(spark, sf):
    scored = SC.score_listings(S.posts_scored(spark, sf))
    cand = M.select_candidates(scored, KP.CANDIDATE_LIMIT)
    image = lambda i: F.when(i % 3 == 1, F.lit("https://images.finncdn.no/a.jpg")).when(i % 3 == 2, F.lit("http://images.finncdn.no/b.jpg")).otherwise(F.lit("https://evil.example.org/c.jpg"))
    cand = cand.withColumn("image_urls", F.filter(F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 12).cast("int")), lambda i: F.when(i > 0, image(i))), lambda u: u.isNotNull()))
    return AS.review_worklist(cand).select("id", "query", "title", "price_nok", "location", "description",
                                           F.size("images").alias("n_images"))


@register("stored_reports")
def q_stored_reports(spark, sf):
    r = AS.stored_reports(S.stored_flat(spark, sf))
    return r.select("id", "query", F.col("ai_report").isNotNull().alias("has_report"),
                    F.col("ai_report.condition_score").alias("condition_score"),
                    F.col("ai_report.battery_pct").alias("battery_pct"),
                    F.array_join("ai_report.red_flags", "; ").alias("red_flags"),
                    F.col("ai_report.summary").alias("summary"))


@register("json_arrays")
def q_json_arrays(spark, sf):
    f = S.stored_flat(spark, sf)
    arr = F.coalesce(F.from_json(F.col("ai_red_flags"), "array<string>"),
                     F.array().cast("array<string>"))
    return f.select("id", "query", F.size(arr).alias("n_flags"),
                    F.to_json(arr).alias("flags_json"))


@register("condition_bands")
def q_condition_bands(spark, sf):
    return SC.deal_bands(_reviewed_posts(spark, sf).select(
        "id", "query", "price_score", F.col("ai_report.condition_score").alias("condition_score")),
        "condition_score")


# --- export ----------------------------------------------------------------

def _export_source(spark, sf):
    return (_reviewed_posts(spark, sf)
            .withColumn("url", F.concat(F.lit("https://www.finn.no/item/"), F.col("id")))
            .withColumn("scraped_at", F.expr("TIMESTAMP_SECONDS(1704067200 + doc_id * 60)")))


@register("export_rows")
def q_export_rows(spark, sf):
    return EX.guard_csv(EX.export_rows(_export_source(spark, sf)))


@register("export_json_rows")
def q_export_json_rows(spark, sf):
    return EX.export_rows(_export_source(spark, sf))


# --- pages / URLs / scans --------------------------------------------------

from pricelens.functions import text as TXT  # noqa: E402
from pricelens.functions import urls as U  # noqa: E402
from pricelens.sources import pages as PG  # noqa: E402


@register("page_cards")
def q_page_cards(spark, sf):
    return PG.page_cards(S.captured(spark, sf)).select(
        "page_id", "query", "page_num", "pos", "id", "title", "price_nok", "url", "location",
        F.array_join("image_urls", " ").alias("image_urls"), "description")


@register("page_links")
def q_page_links(spark, sf):
    return PG.page_links(S.captured(spark, sf))


@register("safe_urls")
def q_safe_urls(spark, sf):
    p = read_table(spark, sf, "pages", "page_id", "url")
    return p.select("page_id", "url", U.url_scheme("url").alias("scheme"),
                    U.url_host("url").alias("host"),
                    U.safe_listing_url("url", KP.PAGE_HOSTS_EXACT, KP.PAGE_HOST_SUFFIXES)
                    .alias("safe_url"))


@register("safe_image_urls")
def q_safe_image_urls(spark, sf):
    l = PG.page_links(S.captured(spark, sf))
    return l.select("page_id", "pos", "abs_url",
                    U.image_url_allowed("abs_url").alias("allowed"),
                    F.get(F.filter(F.array("abs_url"), lambda u: U.image_url_allowed(u)), F.lit(0))
                    .alias("kept"))


@register("image_url_upgrade")
def q_image_url_upgrade(spark, sf):
    c = S.image_candidates(spark, sf).select(
        "page_id", F.posexplode("candidates").alias("pos", "c"))
    return c.select("page_id", "pos", F.col("c.src").alias("src"),
                    TXT.upgrade_image_url(F.col("c.src")).alias("upgraded"))


@register("gallery_images")
def q_gallery_images(spark, sf):
    c = S.image_candidates(spark, sf).select("page_id", F.size("candidates").alias("n_candidates"),
                                             PG.gallery(F.col("existing"), F.col("candidates")).alias("gallery"))
    return c.select("page_id", "n_candidates", F.size("gallery").alias("n_images"), F.array_join("gallery", " ").alias("images"))


@register("enrich_details")
def q_enrich_details(spark, sf):
    posts_src = read_table(spark, sf, "documents", "doc_id", "lang", "text", "source").select(
        F.col("doc_id").alias("page_id"), F.col("doc_id").cast("string").alias("id"),
        F.col("lang").alias("query"), F.col("text").alias("description"),
        F.col("source").alias("location"))
    posts_src = posts_src.withColumn("location", F.when(F.col("page_id") % 2 == 0, F.col("location")))  # some cards have none
    e = PG.enrich_details(posts_src, PG.detail_fields(S.detail_pages(spark, sf)))
    return e.select("id", "query", F.length("description").alias("description_len"), "location")


def _scan_cards(spark, sf):
    o = S.obs(spark, sf)
    return o.select(F.concat("query", F.lit("@"), F.col("scan_day").cast("string")).alias("scan_id"),
                    "id", (F.hour("scraped_at") + 1).cast("int").alias("page_num"),
                    F.col("seq").alias("pos"), "price_nok")


@register("scan_complete")
def q_scan_complete(spark, sf):
    cards = _scan_cards(spark, sf)
    return PG.scan_completeness(cards, cards.select("scan_id", "page_num"))


@register("dedupe_scan")
def q_dedupe_scan(spark, sf):
    cards = _scan_cards(spark, sf)
    comp = PG.scan_completeness(cards, cards.select("scan_id", "page_num"))
    return PG.dedupe_scan(cards, comp)


# --- streaming twins -------------------------------------------------------

from pricelens.streaming import feed as FD  # noqa: E402


@register("scan_activity")
def q_scan_activity(spark, sf):
    return FD.scan_activity(S.obs(spark, sf))


# --- end-to-end scan flow --------------------------------------------------

from pricelens.params import Params  # noqa: E402
from pricelens.plans.search_job import score_pages, score_scan  # noqa: E402


@register("scan_scoring")
def q_scan_scoring(spark, sf):
    res = score_scan(S.last_scan_batch(spark, sf).drop("price_score", "composite_score"),
                     Params(min_price=KP.OBS_MIN_PRICE, ai_limit=KP.CANDIDATE_LIMIT))
    return res.listings.select("id", "query", "seq", "price_nok", "price_score",
                               "composite_score", "rank")


@register("page_scan_scoring")
def q_page_scan_scoring(spark, sf):
    """Captured pages to scored listings, candidates enriched from detail pages."""
    res, complete = score_pages(S.captured(spark, sf), Params(pages=KP.SCAN_PAGES, ai_limit=KP.CANDIDATE_LIMIT),
                                PG.detail_fields(S.detail_pages(spark, sf)))
    return res.listings.join(complete, "query").select(
        "query", "id", "page_num", "title", "price_nok", "price_score", "composite_score", "rank", "location",
        F.length("description").cast("int").alias("description_len"), "complete")


@register("deep_scan_scoring")
def q_deep_scan_scoring(spark, sf):
    """The same as a deep scan: every kept listing is enriched before the report and the scores."""
    params = Params(pages=KP.SCAN_PAGES, ai_limit=KP.CANDIDATE_LIMIT, deep_scan=True)
    res, complete = score_pages(S.captured(spark, sf), params, PG.detail_fields(S.detail_pages(spark, sf)))
    return res.listings.join(complete, "query").select(
        "query", "id", "page_num", "title", "price_nok", "price_score", "composite_score", "rank", "location",
        F.length("description").cast("int").alias("description_len"), "complete")


# --- timestamps as text ----------------------------------------------------

from pricelens.functions import times as TM  # noqa: E402


@register("timestamp_text")
def q_timestamp_text(spark, sf):
    """Event times written as a row store keeps them (ISO text; every other
    row with an explicit +00:00 offset) and read back; naive text is UTC."""
    e = read_table(spark, sf, "events", "event_id", "ts")
    text = F.concat(TM.iso_text("ts"), F.when(F.col("event_id") % 2 == 0, F.lit("+00:00"))
                    .otherwise(F.lit("")))
    return e.select("event_id", text.alias("ts_text"),
                    F.unix_micros(TM.parse_iso_timestamp(text)).alias("epoch_us"))


@register("drops_for_query")
def q_drops_for_query(spark, sf):
    """Drops of one search.  History is per (id, query), so filtering the
    observations first is equivalent and lets the filter reach the scan."""
    q = F.col("query") == KP.EXPORT_QUERY
    hist = H.price_changes(S.obs(spark, sf).filter(q), keep_previous=True)
    return H.price_drops(hist, S.listings_base(spark, sf), query=KP.EXPORT_QUERY)
