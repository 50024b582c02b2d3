"""The commands of a price tracker over a ``ListingStore``.

Each method composes the operators; results are DataFrames (nothing is
collected), except the counts ``prune`` reports.

    t = Tracker(spark, "/shared/pricelens")
    res = t.search(cards, "2026-07-01T12:00", raw_reviews)   # score, persist, prune
    t.deals(limit=10, query="iphone 13")
    t.drops(limit=10)
    t.history("https://www.finn.no/recommerce/forsale/item/400111222")
    t.export("iphone 13", "/shared/out/iphone.csv")
"""

from __future__ import annotations

from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.functions.text import listing_id_from_url
from pricelens.operators import history as H
from pricelens.operators import market as M
from pricelens.operators import searches as SE
from pricelens.params import Params
from pricelens.plans.search_job import ScanResult, score_pages, score_scan
from pricelens.sources import export as EX
from pricelens.sources.store import ListingStore


def _normalized(spark: SparkSession, query: str) -> str:
    from pricelens.functions.text import normalize_query
    return spark.createDataFrame([(query,)], "q string").select(normalize_query("q")).first()[0]


class Tracker:
    def __init__(self, spark: SparkSession, root: str, params: Params = Params(), buckets: int = 64):
        self.spark = spark
        self.params = params
        self.store = ListingStore(spark, root, buckets)

    # -- write path ----------------------------------------------------------
    def search(self, cards: DataFrame, scan_id: str, raw_reviews: DataFrame | None = None,
               complete: bool = True, now: datetime | None = None, details: DataFrame | None = None, persist: bool = True) -> ScanResult:
        """Score one scan's cards, persist them (deactivating missing listings
        only when the scan was complete), then apply retention.  A search that
        failed is repeated with the same ``scan_id``.  ``details`` enrich the
        candidates, or every listing if ``params.deep_scan`` is set.  With
        ``persist=False`` (a dry run) nothing is written."""
        res = score_scan(cards, self.params, raw_reviews, details)
        return self._persist(res, scan_id, None if complete else F.lit(False), None, now) if persist else res

    def search_pages(self, pages: DataFrame, scan_id: str, details: DataFrame | None = None,
                     raw_reviews: DataFrame | None = None, now: datetime | None = None, persist: bool = True) -> ScanResult:
        """The same from captured pages: cards, first sightings and each
        search's completeness come from them."""
        res, complete = score_pages(pages, self.params, details, raw_reviews)
        return self._persist(res, scan_id, None, complete, now) if persist else res

    def _persist(self, res: ScanResult, scan_id: str, flag, complete: DataFrame | None, now: datetime | None) -> ScanResult:
        # The scored scan is used several times: stored once, read from there.
        path = f"{self.store.root}/scans/scan_id={quote(scan_id, safe='')}"
        rows = res.listings
        for name, kind in (("scraped_at", "timestamp"), ("image_urls", "array<string>")):
            if name not in rows.columns:
                rows = rows.withColumn(name, (F.lit(now) if name == "scraped_at" and now else F.current_timestamp() if name == "scraped_at" else F.lit(None)).cast(kind))
        if not self.store.applied(scan_id):
            rows.write.mode("overwrite").parquet(path)
        batch = self.spark.read.parquet(path)
        if flag is not None:
            complete = batch.select("query").distinct().withColumn("complete", flag)
        self.store.apply_scan(batch.drop("rank", "page_id", "page_num"), scan_id, complete)
        self.prune(now=now)
        return ScanResult(res.report, batch, res.candidates)

    def prune(self, days: int | None = None, now: datetime | None = None) -> list[tuple[str, int]]:
        days = self.params.retention_days if days is None else days
        return self.store.prune(now or datetime.now(timezone.utc), days)

    # -- read path -----------------------------------------------------------
    def listings(self) -> DataFrame:
        return self.store.read("listings")

    def deals(self, limit: int | None = None, query: str | None = None) -> DataFrame:
        q = _normalized(self.spark, query) if query else None
        return SE.best_deals(self.listings(), limit or self.params.deals_limit, q)

    def drops(self, limit: int | None = None, query: str | None = None) -> DataFrame:
        q = _normalized(self.spark, query) if query else None
        return H.price_drops(self.store.read("price_history"), self.listings(),
                             limit or self.params.drops_limit, q)

    def history(self, id_or_url: str) -> DataFrame:
        """Price points of a listing (code or URL) per search, with step changes."""
        lid = self.spark.createDataFrame([(id_or_url,)], "u string").select(
            listing_id_from_url("u")).first()[0]
        h = self.store.read("price_history").filter(F.col("listing_id") == lid)
        steps = H.step_changes(h).select("listing_id", "query", "seen_at", "seq", "change_pct")
        return (H.listing_histories(h, self.listings(), lid)
                .join(steps, ["listing_id", "query", "seen_at", "seq"])
                .orderBy("query", "seen_at", "seq"))

    def saved_searches(self) -> DataFrame:
        return SE.newest_first(self.store.summaries())

    def cached(self, query: str, now: datetime | None = None) -> tuple[DataFrame, DataFrame] | None:
        """The cached result of a search while it is fresh: its report from the
        stored active listings and the reviewed top.  None when the search is
        stale or unknown, so that it must be scanned again."""
        q = _normalized(self.spark, query)
        last = self.store.summaries().filter(F.col("query") == q).select("query", F.col("last_seen").alias("last_scan"))
        row = SE.with_freshness(last, now or datetime.now(timezone.utc), self.params.cache_ttl_hours).first()
        if row is None or not row["fresh"]:
            return None
        active = self.listings().filter((F.col("query") == q) & F.col("is_active"))
        return M.market_report(active), SE.top_reviewed(active, self.params.ai_limit)

    def export(self, query: str, path: str, fmt: str = "csv") -> None:
        rows = EX.export_rows(self.listings(), _normalized(self.spark, query))
        (EX.write_json if fmt == "json" else EX.write_csv)(rows, path)

    def compact(self) -> None:
        """Fold the stored scans into one base, in place."""
        self.store.compact()
