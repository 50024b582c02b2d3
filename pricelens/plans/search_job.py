"""One scan, end to end, as a single lazy plan (the search command).

captured pages -> cards -> first sighting and completeness -> normalised
search -> relevance filter -> market report -> price score -> composite score
-> review candidates -> their detail pages -> rescore -> attach sanitized
reviews -> rescore.  Persisting is ``ListingStore.apply_scan`` on the scored
listings (with the scan's completeness).  Shuffles: the report (by search, on a
price-count table), the candidate top-k (partial limit before the shuffle),
and one join by listing key each for ranks, details and reviews.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions.scoring import with_composite_score
from pricelens.functions.text import normalize_query
from pricelens.operators import assessments as AS
from pricelens.operators import market as M
from pricelens.operators import relevance as R
from pricelens.params import Params
from pricelens.sources import pages as PG


def first_sighting(cards: DataFrame, order: str = "seq") -> DataFrame:
    """One row per ``(id, query)``: the first one by ``order`` (partial aggregate)."""
    rest = [c for c in cards.columns if c not in ("id", "query", order)]
    return (cards.groupBy("id", "query").agg(F.min(F.struct(order, *rest)).alias("_f"))
            .select("id", "query", "_f.*"))


@dataclass
class ScanResult:
    report: DataFrame       # one row per search
    listings: DataFrame     # every kept listing, scored; candidates enriched and rescored; rank of candidates
    candidates: DataFrame   # top-k per search with rank


def _scored(df: DataFrame, params: Params, reviewed_battery=None) -> DataFrame:
    return with_composite_score(df, reviewed_battery=reviewed_battery, positive=params.positive_keywords, negative=params.negative_keywords)


def _rescored(df: DataFrame, params: Params, when, reviewed_battery=None) -> DataFrame:
    """The composite score computed anew where ``when`` holds, kept elsewhere."""
    new = _scored(df.withColumnRenamed("composite_score", "_old"), params, reviewed_battery)
    return new.withColumn("composite_score", F.when(when, F.col("composite_score")).otherwise(F.col("_old"))).drop("_old")


def score_scan(cards: DataFrame, params: Params = Params(), raw_reviews: DataFrame | None = None,
               details: DataFrame | None = None) -> ScanResult:
    """Score the cards of a scan; ``details`` (page_id, detail_description,
    detail_location) enrich the candidates only, whose score is then computed
    from the full text; in a deep scan (``params.deep_scan``) they enrich every
    kept listing before the report, so that all scores and the choice of the
    candidates rest on the full texts."""
    c = first_sighting(cards.withColumn("query", normalize_query("query")))
    kept = R.relevant_listings(c, params.min_price, params.blacklist)
    if details is not None and params.deep_scan:
        kept = PG.enrich_details(kept, details)
    report = M.market_report(kept)
    scored = _scored(M.score_against_market(kept, report), params)
    cands = M.select_candidates(scored, params.ai_limit, params.suspicious_threshold)
    scored = scored.join(cands.select("id", "query", "rank"), ["id", "query"], "left")
    candidate = F.col("rank").isNotNull()
    if details is not None and not params.deep_scan:
        rich = PG.enrich_details(scored.withColumn("_card", F.struct("description", "location")), details)
        for name in ("description", "location"):
            rich = rich.withColumn(name, F.when(candidate, F.col(name)).otherwise(F.col(f"_card.{name}")))
        scored = _rescored(rich.drop("_card"), params, candidate)
    if raw_reviews is not None:
        merged = AS.merge_assessments(scored, AS.sanitize_assessments(raw_reviews))
        report_of = F.when(candidate, F.col("ai_report"))
        scored = _rescored(merged.withColumn("ai_report", report_of), params, F.col("ai_report").isNotNull(), F.col("ai_report.battery_pct"))
    return ScanResult(report, scored, cands)


def scan_pages(pages: DataFrame, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Cards of the first ``params.pages`` captured pages of each search, one row
    per listing, and ``(query, complete)``."""
    loaded = pages.where(F.col("page_num") <= params.pages).withColumn("query", normalize_query("query"))
    cards = PG.page_cards(loaded, params.allowed_exact_hosts, params.allowed_host_suffixes)
    cards = cards.withColumn("scan_id", F.col("query"))
    complete = PG.scan_completeness(cards, loaded.select(F.col("query").alias("scan_id"), "page_num"))
    first = PG.dedupe_scan(cards, complete)
    first = first.withColumn("seq", F.shiftleft(F.col("page_num").cast("bigint"), 32) + F.col("pos")).drop("scan_id", "pos")
    return first, complete.select(F.col("scan_id").alias("query"), "complete")


def score_pages(pages: DataFrame, params: Params = Params(), details: DataFrame | None = None,
                raw_reviews: DataFrame | None = None) -> tuple[ScanResult, DataFrame]:
    """``score_scan`` from captured pages, and each search's completeness."""
    cards, complete = scan_pages(pages, params)
    return score_scan(cards, params, raw_reviews, details), complete
