"""Every rule meets both its branches in the registered queries."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")

#: key -> conditions of which each must hold for some row
CASES = {
    "page_cards": ["location IS NULL", "location = 'Tromsø'", "location = 'Bergen'", "image_urls <> ''", "image_urls = ''", "title LIKE 'Søker –%'", "price_nok > 1000"],
    "keyword_hits": ["positive_hits > 0", "negative_hits > 0", "positive_hits = 0 AND negative_hits = 0"],
    "battery_pct": ["battery_pct IS NOT NULL", "battery_match IS NOT NULL AND battery_pct IS NULL", "battery_match IS NULL"],
    "listing_display": ["storage = '128 GB'", "storage = '64 GB'", "storage = '—'", "battery_display IS NOT NULL"],
    "listing_id": ["listing_id RLIKE '^[0-9]+$'", "listing_id LIKE 'http%'"],
    "page_links": ["listing_id RLIKE '^[0-9]+$'", "safe_url IS NULL", "safe_url IS NOT NULL"],
    "safe_image_urls": ["allowed", "NOT allowed", "kept IS NULL"],
    "review_worklist": ["n_images > 0", "n_images = 0"],
    "enrich_details": ["location = 'Bodø'", "location = 'Alta'", "location IS NULL", "description_len < 40"],
    "search_freshness": ["fresh", "NOT fresh"],
    "export_rows": ["title LIKE '''=SUM%'", "title NOT LIKE '''%'", "scraped_at IS NOT NULL"],
    "gallery_images": ["n_images = 8", "n_images < 8", "n_candidates > n_images"],
    "page_scan_scoring": ["rank IS NOT NULL", "rank IS NULL"],
    "sanitize_assessments": ["condition_score = 10", "condition_score = 7", "condition_score = 1"],
}


@pytest.mark.parametrize("key", sorted(CASES))
def test_branches(spark, key):
    got = E.queries()[key](spark, SF).agg(*[F.max(F.coalesce(F.expr(c), F.lit(False))).alias(str(i)) for i, c in enumerate(CASES[key])]).collect()[0]
    assert all(got), [c for c, hit in zip(CASES[key], got, strict=True) if not hit]


def test_scores_differ(spark):
    for key in ("composite_scores", "select_candidates"):
        assert E.queries()[key](spark, SF).select("composite_score").distinct().count() > 3
