"""The tracker commands end to end on a store."""

import glob
import os
from datetime import datetime, timedelta

from pricelens.api import Tracker
from pricelens.params import Params
from tests.conftest import T0, T1
from tests.helpers import batch, listing


def _cards(spark, items):
    return batch(spark, items).drop("price_score", "composite_score", "ai_report")


def test_tracker_commands(spark, tmpdir_path):
    t = Tracker(spark, os.path.join(tmpdir_path, "store"), Params(min_price=500, ai_limit=2), buckets=8)
    now = T1 + timedelta(hours=1)
    t.search(_cards(spark, [listing(111, 5000, query="iPhone 13"), listing(222, 7000, query="iPhone 13"),
                            listing(333, 6000, query="iPhone 13")]), "s1", now=now)
    t.search(_cards(spark, [listing(111, 4000, T1, query="iphone  13"), listing(222, 7500, T1, query="iphone 13"),
                            listing(333, 6000, T1, query="iphone 13")]), "s2", now=now)
    assert [r["listing_id"] for r in t.drops().collect()] == ["111"]
    assert [r["id"] for r in t.deals(limit=1, query="IPHONE 13").collect()] == ["111"]
    h = t.history("111").collect()
    assert [(r["price"], r["change_pct"]) for r in h] == [(5000, None), (4000, -20.0)]
    assert [(r["query"], r["n_active"]) for r in t.saved_searches().collect()] == [("iphone 13", 3)]
    assert t.cached("iPhone 13", now=now + timedelta(hours=12)) is None and t.cached("unknown", now=now) is None
    report, top = t.cached("iPhone 13", now=now)
    assert report.collect()[0]["count"] == 3
    out = os.path.join(tmpdir_path, "export")
    t.export("iphone 13", out)
    assert len(glob.glob(os.path.join(out, "part-*.csv"))) >= 1


def test_retry_after_a_failed_upsert(spark, tmpdir_path, monkeypatch):
    from pricelens.operators import tables as TB

    t = Tracker(spark, os.path.join(tmpdir_path, "store"), Params(min_price=None))
    t.search(_cards(spark, [listing(1, 5000)]), "a", now=T1)
    with monkeypatch.context() as m:
        def fail(*a, **k):
            raise RuntimeError("lost")
        m.setattr(TB, "upsert_listings", fail)
        try:
            t.search(_cards(spark, [listing(1, 4000, T1)]), "b", now=T1)
        except RuntimeError:
            pass
    t.search(_cards(spark, [listing(1, 4000, T1)]), "b", now=T1)
    t.search(_cards(spark, [listing(1, 4000, T1)]), "b", now=T1)
    assert [r["price"] for r in t.history("1").collect()] == [5000, 4000]


def test_search_from_pages(spark, tmpdir_path):
    card = lambda n, price: f'<article><a href="/bap/{1000000 + n}"><h2>Sykkel {n}</h2></a><span>{price} kr</span></article>'
    schema = "page_id long, query string, page_num long, html string"
    t = Tracker(spark, os.path.join(tmpdir_path, "store"), Params(pages=3))
    t.search_pages(spark.createDataFrame([(1, "Sykkel", 1, card(1, 1000) + card(2, 2000)), (2, "Sykkel", 2, card(1, 1000))], schema), "p1", now=T0)
    t.search_pages(spark.createDataFrame([(1, "Sykkel", 1, card(1, 900)), (2, "Sykkel", 2, "<p>")], schema), "p2", now=T1)
    got = {r["id"]: (r["price_nok"], r["is_active"]) for r in t.listings().collect()}
    assert got == {"1000001": (900, True), "1000002": (2000, False)}
    assert [r["price"] for r in t.history("1000001").collect()] == [1000, 900]
