"""The scan flow: filter, score, pick candidates, attach reviews, rescore."""

from pricelens import schemas
from pricelens.params import Params
from pricelens.plans.search_job import score_scan
from tests.helpers import batch, listing


def test_scan_flow(spark):
    items = [listing(1, 5000, title="iPhone 13", description="batterikapasitet 100%"),
             listing(2, 5200, title="iPhone 13 pent brukt"),
             listing(3, 100, title="iPhone 13"),                 # below min price
             listing(4, 4800, title="Deksel til iPhone 13"),     # accessory
             listing(5, 5400, title="iPhone 13", query="IPHONE  13 "),  # same search after normalising
             listing(1, 4900, title="iPhone 13")]                # second sighting of 1: ignored
    cards = batch(spark, items).drop("price_score", "composite_score", "ai_report")
    raw = spark.createDataFrame([("1", "iphone 13", "8", "40", ["dent"], "ok"),
                                 ("5", "iphone 13", "x", None, [], "")], schemas.RAW_ASSESSMENTS)
    res = score_scan(cards, Params(min_price=500, ai_limit=2), raw)
    rep = res.report.collect()
    assert [(r["query"], r["count"], r["median"]) for r in rep] == [("iphone 13", 3, 5200.0)]
    got = {r["id"]: r for r in res.listings.collect()}
    assert sorted(got) == ["1", "2", "5"]
    assert got["1"]["price_nok"] == 5000
    # candidate 1 was reviewed with battery 40: 40*0.3 = 12 instead of 30 from the text
    no_review = score_scan(cards, Params(min_price=500, ai_limit=2)).listings
    before = {r["id"]: r["composite_score"] for r in no_review.collect()}
    assert abs(got["1"]["composite_score"] - (before["1"] - 18.0)) < 1e-9
    assert got["2"]["composite_score"] == before["2"]
    assert sorted(r["id"] for r in res.candidates.collect()) == sorted(
        i for i, r in got.items() if r["rank"] is not None)


def test_keyword_lists_are_parameters(spark):
    cards = batch(spark, [listing(1, 5000, description="zzz og yyy"), listing(2, 5200)]).drop("price_score", "composite_score", "ai_report")
    score = lambda p: {r["id"]: r["composite_score"] for r in score_scan(cards, p).listings.collect()}
    plain = score(Params())
    assert score(Params(positive_keywords=("zzz",)))["1"] == plain["1"] + 2.5
    assert score(Params(negative_keywords=("yyy",)))["1"] == plain["1"] - 6.0
    assert score(Params(positive_keywords=(), negative_keywords=())) == plain


def test_page_scan(spark):
    from pricelens.plans.search_job import score_pages

    card = lambda n, price: f'<article><a href="/bap/{1000000 + n}"><h2>Sykkel {n}</h2></a><span>{price} kr</span><p>kort</p></article>'
    html = {1: card(1, 1000) + card(2, 2000), 2: card(2, 9000) + card(3, 3000), 3: card(1, 1000), 4: card(4, 1500)}
    pages = spark.createDataFrame([(n, "Sykkel ", n, h) for n, h in html.items()], "page_id long, query string, page_num long, html string")
    details = spark.createDataFrame([(1, "Pent brukt med kvittering og mye annet", "Oslo")], "page_id long, detail_description string, detail_location string")
    res, complete = score_pages(pages, Params(pages=4, ai_limit=2), details)
    assert [tuple(r) for r in complete.collect()] == [("sykkel", True)]
    got = {r["id"]: r for r in res.listings.collect()}
    assert {i: r["price_nok"] for i, r in got.items()} == {"1000001": 1000, "1000002": 2000, "1000003": 3000}
    rich = [r for r in got.values() if r["description"] != "kort"]
    assert rich and all(r["rank"] is not None and r["location"] == "Oslo" for r in rich)
    _, partial = score_pages(pages, Params(pages=2), details)
    assert partial.collect()[0]["complete"] is False


def test_deep_scan_enriches_before_the_candidates_are_chosen(spark):
    from pyspark.sql import functions as F

    items = [listing(i, p, title="iPhone 13", description="kort") for i, p in ((1, 5000), (2, 5100), (3, 5200), (4, 4000))]
    cards = batch(spark, items).drop("price_score", "composite_score", "ai_report").withColumn("page_id", F.col("id").cast("long"))
    details = spark.createDataFrame([(3, "som ny, pent brukt, batterikapasitet 100% og kvittering", "Oslo"), (4, "defekt skjerm og batteri 60%", None), (2, "", "Bergen")],
                                    "page_id long, detail_description string, detail_location string")
    fast, deep = (score_scan(cards, Params(ai_limit=1, deep_scan=d), details=details) for d in (False, True))
    assert [r.id for r in fast.candidates.collect()] == ["4"] and [r.id for r in deep.candidates.collect()] == ["3"]
    text = {r.id: (r.description, r.location) for r in deep.listings.collect()}
    assert text["3"][1] == "Oslo" and text["4"][0].startswith("defekt") and text["2"] == ("kort", "Bergen") and text["1"][0] == "kort"
    assert {r.id for r in fast.listings.collect() if r.description != "kort"} == {"4"}
    assert fast.report.collect() == deep.report.collect()


def test_dry_run_writes_nothing(spark, tmp_path):
    from pricelens.api import Tracker

    cards = batch(spark, [listing(1, 5000), listing(2, 5200)]).drop("price_score", "composite_score", "ai_report")
    t = Tracker(spark, str(tmp_path / "store"), buckets=2)
    assert t.search(cards, "s1", persist=False).listings.count() == 2
    assert not (tmp_path / "store").exists() or not any((tmp_path / "store").rglob("*.parquet"))
