"""Captured result pages -> cards; scan dedupe and completeness; gallery."""

import os

from pyspark.sql import functions as F

from pricelens.sources import pages as PG

FIXTURE = os.path.join(os.path.dirname(__file__), "fixtures", "search_page.html")


def _pages(spark):
    html = open(FIXTURE, encoding="utf-8").read()
    return spark.createDataFrame([(1, "iphone 13", 1, "https://www.finn.no/s", html)],
                                 "page_id long, query string, page_num int, url string, html string")


def test_cards_from_snapshot(spark):
    cards = PG.page_cards(_pages(spark)).orderBy("pos").collect()
    got = [(r["id"], r["title"], r["price_nok"], r["location"], r["url"], r["image_urls"], r["description"]) for r in cards]
    assert got == [
        ("710000321", "Sykkel – 28″ herre", 3250, "Tromsø", "https://www.finn.no/recommerce/forsale/item/710000321",
         ["https://images.finncdn.no/dynamic/100x75c/p/sykkel.jpg"], "Lite brukt,\nnye dekk & gir"),
        ("55512345", "Kano, to seter", 1900, "Hamar, Innlandet", "https://www.finn.no/bap/forsale/ad.html?finnkode=55512345", [], ""),
        ("8800123", "Ski", 700, "Molde", "https://www.finn.no/bap/8800123", [], ""),
    ]


def _cards(spark, html):
    df = spark.createDataFrame([(1, "q", 1, "u", html)], "page_id long, query string, page_num int, url string, html string")
    return PG.page_cards(df).orderBy("pos").collect()


def test_nested_texts_are_whole(spark):
    (r,) = _cards(spark, '<article><a href="/bap/1234567"><h2>A</h2></a><div data-testid="price"><div><b>5</b> 500</div> kr</div>'
                         '<div data-testid="location"><svg></svg><span>Oslo</span></div></article>')
    assert (r["price_nok"], r["location"]) == (5500, "Oslo")


def test_page_without_articles(spark):
    got = _cards(spark, '<main><a href="/recommerce/forsale/item/1111111"><h2>En</h2><span>10 kr</span></a>'
                        '<a id="bap-2" href="/bap/2222222">To</a><a href="/om">Om oss</a></main>')
    assert [(r["id"], r["title"], r["price_nok"]) for r in got] == [("1111111", "En", 10), ("2222222", "To", None)]


def test_null_and_broken_pages(spark):
    assert _cards(spark, None) == [] and _cards(spark, "") == []
    assert [r["id"] for r in _cards(spark, "<article><a href='/bap/7654321'><h2>T" + "<b>" * 3000)] == ["7654321"]


def test_detail_rules(spark):
    long = "Kjøpt ny i fjor og lite brukt siden."
    pages = [
        (1, f'<div data-testid="description"><p>{long}</p></div><dl><dt>Sted</dt><dd>Bodø<br>8000</dd></dl>'),
        (2, f'<div data-testid="description">kort</div><div class="x whitespace-pre-wrap">{long}</div><span data-testid="location">Oslo</span>'),
        (3, f"<section><h2>Full beskrivelse</h2><div><div>{long}</div></div></section><table><tr><th>Sted</th><td>Alta</td></tr></table>"),
        (4, f"<div><h3>beskrivelse av varen</h3>{long}</div><p data-testid='object-address'></p><div><div>Sted</div><div>Voss\nmer</div></div>"),
        (5, "<p>ingenting</p>"), (6, None)]
    got = {r["page_id"]: (r["detail_description"], r["detail_location"]) for r in PG.detail_fields(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    assert got == {1: (long, "Bodø"), 2: (long, "Oslo"), 3: (long, "Alta"), 4: (long, "Voss mer"), 5: ("", None), 6: ("", None)}


def test_offsite_and_script_links_rejected(spark):
    html = ('<article><a href="javascript:alert(1)"><h2>A</h2></a></article>'
            '<article><a href="https://evil.com/x"><h2>B</h2></a></article>'
            '<article><a href="/recommerce/forsale/item/123456789">Link text title</a></article>')
    df = spark.createDataFrame([(1, "q", 1, "u", html)], "page_id long, query string, page_num int, url string, html string")
    got = [(r["id"], r["title"]) for r in PG.page_cards(df).collect()]
    assert got == [("123456789", "Link text title")]


def test_scan_dedupe_and_completeness(spark):
    cards = spark.createDataFrame([
        ("s1", "a", 1, 0), ("s1", "b", 1, 1), ("s1", "a", 2, 0), ("s1", "b", 3, 0), ("s1", "c", 3, 1),
        ("s2", "x", 1, 0), ("s2", "y", 2, 0)], "scan_id string, id string, page_num int, pos int")
    loaded = spark.createDataFrame([("s1", 1), ("s1", 2), ("s1", 3), ("s2", 1), ("s2", 2), ("s2", 3)],
                                   "scan_id string, page_num int")
    comp = {r["scan_id"]: (r["complete"], r["stop_page"]) for r in PG.scan_completeness(cards, loaded).collect()}
    assert comp == {"s1": (True, 2), "s2": (True, 3)}
    d = PG.dedupe_scan(cards, PG.scan_completeness(cards, loaded))
    assert sorted((r["scan_id"], r["id"]) for r in d.collect()) == [("s1", "a"), ("s1", "b"), ("s2", "x"), ("s2", "y")]


def test_failed_page_is_skipped_not_empty(spark):
    cards = spark.createDataFrame([("s", "a", 1, 0), ("s", "b", 3, 0)], "scan_id string, id string, page_num int, pos int")
    loaded = spark.createDataFrame([("s", 1), ("s", 3)], "scan_id string, page_num int")  # page 2 failed
    r = PG.scan_completeness(cards, loaded).collect()[0]
    assert (r["complete"], r["stop_page"]) == (False, 3)


def test_gallery_fold(spark):
    up = "https://images.finncdn.no/dynamic/960x720c/"
    cands = [("https://images.finncdn.no/dynamic/220x220c/a.jpg", 800),   # taken, upgraded
             ("https://images.finncdn.no/dynamic/100x100c/b.jpg", 50),    # thumbnail
             ("", 800),                                                  # blank
             ("https://evil.com/dynamic/220x220c/c.jpg", 800),            # not allowed
             ("https://images.finncdn.no/dynamic/960x720c/a.jpg", 0),     # already seen (upgraded form)
             ("https://images.finncdn.no/static/d.jpg", None)]            # no size, width unknown
    df = spark.createDataFrame([(["https://images.finncdn.no/static/e.jpg"], cands)],
                               "existing array<string>, c array<struct<src:string,width:int>>")
    got = df.select(PG.gallery(F.col("existing"), F.col("c"))).collect()[0][0]
    assert got == [up + "a.jpg", "https://images.finncdn.no/static/d.jpg"]
    none = spark.createDataFrame([(["keep.jpg"], [("https://evil.com/x.jpg", 800)])],
                                 "existing array<string>, c array<struct<src:string,width:int>>")
    assert none.select(PG.gallery(F.col("existing"), F.col("c"))).collect()[0][0] == ["keep.jpg"]


def test_detail_merge(spark):
    html = ('<html><div data-testid="description">Full description text that is long enough</div>'
            '<dl><dt>Sted</dt><dd>Trondheim<br>Sentrum</dd></dl></html>')
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    listings = spark.createDataFrame([(1, "short", None), ], "page_id long, description string, location string")
    r = PG.enrich_details(listings, PG.detail_fields(pages)).collect()[0]
    assert r["description"] == "Full description text that is long enough"
    assert r["location"] == "Trondheim"
    listings2 = spark.createDataFrame([(1, "short", "Oslo")], "page_id long, description string, location string")
    assert PG.enrich_details(listings2, PG.detail_fields(pages)).collect()[0]["location"] == "Oslo"


def test_single_quoted_attributes(spark):
    html = ("<article><a href='/recommerce/forsale/item/555666777'><h3>Pixel 8</h3></a>"
            "<span data-testid='price'>3 000 kr</span><span class='card-location'>Tromsø, Norge</span></article>")
    df = spark.createDataFrame([(1, "q", 1, "u", html)], "page_id long, query string, page_num int, url string, html string")
    r = PG.page_cards(df).collect()[0]
    assert (r["id"], r["title"], r["price_nok"], r["location"]) == ("555666777", "Pixel 8", 3000, "Tromsø, Norge")
