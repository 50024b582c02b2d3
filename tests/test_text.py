"""Text and URL helpers."""

from pricelens.functions import text as TX
from pricelens.functions import urls as U


def _map(spark, fn, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(fn("v")).collect()]


def test_normalize_query(spark):
    assert _map(spark, TX.normalize_query, ["\u00a0Elsykkel \t 26\"", "GROSSE  Tür", "groß\nKajakk ", ""]) == \
        ["elsykkel 26\"", "grosse tür", "gross kajakk", ""]


def test_parse_price(spark):
    got = _map(spark, TX.parse_price, ["ca 24.500,- inkl. frakt", "pris: 7\u00a0800", "950", "3\u20092", "byttes", None, "12345678901234567890123", "9223372036854775807 kr"])
    assert got == [24500, 7800, 950, None, None, None, None, 9223372036854775807]


def test_listing_id(spark):
    got = _map(spark, TX.listing_id_from_url, [
        "https://m.finn.no/ad?x=1&finnkode=77001", "https://www.finn.no/bap/1234567/?ref=mail", "https://www.finn.no/bap/12345", None])
    assert got == ["77001", "1234567", "https://www.finn.no/bap/12345", None]


def test_image_upgrade(spark):
    got = _map(spark, TX.upgrade_image_url, ["https://a.finncdn.no/dynamic/48x36/k.webp", "https://a.finncdn.no/dynamic/large/k.webp",
                                             "https://a.finncdn.no/dynamic/9x9b/1/dynamic/8x8/k.webp"])
    assert got == ["https://a.finncdn.no/dynamic/960x720c/k.webp", "https://a.finncdn.no/dynamic/large/k.webp",
                   "https://a.finncdn.no/dynamic/960x720c/1/dynamic/8x8/k.webp"]


def test_image_allowlist(spark):
    cases = {
        "https://finn.no/a.png": True, "https://pics.finncdn.no:443/a.png": True, "https://user@img.finn.no/a": True, "HtTpS://IMG.FINN.NO/a": True,
        "http://img.finn.no/a.png": False, "https://finncdn.no.attacker.test/a": False, "https://myfinn.no/a": False, "https://finn.no@attacker.test/a": False,
        "https://10.1.2.3/a": False, "https://[::1]/a": False, "ftp://img.finn.no/a": False, "//img.finn.no/a": False, "blob:https://finn.no/1": False, "finn.no/a": False}
    assert _map(spark, U.image_url_allowed, list(cases)) == list(cases.values())
    assert _map(spark, U.image_url_allowed, [None, " "]) == [False, False]


def test_listing_urls(spark):
    cases = {"https://finn.no/bap/1": True, "http://m.finn.no/ad?finnkode=1": True, "https://finn.no.shop.test/bap/1": False, "vbscript:x": False,
             "file://finn.no/etc": False, "https://shop.test/?u=https://finn.no/bap/1": False}
    assert _map(spark, U.safe_listing_url, list(cases)) == [u if ok else None for u, ok in cases.items()]


def test_absolute_url(spark):
    got = _map(spark, U.absolute_url, ["/bap/x", "//cdn.finn.no/a", "https://x.no/y", "rel/z",
                                       "javascript:alert(1)"])
    assert got == ["https://www.finn.no/bap/x", "https://cdn.finn.no/a", "https://x.no/y",
                   "https://www.finn.no/rel/z", "javascript:alert(1)"]


def test_display_helpers(spark):
    assert _map(spark, TX.storage_of, ["iPhone 13 128GB", "256 gb black", "x128GB", None]) == \
        ["128 GB", "256 GB", None, None]
    assert _map(spark, TX.city_of, ["Oslo, Norge", " Bergen ", None, ""]) == ["Oslo", "Bergen", "—", "—"]
    assert _map(spark, TX.format_price, [12345, 0, None, 9007199254740993], "bigint") == ["12 345 kr", "—", "—", "9 007 199 254 740 993 kr"]
    assert _map(spark, TX.py_strip, ["\n a \t", "　b "]) == ["a", "b"]
