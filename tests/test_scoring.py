"""Composite score, battery rule, relevance filter, keyword hits, bands."""

from pyspark.sql import functions as F

from pricelens.functions import scoring as SC
from pricelens.functions import text as TX
from pricelens.operators import relevance as R


def _score(spark, rows):
    df = spark.createDataFrame(rows, "title string, description string, price_score double, rb int")
    return [r[0] for r in df.select(SC.composite_score("title", "description", "price_score",
                                                       F.col("rb"))).collect()]


def test_battery_rule(spark):
    df = spark.createDataFrame([("batterikapasitet 87%",), ("batteri 100 %",), ("30% rabatt",),
                                ("ingen info",), ("30% rabatt, batteri 90%",)], "t string")
    assert [r[0] for r in df.select(TX.battery_from_text("t")).collect()] == [87, 100, None, None, None]


def test_reviewed_battery_wins(spark):
    ai60, text100 = _score(spark, [("iPhone 13", "batterikapasitet 100%", 0.0, 60),
                                   ("iPhone 13", "batterikapasitet 100%", 0.0, None)])
    assert ai60 < text100


def test_low_reviewed_battery_honored(spark):
    low, none = _score(spark, [("iPhone 13", "", 0.0, 40), ("iPhone 13", "", 0.0, None)])
    assert low < none


def test_good_beats_bad_and_bounds(spark):
    good, bad, neutral = _score(spark, [
        ("iPhone 13 pent brukt", "Som ny, batterikapasitet 95%. Original eske og kvittering. " + "x" * 200, -30.0, None),
        ("iPhone 13", "Knust skjerm, selges som den er.", 30.0, None),
        ("iPhone 13", "", None, None)])
    assert good > bad
    for s in (good, bad, neutral):
        assert 0 <= s <= 100
    assert neutral == 20.0 + 18.0 + 11.0


def test_exact_formula(spark):
    # price 20 - 0.5*-30 = 35; battery 95*0.3 = 28.5; content 15 + 2.5*4 ("pent brukt",
    # "som ny", "original eske", "kvittering") + 3 (long text) = 28 -> 91.5
    (s,) = _score(spark, [("iPhone 13 pent brukt",
                           "Som ny, batterikapasitet 95%. Original eske og kvittering. " + "x" * 200,
                           -30.0, None)])
    assert s == 91.5


def test_relevance(spark):
    titles = ["Deksel til iPhone 13", "Lader til iPhone", "Panzerglass skjermbeskytter",
              "Kjøper iPhone 13", "Ønsker å kjøpe iPhone", "iPhone 13 128GB eller 256GB",
              "Salg av iPhone 14 Pro", "iPhone 13 Pro Max 256GB", "KJØPER iphone", "TILBEHØR pakke",
              "xønsker å kjøpe", "Laderen følger med"]
    df = spark.createDataFrame([(t, 3000) for t in titles], "title string, price_nok bigint")
    kept = [r[0] for r in R.relevant_listings(df).collect()]
    assert kept == ["iPhone 13 128GB eller 256GB", "Salg av iPhone 14 Pro", "iPhone 13 Pro Max 256GB",
                    "xønsker å kjøpe", "Laderen følger med"]


def test_min_price(spark):
    df = spark.createDataFrame([("a", 200), ("b", 800), ("c", None)], "title string, price_nok bigint")
    assert sorted(r[0] for r in R.relevant_listings(df, 500).collect()) == ["b", "c"]
    assert R.relevant_listings(df, None).count() == 3


def test_filter_stats(spark):
    df = spark.createDataFrame([("q", "iPhone 13", 3000), ("q", "Deksel til iPhone", 3000),
                                ("q", "iPhone", 100)], "query string, title string, price_nok bigint")
    r = R.filter_stats(df, 500).collect()[0]
    assert (r["n_in"], r["dropped_blacklist"], r["dropped_price"], r["n_kept"]) == (3, 1, 1, 1)


def test_keywords_are_substrings(spark):
    df = spark.createDataFrame([("feilfri som ny ",)], "t string")
    pos = SC.keyword_hits(F.col("t"), ("som ny", "ny "))
    neg = SC.keyword_hits(F.col("t"), ("feil",))
    assert df.select(pos, neg).collect()[0] == (2, 1)


def test_bands(spark):
    df = spark.createDataFrame([(-20.0, 9), (-10.0, 6), (0.0, 2), (10.0, None), (20.0, 8), (None, 5)],
                               "ps double, cs int")
    got = [tuple(r) for r in df.select(SC.price_band("ps"), SC.condition_band("cs")).collect()]
    assert got == [("well_below", "good"), ("below", "fair"), ("near", "poor"), ("above", None),
                   ("well_above", "good"), ("unscored", "fair")]


def test_rounding_half_even(spark):
    from pricelens.functions.numeric import py_round
    df = spark.createDataFrame([(62.25,), (2.675,), (0.125,)], "x double")
    assert [r[0] for r in df.select(py_round(F.col("x"), 1)).collect()][0] == 62.2
    assert [r[0] for r in df.select(py_round(F.col("x"), 2)).collect()][1:] == [2.67, 0.12]


def test_each_text_rule_runs_once_a_row(spark):
    d = spark.createDataFrame([("iphone", "batteri 91%", -3.0)], "title string, description string, price_score double")
    plan = SC.with_composite_score(d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1 and plan.count("lower(") == 1


def test_staged_score_equals_the_expression(spark):
    rows = [("iPhone", "som ny og pent brukt, batteri 87%", -12.5, None), ("x", "defekt 30% rabatt " * 20, 40.0, 55), (None, None, None, None), ("a", " \n", 3.3, 0), ("b", "100 %", -99.0, 101), ("c", "49% 90%", 0.0, None)]
    d = spark.createDataFrame(rows, "title string, description string, price_score double, battery int")
    for rb in (None, "battery"):
        want = [r[0] for r in d.select(SC.composite_score("title", "description", "price_score", rb)).collect()]
        assert [r.composite_score for r in SC.with_composite_score(d, reviewed_battery=rb).collect()] == want
