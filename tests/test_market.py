"""Market report, percentile rule, price score and candidate selection."""

from pyspark.sql import functions as F

from pricelens.operators import market as M


def _l(spark, prices, query="q", composite=None):
    data = [(str(i), query, p, (composite[i] if composite else None)) for i, p in enumerate(prices)]
    return spark.createDataFrame(data, "id string, query string, price_nok bigint, composite_score double")


def test_report_values_and_scores(spark):
    l = _l(spark, [100, 200, 300, None])
    r = M.market_report(l).collect()[0]
    assert (r["count"], r["mean"], r["median"], r["min_price"], r["max_price"]) == (3, 200.0, 200.0, 100, 300)
    assert abs(r["std"] - 81.649658) < 1e-6
    scored = M.cheapest_first(M.score_against_market(l, M.market_report(l)))
    assert [x["price_score"] for x in scored.collect()] == [-50.0, 0.0, 50.0, None]


def test_median_resists_outlier(spark):
    l = _l(spark, [100, 110, 120, 10000])
    r = M.market_report(l).collect()[0]
    assert r["median"] == 115.0
    s = M.score_against_market(l, M.market_report(l)).filter("price_nok = 100").collect()[0]
    assert s["price_score"] == -13.04


def test_empty_market_is_zeros(spark):
    r = M.market_report(_l(spark, [None, 0])).collect()[0]
    assert (r["count"], r["mean"], r["median"], r["std"], r["min_price"], r["p25"]) == (0, 0.0, 0.0, 0.0, 0, 0.0)


def test_single_price(spark):
    r = M.market_report(_l(spark, [7])).collect()[0]
    assert (r["count"], r["median"], r["std"], r["p25"], r["p75"]) == (1, 7.0, 0.0, 7.0, 7.0)


def test_percentile_rule(spark):
    f = M.price_frequencies(_l(spark, [1, 2, 3, 4, 5]))
    q = f.groupBy("query").agg(F.percentile("price", [0.0, 0.5, 1.0], F.col("cnt")).alias("q"))
    assert q.collect()[0]["q"] == [1.0, 3.0, 5.0]
    r = M.market_report(_l(spark, [10, 20, 30, 40])).collect()[0]
    assert (r["p25"], r["p75"]) == (17.5, 32.5)


def test_suspicious_price_skipped(spark):
    l = _l(spark, [10, 100, 110, 120])
    scored = M.score_against_market(l, M.market_report(l))
    c = M.select_candidates(scored, 2).orderBy("rank").collect()
    assert [x["price_nok"] for x in c] == [100, 110]


def test_all_suspicious_falls_back(spark):
    data = [("a", "q", 1, -80.0, None), ("b", "q", 2, -70.0, None), ("c", "q", 3, None, None)]
    df = spark.createDataFrame(data, "id string, query string, price_nok bigint, price_score double, composite_score double")
    c = M.select_candidates(df, 5).orderBy("rank").collect()
    assert [x["id"] for x in c] == ["a", "b"]


def test_composite_order_when_present(spark):
    data = [("a", "q", 1, -10.0, 50.0), ("b", "q", 2, -5.0, 80.0), ("c", "q", 3, 0.0, None),
            ("d", "r", 1, 5.0, None), ("e", "r", 1, -5.0, None)]
    df = spark.createDataFrame(data, "id string, query string, price_nok bigint, price_score double, composite_score double")
    got = [(x["query"], x["id"], x["rank"]) for x in M.select_candidates(df, 2).orderBy("query", "rank").collect()]
    assert got == [("q", "b", 1), ("q", "a", 2), ("r", "e", 1), ("r", "d", 2)]


def test_percentile_reference_rule(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 4), ("a", 5), ("b", 7), ("c", None)],
                               "query string, price_nok bigint").withColumn("id", F.lit("x"))
    got = {r["query"]: (r["p0"], r["p50"], r["p100"], r["p10"])
           for r in M.percentiles(M.price_frequencies(df), [0, 50, 100, 10]).collect()}
    # k = 4 * 0.1 = 0.4 -> 1*(1-0.4) + 2*0.4
    assert got == {"a": (1.0, 3.0, 5.0, 1 * (1 - 0.4) + 2 * (0.4 - 0)), "b": (7.0, 7.0, 7.0, 7.0),
                   "c": (0.0, 0.0, 0.0, 0.0)}


def test_truthiness_of_prices(spark):
    from pricelens.operators import history as H
    l = _l(spark, [100, 200, 300, -50, 0])
    r = M.market_report(l).collect()[0]
    assert (r["count"], r["median"]) == (3, 200.0)          # only positive prices count
    s = {x["price_nok"]: x["price_score"] for x in M.score_against_market(l, M.market_report(l)).collect()}
    assert s[-50] == -125.0 and s[0] is None               # any non-zero price is scored
    obs = spark.createDataFrame([("1", "q", -50, 1), ("1", "q", 0, 2), ("1", "q", -50, 3)],
                                "id string, query string, price_nok bigint, seq long") \
        .withColumn("scraped_at", F.timestamp_seconds("seq"))
    assert [x["price"] for x in H.price_changes(obs).collect()] == [-50]


def test_one_junk_price_stops_no_report(spark):
    junk = 999_999_999_999_999_999
    rows = [("q", 1000)] * 150 + [("q", junk), ("other", 100), ("other", 300), ("max", 2**63 - 1), ("max", 2**63 - 1)]
    got = {r["query"]: r for r in M.market_report(spark.createDataFrame(rows, "query string, price_nok long")).collect()}
    assert (got["other"]["mean"], got["other"]["std"], got["other"]["median"]) == (200.0, 100.0, 200.0)
    assert got["q"]["median"] == 1000.0 and got["q"]["count"] == 151 and got["q"]["max_price"] == junk
    prices = [1000] * 150 + [junk]
    mean = sum(prices) / 151
    assert abs(got["q"]["std"] / (sum((p - mean) ** 2 for p in prices) / 151) ** 0.5 - 1) < 1e-9
    assert got["max"]["count"] == 2 and got["max"]["std"] < 1e12


def test_selection_through_bands_equals_sorted_prices(spark, monkeypatch):
    """Prices in one band, in many, and above all bands; the same with narrow bands."""
    import random

    rng = random.Random(4)
    prices = {"one": [rng.randrange(1, 900) for _ in range(301)], "many": [rng.randrange(1, 1 << 40) for _ in range(200)],
              "junk": [rng.choice([3, 5, 10 ** 17, 9 * 10 ** 18]) for _ in range(50)], "single": [7], "none": [None, 0]}
    d = spark.createDataFrame([(q, p) for q, x in prices.items() for p in x], "query string, price_nok long")
    for bits in (21, 4):
        monkeypatch.setattr(M, "BAND_BITS", bits)
        got = {r["query"]: r for r in M.market_report(d).collect()}
        for q, x in prices.items():
            x = sorted(p for p in x if p)
            for name, share in (("p25", 0.25), ("median", 0.5), ("p75", 0.75)):
                k = (len(x) - 1) * share if x else 0
                lo = int(k)
                want = 0.0 if not x else x[lo] * (lo + 1 - k) + x[min(lo + 1, len(x) - 1)] * (k - lo)
                assert abs(got[q][name] - want) <= 1e-12 * max(1.0, want), (q, name)
    plan = M.market_report(d)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
