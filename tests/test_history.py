"""The lag in pieces equals a per-key window, also for a hot key."""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pricelens.operators import history as H
from pricelens.sources import standins as S

SF = "/root/testdata/sf0.1"


def _reference_lag(df):
    w = Window.partitionBy("listing_id", "query").orderBy("seen_at", "seq")
    return df.withColumn("_prev", F.lag("price").over(w))


def test_hot_key_spans_partitions(spark):
    # one key with 3000 rows (most of the data), a few small keys around it
    rows = [("hot", "q", (i * 7919) % 13 + 1, i, i) for i in range(3000)]
    rows += [(f"k{j}", "q", j % 3 + 1, j, 10000 + j) for j in range(200)]
    rows += [("a", "q", 5, 1, 20000), ("zz", "q", 6, 1, 20001)]
    df = spark.createDataFrame(rows, "listing_id string, query string, price long, t long, seq long")
    df = df.withColumn("seen_at", F.timestamp_seconds("t")).drop("t")
    df = df.withColumn("seen_at", F.expr("seen_at + make_interval(0, 0, 0, CAST(seq % 40 AS INT))"))
    want = _reference_lag(df)
    for conf in ({}, {"spark.sql.exchange.reuse": "false", "spark.sql.adaptive.enabled": "false"}):
        old = {k: spark.conf.get(k) for k in conf}
        try:
            for k, v in conf.items():
                spark.conf.set(k, v)
            got = H.previous_value(df, ["listing_id", "query"], ["seen_at", "seq"], "price")
            assert got.count() == want.count()
            assert got.exceptAll(want.select(*got.columns)).count() == 0
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_equal_to_a_plain_window_at_scale_without_reuse(spark):
    o = H.observations_to_history(S.obs(spark, SF))
    want = _reference_lag(o)
    for conf in ({"spark.sql.exchange.reuse": "false"}, {"spark.sql.adaptive.enabled": "false"}):
        try:
            for k, v in conf.items():
                spark.conf.set(k, v)
            got = H.previous_value(o, ["listing_id", "query"], ["seen_at", "seq"], "price")
            assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()
        finally:
            for k in conf:
                spark.conf.set(k, "true")


def test_a_third_of_all_rows_inside_one_hour(spark):
    # the hot key: 30 000 rows in one hour, several a second and some in one microsecond; a null time, equal rows
    hot = spark.range(30_000).selectExpr("'hot' AS listing_id", "'q' AS query", "id * 7919 % 13 AS price",
                                         "timestamp_micros(1767225600000000 + id DIV 3 * 360007) AS seen_at", "id AS seq")
    cold = spark.range(60_000).selectExpr("'k' || id % 700 AS listing_id", "'q' AS query", "id % 5 AS price",
                                          "timestamp_micros(1767225600000000 + id * 9000000000) AS seen_at", "id AS seq")
    odd = spark.sql("SELECT 'odd' AS listing_id, 'q' AS query, p AS price, CAST(t AS TIMESTAMP) AS seen_at, s AS seq FROM VALUES "
                    "(5L, NULL, 1L), (6L, '2026-01-01 00:00:00', 1L), (6L, '2026-01-01 00:00:00', 1L), (NULL, '2026-01-01 00:00:00.5', 2L), (7L, '2026-01-02', 3L) AS v(p, t, s)")
    df = hot.unionByName(cold).unionByName(odd)
    got = H.previous_value(df, ["listing_id", "query"], ["seen_at", "seq"], "price")
    want = _reference_lag(df)
    assert got.count() == want.count() == 90_005
    assert got.exceptAll(want).count() == 0
    # what one task of the row-level window orders: pieces of the hot key are small and fall evenly on 20 tasks
    dealt = (df.repartition(20, "listing_id", "query", F.date_trunc("second", "seen_at")).groupBy(F.spark_partition_id().alias("p")).count())
    most, middle = dealt.agg(F.max("count"), F.percentile("count", 0.5)).first()
    assert most < 2 * middle


def test_no_window_over_the_rows_of_a_key_or_day(spark):
    h = H.observations_to_history(S.obs(spark, SF))
    plan = H.previous_value(h, ["listing_id", "query"], ["seen_at", "seq"], "price")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [lag(price" in line]
    assert len(windows) == 1 and "_second" in windows[0].rsplit("], [", 2)[1]


def test_one_full_size_shuffle(spark):
    plan = H.price_changes(S.obs(spark, SF))._jdf.queryExecution().sparkPlan().toString()
    assert "RangePartitioning" not in plan and "rangepartitioning" not in plan


def test_few_rows(spark):
    df = spark.createDataFrame([("a", "q", 1, 1), ("a", "q", 2, 2), ("b", "q", 3, 3)],
                               "listing_id string, query string, price long, seq long")
    df = df.withColumn("seen_at", F.timestamp_seconds("seq"))
    got = H.previous_value(df, ["listing_id", "query"], ["seen_at", "seq"], "price")
    assert sorted((r["listing_id"], r["price"], r["_prev"]) for r in got.collect()) == \
        [("a", 1, None), ("a", 2, 1), ("b", 3, None)]


def test_change_only_rule(spark):
    df = spark.createDataFrame(
        [("1", "q", 100, 1), ("1", "q", 100, 2), ("1", "q", 0, 3), ("1", "q", 90, 4), ("1", "q", 100, 5),
         ("2", "q", None, 1)],
        "id string, query string, price_nok long, seq long").withColumn("scraped_at", F.timestamp_seconds("seq"))
    got = [(r["listing_id"], r["price"]) for r in H.price_changes(df).orderBy("seq").collect()]
    assert got == [("1", 100), ("1", 90), ("1", 100)]
