"""Physical plan shape of the operators that matter at scale."""

import os
import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _exchanges(df) -> list[tuple[str, str]]:
    """(keys, columns carried) of every hash exchange."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: hashpartitioning\((.*?), \d+\)", text)


def test_candidates_limit_before_shuffle(spark):
    p = _plan(E.queries()["select_candidates"](spark, SF))
    assert p.count("WindowGroupLimit") == 2 and "Partial" in p and "Expand" not in p


@pytest.mark.parametrize("key", ["composite_scores", "export_rows", "upsert_listings", "scan_scoring", "price_scores"])
def test_wide_rows_are_not_dealt_by_search_alone(spark, key):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = _exchanges(E.queries()[key](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert found
    for columns, keys in found:
        if re.fullmatch(r"query#\d+", keys):
            assert not re.search(r"\b(text|description|title|url)#", columns), (key, columns)


def test_report_preaggregates(spark):
    p = _plan(E.queries()["market_report"](spark, SF))
    # quartiles come from bands: partial sums by search and band, no buffer of a search's prices
    assert "partial_count" in p and "partial_sum(cnt" in p and "_band" in p and "percentile" not in p
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_extendedprice:double>" in p


def test_change_detection_splits_a_hot_listing_by_day(spark):
    df = E.queries()["price_changes"](spark, SF)
    assert "rangepartitioning" not in _plan(df)
    full = [keys for columns, keys in _exchanges(df) if "price" in columns and "_last" not in columns and "max#" not in columns]
    assert len(full) == 1 and "_day" in full[0]


def test_latest_price_is_an_aggregate(spark):
    p = _plan(E.queries()["latest_price"](spark, SF))
    assert "partial_max" in p
    assert "Window [row_number" not in p


def test_scans_are_pruned(spark):
    p = _plan(E.queries()["saved_searches"](spark, SF))
    assert "value:double" in p  # price kept for the filter-free state, ids, time
    for col in ("props",):
        assert f"{col}:" not in p
    p = _plan(E.queries()["keyword_hits"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in p and "n_chars" not in p


def test_page_links_stay_in_codegen(spark):
    p = _plan(E.queries()["page_links"](spark, SF))
    assert re.search(r"\*\(\d+\) Generate posexplode", p)
