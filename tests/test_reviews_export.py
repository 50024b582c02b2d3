"""Review sanitizing, stored reports, freshness, CSV/JSON export."""

import csv
import glob
import json
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pricelens import schemas
from pricelens.operators import assessments as AS
from pricelens.operators import searches as SE
from pricelens.sources import export as EX


def _raw(spark, rows):
    return spark.createDataFrame(rows, schemas.RAW_ASSESSMENTS)


def test_sanitize(spark):
    raw = _raw(spark, [("1", "q", "8", "150", [], "s"), ("2", "q", "15", "90", ["Scratch"], "ok"),
                       ("3", "q", "7", "84", ["a", "b"], "fine"), ("4", "q", "5", "0", [], "s"),
                       ("5", "q", "abc", None, [], ""), ("6", "q", "7", "x", [], "")])
    got = {r["id"]: (r["condition_score"], r["battery_pct"], r["red_flags"], r["summary"])
           for r in AS.sanitize_assessments(raw).collect()}
    assert got == {"1": (8, None, [], "s"), "2": (10, 90, ["Scratch"], "ok"),
                   "3": (7, 84, ["a", "b"], "fine"), "4": (5, None, [], "s")}


def test_long_numbers_and_decimals(spark):
    raw = _raw(spark, [("1", "q", "11111111111111111111", None, [], ""), ("2", "q", "7.5", "83.9", [], ""), ("3", "q", "-99999999999999999999", "1", [], ""), ("4", "q", "7.", None, [], "")])
    got = {r["id"]: (r["condition_score"], r["battery_pct"]) for r in AS.sanitize_assessments(raw).collect()}
    assert got == {"1": (10, None), "2": (7, 83), "3": (1, 1)}


def test_stored_reports(spark):
    df = spark.createDataFrame([("1", "q", None, None, "only summary", None),
                                ("2", "q", 0, 50, None, "not json"),
                                ("3", "q", None, None, "", None),
                                ("4", "q", 9, None, None, '["a", "b"]')],
                               "id string, query string, condition_score int, battery_pct int, "
                               "ai_summary string, ai_red_flags string")
    got = {r["id"]: r["ai_report"] for r in AS.stored_reports(df).collect()}
    assert got["1"]["condition_score"] == 5 and got["1"]["summary"] == "only summary"
    assert got["2"]["condition_score"] == 5 and got["2"]["red_flags"] == []
    assert got["3"] is None
    assert got["4"]["red_flags"] == ["a", "b"] and got["4"]["summary"] == ""


def test_freshness(spark):
    now = datetime(2026, 7, 1, 12, 0)
    df = spark.createDataFrame([("iphone 13", now - timedelta(hours=1), True),
                                ("old", datetime(2026, 1, 1), True),
                                ("gone", now, False)], "query string, scraped_at timestamp, is_active boolean")
    f = {r["query"]: r["fresh"] for r in SE.search_freshness(df, now, 6).collect()}
    assert f == {"iphone 13": True, "old": False}
    assert all(not r["fresh"] for r in SE.search_freshness(df, now, 0).collect())


def _export_df(spark):
    rows = [("1", "q", "=cmd|'/c calc'!A1", 5000, -5.0, 70.0, (8, 90, ["Small scratch", "No box"], "Ærlig"),
             "Oslo", "https://www.finn.no/item/1", datetime(2026, 7, 1, 12, 0)),
            ("2", "q", " iPhone  ", None, None, None, None, None, "https://www.finn.no/item/2",
             datetime(2026, 7, 1, 12, 0))]
    schema = ("id string, query string, title string, price_nok bigint, price_score double, "
              "composite_score double, ai_report struct<condition_score:int,battery_pct:int,"
              "red_flags:array<string>,summary:string>, location string, url string, scraped_at timestamp")
    return EX.export_rows(spark.createDataFrame(rows, schema))


def test_export_csv_round_trip(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "csv")
    EX.write_csv(_export_df(spark).coalesce(1), out)
    (part,) = glob.glob(os.path.join(out, "part-*.csv"))
    with open(part, newline="", encoding="utf-8") as f:
        got = {r["id"]: r for r in csv.DictReader(f)}
    assert got["1"]["title"] == "'=cmd|'/c calc'!A1"
    assert got["1"]["red_flags"] == "Small scratch; No box"
    assert got["1"]["ai_summary"] == "Ærlig"
    assert got["2"]["title"] == " iPhone  "
    assert got["2"]["red_flags"] == "" and got["2"]["condition_score"] == ""
    assert list(got["1"].keys()) == list(EX.EXPORT_COLUMNS)


def test_export_json_raw(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "json")
    EX.write_json(_export_df(spark).coalesce(1), out)
    (part,) = glob.glob(os.path.join(out, "part-*.json"))
    got = {r["id"]: r for r in map(json.loads, open(part, encoding="utf-8"))}
    assert got["1"]["title"] == "=cmd|'/c calc'!A1"
    assert got["2"]["red_flags"] is None and "condition_score" in got["2"]
    assert got["1"]["scraped_at"] == "2026-07-01T12:00:00+00:00"


def test_params_bounds_and_defaults():
    import pytest
    from pricelens.params import Params
    p = Params()
    assert (p.pages, p.ai_limit, p.min_price, p.cache_ttl_hours, p.retention_days) == (3, 5, 500, 6.0, 60)
    for bad in (dict(pages=0), dict(ai_limit=-1), dict(min_price=-1), dict(deals_limit=0)):
        with pytest.raises(ValueError):
            Params(**bad)
    assert Params(ai_limit=0, min_price=0).ai_limit == 0
