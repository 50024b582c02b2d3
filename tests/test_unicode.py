"""Case folds and digits equal Python's over every code point."""

import sys
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from pricelens.functions import text as TX
from pricelens.functions import unicode as U


def test_every_code_point(spark):
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    blocks = [chars[i:i + 500] for i in range(0, len(chars), 500)]
    d = spark.createDataFrame(pd.DataFrame({"n": range(len(blocks)), "c": ["\u001e".join(b) for b in blocks]}))
    got = {r.n: r for r in d.select("n", U.casefold(F.col("c")).alias("fold"), U.ascii_digits(F.col("c")).alias("digits")).collect()}
    for n, b in enumerate(blocks):
        assert got[n].fold == "\u001e".join(b).casefold()
        assert got[n].digits == "\u001e".join(str(unicodedata.digit(c)) if unicodedata.category(c) == "Nd" else c for c in b)


def test_queries_and_prices(spark):
    rows = ["STRASSE Stra\u00dfe", " \u0130stanbul\u00a0 \u03a3\u0391\u03a3 ", "\ufb01ne \u1e9e", "Plain  ASCII", "\u0149 \u01f0"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "q string").select(TX.normalize_query("q")).collect()]
    assert got == [" ".join(x.split()).casefold() for x in rows]
    prices = [("\u0661\u0662 \u0663\u0664\u0665 kr", 12345), ("kr \uff11.\uff12\uff10\uff10", 1200), ("1 299 kr", 1299), ("Gis bort", None)]
    got = [r[0] for r in spark.createDataFrame(prices, "t string, n long").select(TX.parse_price("t")).collect()]
    assert got == [n for _, n in prices]
    assert spark.createDataFrame([("batteri \u0668\u0667 %",)], "t string").select(TX.battery_from_text("t")).first()[0] == 87
