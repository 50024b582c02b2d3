"""Deal scoring expressions: price score, keyword hits, composite score, bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelens.functions.numeric import clamp, py_round
from pricelens.functions.text import battery_digits, battery_from_text, battery_number, py_strip
from pricelens.params import NEGATIVE_KEYWORDS, POSITIVE_KEYWORDS


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def price_score(price, median) -> Column:
    """% above (+) or below (-) the market median, 2 decimals; NULL when the
    price is NULL or 0 (any other price is scored) or the median is not positive."""
    p, m = _c(price), _c(median)
    raw = (p.cast("double") - m) / m * F.lit(100.0)
    return F.when((p != 0) & (m > 0), py_round(raw, 2))


def score_text(title, description) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(_c(title), F.lit("")),
                               F.coalesce(_c(description), F.lit(""))))


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def keyword_hits(text: Column | str, words: Sequence[str]) -> Column:
    """How many of ``words`` occur in ``text`` as substrings (each at most once).

    With a column *name* the sum is one SQL expression (parsed once in the
    JVM instead of a few hundred driver round trips); the plan is the same."""
    if isinstance(text, str):
        body = " + ".join(f"CASE WHEN contains(`{text}`, {_sql_str(w)}) THEN 1 ELSE 0 END"
                          for w in words)
        return F.expr(f"({body or 0})")
    hits = F.lit(0)
    for w in words:
        hits = hits + F.when(F.contains(text, F.lit(w)), 1).otherwise(0)
    return hits


def _price_part(ps: Column) -> Column:
    return F.when(ps.isNull(), F.lit(20.0)).otherwise(clamp(F.lit(20.0) - ps * F.lit(0.5), 0.0, 40.0))


def _battery_part(battery: Column) -> Column:
    return F.when(battery.isNull(), F.lit(18.0)).otherwise(F.least(F.lit(30.0), battery.cast("double") * F.lit(0.30)))


def _content(text: Column | str, positive: Sequence[str], negative: Sequence[str]) -> Column:
    return (F.lit(15.0) + keyword_hits(text, positive).cast("double") * F.lit(2.5)
            - keyword_hits(text, negative).cast("double") * F.lit(6.0))


def _length_part(n: Column) -> Column:
    return F.when(n > 200, 3.0).when(n > 80, 1.5).when(n == 0, -4.0).otherwise(0.0)


def composite_score(title, description, price_score_col, reviewed_battery=None,
                    positive: Sequence[str] = POSITIVE_KEYWORDS,
                    negative: Sequence[str] = NEGATIVE_KEYWORDS) -> Column:
    """0-100 deal score as one expression; over a table ``with_composite_score``
    gives the same from staged columns, each computed once a row."""
    text = score_text(title, description)
    battery = battery_from_text(text)
    if reviewed_battery is not None:
        battery = F.coalesce(_c(reviewed_battery), battery)
    content = _content(text, positive, negative) + _length_part(F.length(py_strip(F.coalesce(_c(description), F.lit("")))))
    total = _price_part(_c(price_score_col)) + _battery_part(battery) + clamp(content, 0.0, 30.0)
    return py_round(F.least(F.lit(100.0), total), 1)


def price_band(ps) -> Column:
    """Market position of a price score; NULL when unscored."""
    s = _c(ps)
    return (F.when(s.isNull(), F.lit("unscored"))
            .when(s < -15, F.lit("well_below"))
            .when(s < -5, F.lit("below"))
            .when(s > 15, F.lit("well_above"))
            .when(s > 5, F.lit("above"))
            .otherwise(F.lit("near")))


def condition_band(cs) -> Column:
    s = _c(cs)
    return (F.when(s.isNull(), F.lit(None).cast("string"))
            .when(s >= 8, F.lit("good")).when(s >= 5, F.lit("fair")).otherwise(F.lit("poor")))


def with_composite_score(df, title="title", description="description", ps="price_score",
                         reviewed_battery=None, out: str = "composite_score",
                         positive: Sequence[str] = POSITIVE_KEYWORDS, negative: Sequence[str] = NEGATIVE_KEYWORDS):
    """Add the 0-100 deal score: price part (<=40) + battery part (<=30) + content (<=30).

    Every part that later parts use more than once is a column of an earlier
    projection (lower-cased text, battery match, keyword sum, total), so that
    each is computed once a row."""
    rb = _c(reviewed_battery) if reviewed_battery is not None else F.lit(None).cast("int")
    desc = F.coalesce(_c(description), F.lit(""))
    d = df.select("*", score_text(_c(title), _c(description)).alias("_score_text"), F.length(py_strip(desc)).alias("_desc_len"))
    d = d.select("*", battery_digits("_score_text").alias("_digits"), _content("_score_text", positive, negative).alias("_content"))
    d = d.select("*", battery_number("_digits").alias("_seen"))
    d = d.select("*", F.coalesce(rb, F.when(F.col("_seen").between(50, 100), F.col("_seen"))).alias("_battery"))
    d = d.select("*", (F.col("_content") + _length_part(F.col("_desc_len"))).alias("_text_part"))
    total = _price_part(_c(ps)) + _battery_part(F.col("_battery")) + clamp(F.col("_text_part"), 0.0, 30.0)
    d = d.select("*", F.least(F.lit(100.0), total).alias("_total"))
    keep = [c for c in df.columns if c != out]
    return d.select(*keep, py_round(F.col("_total"), 1).alias(out))
