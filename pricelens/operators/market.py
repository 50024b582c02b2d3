"""Market report per search, price score against the median, candidates.

Scale notes
-----------
* The report is computed from a ``(query, price) -> count`` table built with
  a map-side partial aggregation, so a search holding a third of all rows
  shuffles one row per distinct price, never its raw rows.  The quartiles are
  selected from it through price bands, so no task takes a search's prices.
* Attaching the report to listings is a salted join (``operators.attach``):
  the rows of a hot search are dealt to many tasks.
* Candidate selection never runs a full window per search: it ranks narrow
  rows, and a top-k ``row_number() <= k`` filter lets Spark insert a partial
  WindowGroupLimit before the shuffle, so each search sends at most k rows per
  map task.  Wide columns are fetched for the k rows last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.numeric import py_round
from pricelens.functions.scoring import price_score
from pricelens.operators.attach import attach

#: Width (as a power of two) and number of the price bands of the selection.
BAND_BITS = 21
REPORT_COLUMNS = ("query", "count", "mean", "median", "std", "min_price", "max_price",
                  "p25", "p75")


def price_frequencies(listings: DataFrame, price_col: str = "price_nok") -> DataFrame:
    """``(query, price, cnt)``; unpriced rows (NULL or <= 0) keep ``price`` NULL so
    a search with no priced listing still appears."""
    p = F.col(price_col)
    return (listings.select("query", F.when(p > 0, p).alias("price"))
            .groupBy("query", "price").agg(F.count(F.lit(1)).alias("cnt")))


def market_report(listings: DataFrame, price_col: str = "price_nok") -> DataFrame:
    """count / mean / median / population std / min / max / P25 / P75 of priced
    listings per search; all zeros for a search with nothing priced."""
    f = price_frequencies(listings, price_col)
    priced_cnt = F.when(F.col("price").isNotNull(), F.col("cnt"))
    dec = "decimal(38,0)"
    agg = f.groupBy("query").agg(
        F.coalesce(F.sum(priced_cnt), F.lit(0)).cast("bigint").alias("n"),
        F.sum(F.col("price").cast(dec) * F.col("cnt")).alias("s1"),
        # NULL where a price is too large for the exact sum (see below)
        F.try_sum(F.try_multiply(F.try_multiply(F.col("price").cast(dec), F.col("price").cast(dec)), F.col("cnt").cast(dec))).alias("s2"),
        F.max(F.col("price").cast("double")).alias("_top"),
        F.sum(F.col("price").cast("double") * F.col("price").cast("double") * F.col("cnt").cast("double")).alias("s2_approx"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
    )
    agg = agg.join(_order_statistics(f, [25, 50, 75]), "query", "left")
    n = F.col("n")
    # The variance is exact in whole numbers while they fit 38 digits; one
    # advert with a junk price of 17 digits or more makes its own search's
    # variance approximate (doubles), and touches no other search.
    nd = n.cast("double")
    exact = F.try_subtract(F.try_multiply(n.cast(dec), F.col("s2")), F.try_multiply(F.col("s1"), F.col("s1"))).cast("double")
    exact = F.when(F.col("_top") < 1e16, exact)
    approx = F.greatest(F.lit(0.0), F.col("s2_approx") / nd - (F.col("s1").cast("double") / nd) * (F.col("s1").cast("double") / nd))
    std = F.sqrt(F.coalesce(exact / (nd * nd), approx))
    has = n > 0
    return agg.select(
        "query",
        n.alias("count"),
        F.when(has, F.col("s1").cast("double") / n.cast("double")).otherwise(0.0).alias("mean"),
        F.when(has, F.col("p50")).otherwise(0.0).alias("median"),
        F.when(n > 1, py_round(std, 6)).otherwise(0.0).alias("std"),
        F.coalesce(F.col("min_price"), F.lit(0)).cast("bigint").alias("min_price"),
        F.coalesce(F.col("max_price"), F.lit(0)).cast("bigint").alias("max_price"),
        F.when(has, F.col("p25")).otherwise(0.0).alias("p25"),
        F.when(has, F.col("p75")).otherwise(0.0).alias("p75"),
    )


def score_against_market(listings: DataFrame, report: DataFrame,
                         price_col: str = "price_nok", spread: str | None = None) -> DataFrame:
    """Add ``price_score``: % vs the search's median (NULL if unpriced)."""
    med = report.select("query", F.col("median").alias("_median"))
    out = attach(listings, med, "query", spread or ("id" if "id" in listings.columns else price_col))
    keep = [c for c in listings.columns if c != "price_score"]
    return out.select(*keep, price_score(F.col(price_col), F.col("_median")).alias("price_score"))


def cheapest_first(scored: DataFrame) -> DataFrame:
    """Cheapest first, unscored last; ties by (query, id)."""
    return scored.orderBy(F.col("price_score").asc_nulls_last(), "query", "id")


def select_candidates(scored: DataFrame, limit: int, suspicious: float = -60.0) -> DataFrame:
    """Top ``limit`` review candidates per search.

    Candidates are scored listings above ``suspicious`` (strictly); when a
    search has none, all its scored listings.  They are ordered by composite
    score (NULL as 0) descending if any candidate has one, else by price score
    ascending; ties fall back to price score, then id.

    One partial aggregate per search tells whether a safe listing exists and
    whether a candidate has a composite score; it is attached to the narrow
    rows, which are then ranked once.
    """
    ps, cs = F.col("price_score"), F.col("composite_score")
    narrow = scored.filter(ps.isNotNull()).select("id", "query", "price_score", "composite_score")
    safe = ps > suspicious
    flags = narrow.groupBy("query").agg(
        F.bool_or(safe).alias("_has_safe"),
        F.bool_or(safe & cs.isNotNull()).alias("_safe_cs"), F.bool_or(cs.isNotNull()).alias("_any_cs"))
    rows = attach(narrow, flags, "query", "id", "inner").filter(safe | ~F.col("_has_safe"))
    use_cs = F.when(F.col("_has_safe"), F.col("_safe_cs")).otherwise(F.col("_any_cs"))
    key = F.when(use_cs, -F.coalesce(cs, F.lit(0.0))).otherwise(ps)
    w = Window.partitionBy("query").orderBy(key, ps, "id")
    top = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    if set(scored.columns) == {"id", "query", "price_score", "composite_score"}:
        return top.select(*scored.columns, "rank")
    return scored.join(top.select("id", "query", "rank"), ["id", "query"])


def _order_statistics(freq: DataFrame, ps: list[float]) -> DataFrame:
    """The percentiles ``ps`` of each search with a priced row (see ``percentiles``)."""
    band = F.least(F.shiftright("price", BAND_BITS), F.lit(1 << BAND_BITS))
    priced = freq.filter(F.col("price").isNotNull()).withColumn("_band", band)
    n = F.col("_n")
    k = [(n - 1).cast("double") * F.lit(p / 100.0) for p in ps]
    f = [F.floor(x).cast("bigint") for x in k]
    c = [F.least(x + 1, n - 1) for x in f]
    bands = priced.groupBy("query", "_band").agg(F.sum("cnt").alias("_s"))
    earlier = Window.partitionBy("query").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select("query", "_band", "_s", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"),
                         F.sum("_s").over(Window.partitionBy("query")).alias("_n"))
    wanted = bands.filter(F.exists(F.array(*f, *c), lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_s")))).drop("_s")
    run = Window.partitionBy("query", "_band").orderBy("price").rowsBetween(Window.unboundedPreceding, 0)
    ranked = priced.join(wanted, ["query", "_band"]).withColumn("_hi", F.sum("cnt").over(run) + F.col("_before") - 1)
    aggs = [F.max("_n").alias("_n")]
    for i in range(len(ps)):
        aggs += [F.min(F.when(F.col("_hi") >= f[i], F.col("price"))).alias(f"_vf{i}"),
                 F.min(F.when(F.col("_hi") >= c[i], F.col("price"))).alias(f"_vc{i}")]
    g = ranked.groupBy("query").agg(*aggs)
    out = [F.col("query")]
    for i, p in enumerate(ps):
        vf, vc = F.col(f"_vf{i}").cast("double"), F.col(f"_vc{i}").cast("double")
        val = F.when(f[i] == c[i], vf).otherwise(vf * (c[i].cast("double") - k[i]) + vc * (k[i] - f[i].cast("double")))
        out.append(val.alias(f"p{p:g}"))
    return g.select(*out)


def percentiles(freq: DataFrame, ps: list[float]) -> DataFrame:
    """Linear-interpolated percentiles per search with the rule
    ``k = (n-1)*p/100, f = int(k), c = min(f+1, n-1)``,
    ``v[f]*(c-k) + v[c]*(k-f)`` (``v[f]`` when ``f == c``); 0.0 when nothing
    is priced, the value itself for one price.

    A weighted selection on the ``(query, price, cnt)`` table: prices are
    counted in bands of ``2**BAND_BITS`` (one more takes all above as many
    bands), a running count over a search's bands tells the few that hold a
    wanted rank, and only their prices are ranked.  No task holds or sorts all
    prices of a search, and no window has more than ``2**BAND_BITS`` rows."""
    g = _order_statistics(freq, ps)
    with_empty = freq.select("query").distinct()
    return with_empty.join(g, "query", "left").select(
        "query", *[F.coalesce(F.col(f"p{p:g}"), F.lit(0.0)).alias(f"p{p:g}") for p in ps])
