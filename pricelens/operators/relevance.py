"""Relevance filter: drop accessory / wanted / parts ads and too-cheap rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.params import BLACKLIST_TERMS

WORD = r"[\p{L}\p{N}_]"


def blacklist_regex(terms: Sequence[str] = BLACKLIST_TERMS) -> str:
    """One case-insensitive, Unicode-aware whole-word alternation."""
    return rf"(?iu)(?<!{WORD})(?:{'|'.join(terms)})(?!{WORD})"


def is_blacklisted(title, terms: Sequence[str] = BLACKLIST_TERMS) -> Column:
    t = F.col(title) if isinstance(title, str) else title
    return F.coalesce(t.rlike(blacklist_regex(terms)), F.lit(False))


def too_cheap(price, min_price: int | None) -> Column:
    p = F.col(price) if isinstance(price, str) else price
    if min_price is None:
        return F.lit(False)
    return F.coalesce(p < F.lit(min_price), F.lit(False))


def relevant_listings(listings: DataFrame, min_price: int | None = None,
                      terms: Sequence[str] = BLACKLIST_TERMS) -> DataFrame:
    """Keep a row unless its *title* hits the blacklist or its price is below
    ``min_price`` (an unpriced row passes)."""
    return listings.filter(~is_blacklisted("title", terms) & ~too_cheap("price_nok", min_price))


def filter_stats(listings: DataFrame, min_price: int | None = None,
                 terms: Sequence[str] = BLACKLIST_TERMS) -> DataFrame:
    """Per search: rows in, dropped by blacklist, dropped by price, kept."""
    bl = is_blacklisted("title", terms)
    cheap = ~bl & too_cheap("price_nok", min_price)
    return listings.groupBy("query").agg(
        F.count(F.lit(1)).alias("n_in"),
        F.count_if(bl).alias("dropped_blacklist"),
        F.count_if(cheap).alias("dropped_price"),
        F.count_if(~bl & ~cheap).alias("n_kept"),
    )
