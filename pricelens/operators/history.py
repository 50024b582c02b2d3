"""Price history: change-only recording, latest price, drops, step changes.

History keys are ``(listing_id, query)``.  Ordering inside a key is always
``(seen_at, seq)`` so ties never depend on storage order.

Scale notes
-----------
* ``latest_price`` and ``price_drops`` never sort a key's rows: the latest
  row is ``max(struct(seen_at, seq, price))`` (map-side partial aggregate);
  the previous one is the same aggregate over rows strictly before it, found
  with an equi-join on the key that AQE can split when a key is hot.
* ``price_changes`` (the full rebuild) and ``step_changes`` need each row's
  predecessor within its key.  ``previous_value`` scans in pieces: rows are
  ordered within their (key, second) only, the first row of a second takes the
  last value before it from a table with one row per (key, second), whose own
  predecessors are found in the same way per (key, day), then per key.  So a
  listing holding a third of all rows, even inside one hour, is spread over its
  seconds, and no task orders more than one second's rows, one day's seconds or
  one key's days.  Everything is keyed on data, so the
  result does not depend on how Spark deals or re-runs partitions.  The
  incremental path (``tables.append_history``) only windows the last stored
  row plus the new batch rows of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("listing_id", "query")


def _ord(ts: str = "seen_at", seq: str = "seq") -> Column:
    return F.struct(F.col(ts), F.col(seq))


def observations_to_history(obs: DataFrame) -> DataFrame:
    """Observations with a price in history shape (NULL and 0 mean unpriced)."""
    return (obs.filter(F.col("price_nok") != 0)
            .select(F.col("id").alias("listing_id"), "query",
                    F.col("price_nok").alias("price"),
                    F.col("scraped_at").alias("seen_at"), "seq"))


#: Pieces that a key's rows are ordered in, fine to coarse; each follows from the one before.
CELLS = (("_second", lambda t: F.coalesce(F.date_trunc("second", t), F.lit("0001-01-01").cast("timestamp"))),
         ("_day", lambda t: F.to_date(t)))


def previous_value(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "_prev") -> DataFrame:
    """Add ``out`` = ``value`` of the previous row of the same key in ``order``
    (NULL for a key's first row).  ``order`` starts with a timestamp; rows
    equal in it are ordered by ``value``.  See the module notes."""
    return _previous(df, keys, order, value, CELLS, out)


def _previous(df: DataFrame, keys: list[str], order: list[str], value: str, cells: tuple, out: str) -> DataFrame:
    if not cells:
        return df.select("*", F.lag(value).over(Window.partitionBy(*keys).orderBy(*order, value)).alias(out))
    (cell, cut), *coarser = cells
    rows = df.withColumn(cell, cut(F.col(order[0])))
    piece = [*keys, cell]
    last = rows.groupBy(*piece).agg(F.max(F.struct(*order, value)).alias("_last")).select(*piece, F.col(f"_last.{value}").alias("_value"))
    before = _previous(last, keys, [cell], "_value", tuple(coarser), f"_before{cell}").drop("_value")
    w = Window.partitionBy(*piece).orderBy(*order, value)
    inner = rows.withColumns({"_inner": F.lag(value).over(w), "_first": F.row_number().over(w) == 1})
    return (inner.join(before, piece, "left")
            .select(*df.columns, F.when(F.col("_first"), F.col(f"_before{cell}")).otherwise(F.col("_inner")).alias(out)))


def price_changes(obs: DataFrame, keep_previous: bool = False) -> DataFrame:
    """Change-only history: a priced observation is recorded iff its price differs
    from the previous priced observation of the same (id, query).

    Between two recorded rows every observation repeats the earlier price, so
    a recorded row's previous observation price *is* the previous recorded
    price; ``keep_previous`` keeps it as ``previous_price``."""
    h = observations_to_history(obs)
    out = (previous_value(h, list(KEY), ["seen_at", "seq"], "price")
           .filter(F.col("_prev").isNull() | (F.col("_prev") != F.col("price"))))
    return out.withColumnRenamed("_prev", "previous_price") if keep_previous else out.drop("_prev")


def latest_price(history: DataFrame) -> DataFrame:
    """Latest price per key (partial aggregate; no sort of a key's rows)."""
    last = F.max(F.struct("seen_at", "seq", "price")).alias("l")
    return (history.groupBy(*KEY).agg(last)
            .select(*KEY, F.col("l.price").alias("price"), F.col("l.seen_at").alias("seen_at")))


def latest_two(history: DataFrame) -> DataFrame:
    """``(key, current_price, current_seen_at, previous_price)`` for keys with 2+ rows."""
    cur = (history.groupBy(*KEY)
           .agg(F.max(F.struct("seen_at", "seq", "price")).alias("c")))
    before = (history.join(cur, list(KEY))
              .filter(_ord() < F.struct(F.col("c.seen_at"), F.col("c.seq")))
              .groupBy(*KEY)
              .agg(F.max(F.struct("seen_at", "seq", "price")).alias("p")))
    return (cur.join(before, list(KEY))
            .select(*KEY, F.col("c.price").alias("current_price"),
                    F.col("c.seen_at").alias("current_seen_at"),
                    F.col("p.price").alias("previous_price")))


def drop_candidates(history: DataFrame, query: str | None = None) -> DataFrame:
    """Keys whose latest recorded price is below the one before it.

    With a ``previous_price`` column on the history rows this is one partial
    aggregate (latest row per key); otherwise the two latest rows come from
    ``latest_two``."""
    h = history if query is None else history.filter(F.col("query") == query)
    if "previous_price" in h.columns:
        cur = (h.groupBy(*KEY)
               .agg(F.max(F.struct("seen_at", "seq", "price", "previous_price")).alias("c"))
               .select(*KEY, F.col("c.price").alias("current_price"),
                       F.col("c.seen_at").alias("current_seen_at"),
                       F.col("c.previous_price").alias("previous_price")))
    else:
        cur = latest_two(h)
    return cur.filter(F.col("current_price") < F.col("previous_price"))


def price_drops(history: DataFrame, listings: DataFrame, limit: int | None = None,
                query: str | None = None) -> DataFrame:
    """Active listings whose latest price dropped; with ``limit`` the biggest
    relative drops, first to last (without, the rows are not sorted).

    ``drop_pct`` uses the history prices; ``listing_price`` is the listing's
    stored price (it may be NULL when the last scan saw no price)."""
    d = drop_candidates(history, query)
    active = (listings.filter(F.col("is_active"))
              .select(F.col("id").alias("listing_id"), "query", "title", "url",
                      F.col("price_nok").alias("listing_price")))
    prev, cur = F.col("previous_price"), F.col("current_price")
    out = (d.join(active, list(KEY))
           .withColumn("drop_pct", (prev - cur).cast("double") / prev.cast("double")
                       * F.lit(100.0)))
    return out if limit is None else out.orderBy(F.col("drop_pct").desc(), "query", "listing_id").limit(limit)


def step_changes(history: DataFrame) -> DataFrame:
    """Each history point with the % change from the previous one (NULL first)."""
    h = previous_value(history, list(KEY), ["seen_at", "seq"], "price")
    prev = F.col("_prev")
    return h.withColumn(
        "change_pct", (F.col("price") - prev).cast("double") / prev.cast("double") * F.lit(100.0)
    ).drop("_prev")


def listing_histories(history: DataFrame, listings: DataFrame,
                      listing_id: str | None = None) -> DataFrame:
    """History points of tracked listings (one row per point, oldest first per
    key); listings without history are dropped by the inner join."""
    h = history if listing_id is None else history.filter(F.col("listing_id") == listing_id)
    l = listings.select(F.col("id").alias("listing_id"), "query", "title", "url")
    if listing_id is not None:
        l = l.filter(F.col("listing_id") == listing_id)
    return (h.join(l, list(KEY))
            .select("listing_id", "query", "title", "url", "seen_at", "seq", "price")
            .sortWithinPartitions("listing_id", "query", "seen_at", "seq"))
