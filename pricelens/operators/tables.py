"""Table maintenance: upsert with deactivation, change-only history append,
retention.  Pure functions ``(table, batch, ...) -> new table``; the store
(``sources.store``) writes the result as a new version.

Rules
-----
* Upsert by ``(id, query)``: every batch field overwrites the stored one
  (NULLs included) and the row becomes active, except the review fields
  (``composite_score`` and the ``ai_report`` parts), which keep the stored
  value when the batch has NULL.
* Duplicate keys inside one batch apply in ``seq`` order: the last row wins,
  review fields take their last non-NULL value.
* A stored row of a scanned search that the batch does not contain turns
  inactive, but only when that search's scan was complete.  An empty batch
  changes nothing; a row that reappears is active again.
* History gets a batch row when its price is set (non-zero, like the reference's truthiness test) and differs from the
  key's previous price (the latest stored row, then earlier batch rows).
* Retention deletes inactive listings last seen before ``now - days`` and,
  first, their history; ``days <= 0`` keeps everything.

Scale: the upsert is one full outer join on the key (batch duplicates are
pre-aggregated so the join never fans out).  The store keeps its rows clustered
by ``(id, query)``, so only the batch is shuffled; of them it reads just the
buckets of the batch's searches.  History append joins a key's stored last
price to the batch rows and windows those.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.times import ts_lit
from pricelens.operators.attach import attach

KEY = ["id", "query"]
REPORT_FIELDS = ("condition_score", "battery_pct", "red_flags", "summary")
KEPT_SCALARS = ("composite_score", "recorded_price")
NON_DATA = ("seq", "scan_id", "scan_day", "is_active")


def _flatten_report(df: DataFrame) -> DataFrame:
    if "ai_report" not in df.columns:
        return df
    return df.select(*[c for c in df.columns if c != "ai_report"],
                     *[F.col("ai_report")[f].alias(f"_r_{f}") for f in REPORT_FIELDS])


def _kept_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c in KEPT_SCALARS or c.startswith("_r_")]


def dedupe_batch(batch: DataFrame) -> DataFrame:
    """One row per key: last row by ``seq``; review fields: last non-NULL."""
    b = _flatten_report(batch)
    kept = _kept_columns(b)
    over = [c for c in b.columns if c not in KEY and c not in kept and c not in NON_DATA]
    seq = F.col("seq")
    aggs = [F.max_by(F.struct(*over), seq).alias("_o")] if over else []
    aggs += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), seq)).alias(c) for c in kept]
    return b.groupBy(*KEY).agg(*aggs).select(*KEY, *[F.col(f"_o.{c}").alias(c) for c in over], *kept)


def _rebuild_report(df: DataFrame) -> DataFrame:
    cols = [f"_r_{f}" for f in REPORT_FIELDS]
    if not all(c in df.columns for c in cols):
        return df
    any_set = F.lit(False)
    for c in cols:
        any_set = any_set | F.col(c).isNotNull()
    rep = F.when(any_set, F.struct(*[F.col(f"_r_{f}").alias(f) for f in REPORT_FIELDS]))
    return df.withColumn("ai_report", rep).drop(*cols)


def upsert_listings(table: DataFrame, batch: DataFrame,
                    complete: DataFrame | None = None,
                    prune_missing: bool = True, few_searches: bool = False,
                    clusters: int | None = None) -> DataFrame:
    """New listing table after applying ``batch``.

    ``few_searches``: the caller has checked that the batch's searches are
    small enough to broadcast, so that the stored side needs no exchange for them.
    ``clusters``: the parts in which ``table`` is stored by key; the batch is
    dealt likewise (else the planner would deal the larger side anew if its own
    number of partitions is higher).
    ``complete`` holds ``(query, complete)`` for the scans in the batch; when
    omitted every scanned search counts as complete.  ``prune_missing=False``
    never deactivates (a partial scan)."""
    t = _flatten_report(table)
    b = dedupe_batch(batch).withColumn("_hit", F.lit(True))
    if clusters:
        b = b.repartition(clusters, *KEY)
    scanned = batch.select("query").distinct()
    if complete is not None:
        scanned = scanned.join(complete.groupBy("query").agg(F.bool_and("complete").alias("_c")),
                               "query", "left").filter(F.coalesce("_c", F.lit(False))).select("query")
    scanned = scanned.withColumn("_scanned", F.lit(prune_missing))
    tj = t.join(F.broadcast(scanned), "query", "left") if few_searches else attach(t, scanned, "query", "id")
    j = tj.alias("t").join(b.alias("b"), KEY, "full_outer")
    hit = F.coalesce(F.col("b._hit"), F.lit(False))
    kept = set(_kept_columns(t)) | set(_kept_columns(b))
    cols: list[Column] = [F.col(k) for k in KEY]
    for c in t.columns:
        if c in KEY or c in ("is_active", "_scanned"):
            continue
        if c in kept and c in b.columns:
            cols.append(F.coalesce(F.col(f"b.{c}"), F.col(f"t.{c}")).alias(c))
        elif c in b.columns:
            cols.append(F.when(hit, F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            cols.append(F.col(f"t.{c}").alias(c))
    for c in b.columns:
        if c not in t.columns and c not in KEY and c != "_hit":
            cols.append(F.col(f"b.{c}").alias(c))
    was = F.coalesce(F.col("t.is_active"), F.lit(True))
    active = (F.when(hit, F.lit(True))
              .when(F.coalesce(F.col("t._scanned"), F.lit(False)), F.lit(False))
              .otherwise(was))
    cols.append(active.alias("is_active"))
    return _rebuild_report(j.select(*cols))


def deactivated(table: DataFrame, new_table: DataFrame) -> DataFrame:
    """Rows that were active and are inactive after the upsert."""
    before = table.filter(F.coalesce(F.col("is_active"), F.lit(True))).select(*KEY)
    return new_table.filter(~F.col("is_active")).join(before, KEY, "left_semi")


def _batch_history_rows(batch: DataFrame) -> DataFrame:
    return (batch.filter(F.col("price_nok") != 0)
            .select(F.col("id").alias("listing_id"), "query",
                    F.col("price_nok").alias("price"),
                    F.col("scraped_at").alias("seen_at"), "seq",
                    F.lit(1).alias("_new")))


def _changes_after(last: DataFrame, new: DataFrame) -> DataFrame:
    """New rows whose price differs from the key's previous one (the stored
    last price first, then earlier batch rows by ``seq``)."""
    w = Window.partitionBy("listing_id", "query").orderBy("_new", "seq")
    u = last.unionByName(new).withColumn("_prev", F.lag("price").over(w))
    # Between recorded rows the price repeats, so a new row's previous row
    # holds the previous recorded price: kept as ``previous_price``.
    return (u.filter((F.col("_new") == 1)
                     & (F.col("_prev").isNull() | (F.col("_prev") != F.col("price"))))
            .drop("_new").withColumnRenamed("_prev", "previous_price"))


def append_history(history: DataFrame, batch: DataFrame) -> DataFrame:
    """History rows to append for ``batch`` (change-only)."""
    new = _batch_history_rows(batch)
    keys = new.select("listing_id", "query").distinct()
    last = (history.join(keys, ["listing_id", "query"], "left_semi")
            .groupBy("listing_id", "query")
            .agg(F.max(F.struct("seen_at", "seq", "price")).alias("l"))
            .select("listing_id", "query", "l.price", "l.seen_at", "l.seq",
                    F.lit(0).alias("_new")))
    return _changes_after(last, new)


def append_history_from_state(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Same rows as ``append_history``, with each key's last recorded price
    read from the listing state's ``recorded_price`` column instead of a scan
    of the whole history."""
    new = _batch_history_rows(batch).drop("_new").withColumn("seen_at", F.col("seen_at").cast("timestamp"))
    last = (state.filter(F.col("recorded_price").isNotNull())
            .select(F.col("id").alias("listing_id"), "query", F.col("recorded_price").alias("_last")))
    w = Window.partitionBy("listing_id", "query").orderBy("seq")
    u = (new.join(last, ["listing_id", "query"], "left")
         .withColumn("previous_price", F.coalesce(F.lag("price").over(w), "_last")).drop("_last"))
    return u.filter(F.col("previous_price").isNull() | (F.col("previous_price") != F.col("price")))


def with_recorded_price(batch: DataFrame, new_rows: DataFrame) -> DataFrame:
    """``batch`` with the last history price appended for each key; NULL keeps the stored one."""
    rec = (new_rows.groupBy("listing_id", "query")
           .agg(F.max_by("price", "seq").alias("recorded_price"))
           .withColumnRenamed("listing_id", "id"))
    return batch.drop("recorded_price").join(rec, KEY, "left")


def _cutoff(now: datetime, days: int) -> Column:
    return ts_lit(now - timedelta(days=days))


def stale_listings(listings: DataFrame, now: datetime, days: int) -> DataFrame:
    """Inactive listings last seen strictly before ``now - days``."""
    if days <= 0:
        return listings.limit(0)
    inactive = ~F.coalesce(F.col("is_active"), F.lit(True))
    return listings.filter(inactive & (F.col("scraped_at") < _cutoff(now, days)))


def prune_listings(listings: DataFrame, now: datetime, days: int) -> DataFrame:
    if days <= 0:
        return listings
    stale = (~F.coalesce(F.col("is_active"), F.lit(True))) & (F.col("scraped_at") < _cutoff(now, days))
    return listings.filter(~F.coalesce(stale, F.lit(False)))


def _stale_keys(listings: DataFrame, now: datetime, days: int) -> DataFrame:
    return stale_listings(listings, now, days).select(F.col("id").alias("listing_id"), "query")


def prune_history(history: DataFrame, listings: DataFrame, now: datetime, days: int) -> DataFrame:
    """History without the rows of stale listings (orphans and other searches stay)."""
    if days <= 0:
        return history
    return history.join(_stale_keys(listings, now, days), ["listing_id", "query"], "left_anti")


def prune_counts(history: DataFrame, listings: DataFrame, now: datetime, days: int) -> DataFrame:
    """``(table, deleted)`` for listings and history rows removed by retention."""
    stale = stale_listings(listings, now, days)
    n_l = stale.agg(F.count(F.lit(1)).alias("deleted")).select(F.lit("listings").alias("table"), "deleted")
    hist_gone = history.join(_stale_keys(listings, now, days), ["listing_id", "query"], "left_semi")
    n_h = hist_gone.agg(F.count(F.lit(1)).alias("deleted")).select(F.lit("price_history").alias("table"), "deleted")
    return n_l.unionByName(n_h)
