"""Streams over landed observation files agree with their batch twins."""

import os

import pytest
from pyspark.sql import functions as F

from pricelens.operators import history as H
from pricelens.sources import standins as S
from pricelens.sources.store import ListingStore
from pricelens.streaming import feed as FD

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Observations landed as several files (one per 10 days), ts as TIMESTAMP."""
    root = str(tmp_path_factory.mktemp("feed"))
    o = S.obs(spark, SF).withColumn("scraped_at", F.col("scraped_at").cast("timestamp"))
    o = o.withColumn("part", F.floor((F.dayofmonth("scraped_at") - 1) / 10))
    for p in range(4):
        o.filter(F.col("part") == p).drop("part").coalesce(1).write.parquet(os.path.join(root, f"f{p}"))
    return root, o.drop("part").schema


def _stream(spark, landed):
    root, schema = landed
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(root))


def _drain(df, name, mode, ckpt):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination(300)
    q.stop()


def test_changes_of_the_feed_match_batch(spark, landed, tmp_path):
    store = ListingStore(spark, str(tmp_path / "store"), buckets=4)
    for _ in range(2):  # drained, then started again with nothing new
        FD.apply_feed(_stream(spark, landed), store, str(tmp_path / "c1")).awaitTermination(600)
    got = FD.price_drops_found(store.read("price_history"))
    cols = ["listing_id", "query", "price", "seq"]
    want = H.price_changes(S.obs(spark, SF))
    assert got.count() == want.count() and got.select(cols).exceptAll(want.select(cols)).count() == 0
    steps = H.step_changes(want).filter("change_pct < 0").select("listing_id", "query", "seq")
    drops = got.filter("is_drop").select("listing_id", "query", "seq")
    assert drops.count() == steps.count() > 0 and drops.exceptAll(steps).count() == 0
    assert store.applied("feed-000000000003") and not store.applied("feed-000000000004")


def test_latest_price_stream(spark, landed, tmp_path):
    """Update mode: each micro-batch emits the keys it touched; the last emission of a key is its price."""
    out = str(tmp_path / "updates")
    (FD.latest_price_stream(_stream(spark, landed)).writeStream.outputMode("update")
     .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"))
     .option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(300))
    seen = spark.read.parquet(out)
    got = seen.groupBy(F.col("id").alias("listing_id"), "query").agg(F.max_by("price", "batch").alias("price"))
    want = H.latest_price(H.price_changes(S.obs(spark, SF))).select("listing_id", "query", "price")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert seen.filter("batch = 3").count() < got.count()  # only the touched keys


def test_scan_activity_stream(spark, landed, tmp_path):
    _drain(FD.scan_activity_stream(_stream(spark, landed)), "activity", "append", str(tmp_path / "c3"))
    got = spark.sql("SELECT query, window_start, window_end, n_obs FROM activity")
    root, _ = landed
    batch = spark.read.option("recursiveFileLookup", "true").parquet(root)
    want = FD.scan_activity(batch)
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0
