"""The stateful change stream agrees with the batch history."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from pricelens.operators import history as H
from pricelens.sources import standins as S
from pricelens.streaming import changes as C

SF = "/root/testdata/sf0.001"
SCHEMA = "id string, query string, price_nok long, scraped_at timestamp, seq long"


def _feed(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def _land(df, folder, name):
    out = os.path.join(folder, name)
    df.coalesce(1).write.parquet(out + "-tmp")
    (part,) = [f for f in os.listdir(out + "-tmp") if f.endswith(".parquet")]
    os.makedirs(folder, exist_ok=True)
    shutil.copy(os.path.join(out + "-tmp", part), out + ".parquet")


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_changes_match_batch_across_a_restart(spark, tmp_path):
    landing, made = str(tmp_path / "in"), str(tmp_path / "made")
    o = S.obs(spark, SF).select("id", "query", F.col("price_nok").cast("long").alias("price_nok"), F.col("scraped_at").cast("timestamp").alias("scraped_at"), F.col("seq").cast("long").alias("seq"))
    parts = [o.filter(F.floor((F.dayofmonth("scraped_at") - 1) / 8) == k) for k in range(4)]
    os.makedirs(landing)
    for k, part in enumerate(parts):
        _land(part, made, f"f{k}")
    run = lambda: C.start(C.price_changes_stream(_feed(spark, landing)), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(600)
    for names in (("f0", "f1"), ("f2", "f3"), ("f3",)):  # a restart, then a file that lands twice
        for k in names:
            target = os.path.join(landing, f"{k}.parquet")
            shutil.copy(os.path.join(made, f"{k}.parquet"), target if not os.path.exists(target) else os.path.join(landing, f"{k}-again.parquet"))
        run()
    got = spark.read.parquet(str(tmp_path / "out"))
    cols = ["listing_id", "query", "price", "seq", "previous_price"]
    want = H.price_changes(S.obs(spark, SF), keep_previous=True).select(cols)
    assert got.count() == want.count() and got.select(cols).exceptAll(want).count() == 0
    assert got.where("is_drop").count() == want.where("price < previous_price").count() > 0
    state = spark.read.format("statestore").option("stateVarName", "latest").load(str(tmp_path / "ckpt"))
    assert state.count() == o.where("price_nok <> 0").select("id", "query").distinct().count()


def test_order_in_a_batch_late_rows_and_idle_keys(spark, tmp_path):
    landing = str(tmp_path / "in")
    os.makedirs(landing)
    t = lambda d, h=0: f"2026-07-{d:02d} {h:02d}:00:00"
    files = [[("a", 100, t(1, 5), 2), ("a", 100, t(1, 6), 3), ("a", 90, t(1, 4), 1), ("b", 0, t(1), 4), ("b", 70, t(1, 1), 5)],
             [("a", 80, t(1, 2), 6), ("a", 100, t(2), 7), ("a", 95, t(2), 8)],
             [("c", 1, t(20), 9)], [("c", 1, t(21), 10)], [("b", 70, t(22), 11), ("a", 95, t(22), 12)]]
    out = {}
    for idle in (None, "5 days"):
        tag = "idle" if idle else "plain"
        for k, rows in enumerate(files):
            d = spark.createDataFrame([(i, "q", p, s, n) for i, p, s, n in rows], "id string, query string, price_nok long, scraped_at string, seq long").withColumn("scraped_at", F.col("scraped_at").cast("timestamp"))
            d.coalesce(1).write.parquet(f"{landing}/{tag}/f{k}")
            C.start(C.price_changes_stream(_feed(spark, f"{landing}/{tag}"), idle=idle), str(tmp_path / f"out-{tag}"), str(tmp_path / f"ck-{tag}")).awaitTermination(300)
        out[tag] = sorted((r.listing_id, r.seq, r.price, r.previous_price) for r in spark.read.parquet(str(tmp_path / f"out-{tag}")).collect())
    plain = [("a", 1, 90, None), ("a", 2, 100, 90), ("a", 8, 95, 100), ("b", 5, 70, None), ("c", 9, 1, None)]
    assert out["plain"] == plain
    assert out["idle"] == sorted([*plain, ("a", 12, 95, None), ("b", 11, 70, None)])  # forgotten after five idle days
