"""Windows plus corrections equal the plain count on a feed out of order with replays."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pricelens.streaming import feed as FD
from pricelens.streaming import late as L

SCHEMA = "query string, scraped_at timestamp, seq long"


def test_windows_and_corrections_equal_the_batch_count(spark, tmp_path):
    rng = random.Random(11)
    t0 = datetime(2026, 7, 1)
    rows = [(rng.choice(["a", "a", "b", "c"]), t0 + timedelta(minutes=10 * i), i) for i in range(900)]
    files = [[] for _ in range(6)]
    for i, r in enumerate(rows):
        at = i * 6 // len(rows)
        if rng.random() < 0.1:
            at = min(5, at + rng.randint(1, 4))  # comes late
        files[at].append(r)
        if rng.random() < 0.1:
            files[min(5, at + rng.randint(0, 3))].append(r)  # comes again
    files[5].append(("only late", t0 + timedelta(hours=3), 5000))
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(landing)
    for k, part in enumerate(files):
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{landing}/f{k}")
        if k % 2:
            L.counted(stream(), f"{out}/windows", str(tmp_path / "c1")).awaitTermination(300)
            L.aside(stream(), out, str(tmp_path / "c2")).awaitTermination(300)
    landed = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(landing)
    windows, late = L.read_windows(spark, f"{out}/windows"), L.late_rows(spark, out)
    patches = L.corrections(landed, windows, late)
    rows_of = lambda df: sorted(tuple(r) for r in df.select("query", "window_start", "window_end", "n_obs").collect())
    want = rows_of(FD.scan_activity(landed.dropDuplicates(["seq"])))
    emitted, patched = rows_of(windows), rows_of(patches)
    assert set(emitted) - set(want) and late.count() > 0 and any(r[0] == "only late" for r in patched)
    got = L.corrected(windows, patches)
    assert rows_of(got) == want and len(patched) < len(want)
    assert rows_of(L.corrections(landed, got, late)) == []  # nothing is left to mend
    assert late.where(F.col("batch").isNull()).count() == 0
