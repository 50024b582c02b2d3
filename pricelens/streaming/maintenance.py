"""Table maintenance per landed scan (X5).

Scans land as directories of observation Parquet files under a landing root
(one directory per scan, names sortable in arrival order).  Each one that the
store has not applied yet is applied as one batch job.  A crash at any step is
safe to re-run: a scan writes only folders of its own name.  A ``complete``
column, when present, gives the scan's completeness.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.sources.store import ListingStore


def landed_scans(store: ListingStore, landing_root: str) -> list[str]:
    if not store.exists(landing_root):
        return []
    p = store.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(landing_root)
    fs = p.getFileSystem(store.spark.sparkContext._jsc.hadoopConfiguration())
    names = [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()]
    return sorted(n for n in names if not n.startswith(("_", ".")))


def apply_landed(store: ListingStore, landing_root: str) -> list[str]:
    """Apply every landed scan that is not applied yet, in order; returns their ids."""
    applied = []
    for scan_id in landed_scans(store, landing_root):
        if store.applied(scan_id):
            continue
        obs: DataFrame = store.spark.read.parquet(f"{landing_root.rstrip('/')}/{scan_id}")
        complete = None
        if "complete" in obs.columns:
            complete = obs.groupBy("query").agg(F.bool_and("complete").alias("complete"))
            obs = obs.drop("complete")
        store.apply_scan(obs, scan_id, complete)
        applied.append(scan_id)
    return applied
