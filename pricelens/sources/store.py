"""The listing state and the price history as plain partitioned Parquet tables.

    <root>/layout/                              buckets and clusters, one row
    <root>/listings/scan_id=<id>/bucket=<k>/    the listing rows a scan changed, clustered by (id, query)
    <root>/price_history/scan_id=<id>/          the price changes it found
    <root>/retired/                             keys that retention deleted
    <root>/versions/scan_id=<id>/               the scan's version, one row
    <root>/summaries/scan_id=<id>/              active count and last sight of each search scanned
    <root>/generations/gen=<n>/                 the version up to which base <n> holds everything, one row

Every scan writes (overwrites) only folders of its own name, from the state of
the other scans, so a re-run after any failure gives the same rows; Spark's
commit hides what a failed job left.  The version is written first, the
summary last, and marks the scan as applied.  A scan writes all rows of its
searches, and retention deletes inactive listings only, so a search's summary
of the highest version holds until its next scan: saved searches and freshness
merge the summaries and never read the log.  A listing's state is its row of the highest
``version``; retention appends keys instead of
rewriting data, and ``copy_to`` writes a compact copy.

The listing rows of every scan and base are a bucketed table: ``bucket`` (by
search) prunes folders, and within it the files are clustered by ``(id,
query)`` into ``clusters`` parts, which Spark reads as a hash partitioning.  So
folding the log, finding price changes, the upsert and writing its result move
the batch only, never stored rows; ``clusters`` is the number of tasks of these
steps (thousands for a large store).  Spark knows bucketed files by catalog
only: an external table named after the root is kept in the session's catalog
and repaired from the folders at each read.  The layout is fixed by the first
write; another one is taken with ``copy_to``.

``compact`` folds the log in place: it writes the state and the history as base
``~<n>`` beside the scans and its generation last.  Readers take the base of
the newest generation and the scans after its version, so a compaction that
fails at any step changes nothing and is simply run again.  Folders that a
generation replaces are deleted by the next compaction only, so that jobs
planned before a compaction still find their files.  A compaction and a scan
must not run at the same time.  The root must be a shared folder on a cluster.
"""

from __future__ import annotations

import hashlib
from datetime import datetime
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens import schemas
from pricelens.operators import tables as TB

KEY = ["id", "query"]
#: First character of a base's folder name; no scan id may start with it.
BASE = "~"
#: The searches of a batch are broadcast up to this many bytes, and joined through an exchange beyond.
BROADCAST_BYTES = 32 << 20


def _with(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in fields)])


_STATE = _with(schemas.STORED_LISTINGS, ("version", T.LongType()), ("scan_id", T.StringType()), ("bucket", T.IntegerType()))
_HISTORY = _with(schemas.PRICE_HISTORY, ("version", T.LongType()), ("scan_id", T.StringType()))
_VERSION = T.StructType([T.StructField("version", T.LongType()), T.StructField("scan_id", T.StringType())])
_SUMMARY = T.StructType([T.StructField("query", T.StringType()), T.StructField("n_active", T.LongType()), T.StructField("last_seen", T.TimestampType()),
                         T.StructField("version", T.LongType()), T.StructField("scan_id", T.StringType())])
_GENERATION = T.StructType([T.StructField("upto", T.LongType()), T.StructField("gen", T.LongType())])
_RETIRED = T.StructType([T.StructField("id", T.StringType()), T.StructField("query", T.StringType()), T.StructField("retired", T.LongType())])


class ListingStore:
    """Tables ``listings`` and ``price_history`` under ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, clusters: int = 8):
        self.spark, self.root = spark, root.rstrip("/")
        if self.exists(f"{self.root}/layout/_SUCCESS"):
            buckets, clusters = spark.read.parquet(f"{self.root}/layout").select("buckets", "clusters").first()
        self.buckets, self.clusters = buckets, clusters

    def exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _part(self, table: str, scan_id: str) -> str:
        return f"{self.root}/{table}/scan_id={quote(scan_id, safe='')}"

    def applied(self, scan_id: str) -> bool:
        return self.exists(f"{self._part('summaries', scan_id)}/_SUCCESS")

    def _bucket(self):
        return F.pmod(F.hash("query"), F.lit(self.buckets))

    def _name(self, of: str = "") -> str:
        return f"pricelens_listings_{hashlib.md5(f'{self.root}|{of}'.encode()).hexdigest()}"

    def _listings(self) -> DataFrame:
        """The listing rows of all scans and bases, as a bucketed table."""
        name, path = self._name(), f"{self.root}/listings".replace("\\", "\\\\").replace("'", "\\'")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _STATE)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY (scan_id, bucket) "
                       f"CLUSTERED BY (id, query) INTO {self.clusters} BUCKETS LOCATION '{path}'")
        self.spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def _write_listings(self, rows: DataFrame, scan_id: str, clustered: bool) -> None:
        """Write one scan's rows (overwrite); rows not yet ``clustered`` are first."""
        if not self.exists(f"{self.root}/layout/_SUCCESS"):
            sizes = F.lit(self.buckets).alias("buckets"), F.lit(self.clusters).alias("clusters")
            self.spark.range(1).select(*sizes).write.mode("overwrite").parquet(f"{self.root}/layout")
        dealt = rows if clustered else rows.repartition(self.clusters, *KEY)
        name = self._name(scan_id)
        (dealt.withColumn("bucket", self._bucket()).write.mode("overwrite").partitionBy("bucket").bucketBy(self.clusters, *KEY).sortBy("query", "price_score")
         .option("path", self._part("listings", scan_id)).format("parquet").saveAsTable(name))
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _table(self, table: str, schema: T.StructType) -> DataFrame:
        if not self.exists(f"{self.root}/{table}"):
            return self.spark.createDataFrame([], schema)
        if table == "listings":
            return self._listings()
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")

    def _generation(self) -> tuple[int, int]:
        """The newest generation and the version up to which its base holds everything."""
        last = self._table("generations", _GENERATION).agg(F.max(F.struct("gen", "upto")).alias("g")).select("g.*").first()
        return last["gen"] or 0, last["upto"] or 0

    def _log(self, table: str, schema: T.StructType) -> DataFrame:
        """The rows of the newest base and of the scans after it."""
        gen, upto = self._generation()
        later = ~F.col("scan_id").startswith(BASE) & (F.col("version") > upto)
        return self._table(table, schema).filter((F.col("scan_id") == f"{BASE}{gen}") | later)

    def _retired(self) -> DataFrame:
        return self._table("retired", _RETIRED).repartition(self.clusters, *KEY).groupBy(*KEY).agg(F.max("retired").alias("retired"))

    def _kept(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows that no later retention deleted."""
        gone = self._retired().withColumnRenamed("id", key)
        return rows.join(gone, [key, "query"], "left").filter(F.col("retired").isNull() | (F.col("version") > F.col("retired"))).drop("retired")

    def _state(self, log: DataFrame) -> DataFrame:
        cols = [c for c in schemas.STORED_LISTINGS.fieldNames() if c not in KEY]
        last = self._kept(log, "id").groupBy(*KEY).agg(F.max_by(F.struct(*cols), "version").alias("l"))
        return last.select(*KEY, "l.*").select(*schemas.STORED_LISTINGS.fieldNames())

    def read(self, table: str) -> DataFrame:
        if table == "listings":
            return self._state(self._log("listings", _STATE)).select(*schemas.LISTINGS.fieldNames())
        return self._kept(self._log("price_history", _HISTORY), "listing_id").select(*schemas.PRICE_HISTORY.fieldNames())

    def apply_scan(self, batch: DataFrame, scan_id: str, complete: DataFrame | None = None, prune_missing: bool = True) -> None:
        """Append one scan's price changes and the listing rows it changes.

        ``batch`` is read several times: give a stored table.  An applied scan
        is left alone; one that failed half-way is written again."""
        if scan_id.startswith(BASE):
            raise ValueError(f"a scan id may not start with {BASE}")
        if self.applied(scan_id):
            return
        version, clustered = self._version(scan_id) + 1, self.exists(f"{self.root}/listings")
        self.spark.range(1).select(F.lit(version).cast("long").alias("version")).write.mode("overwrite").parquet(self._part("versions", scan_id))
        state, few = self._touched(batch, scan_id)
        new = TB.append_history_from_state(state, batch).select(*schemas.PRICE_HISTORY.fieldNames(), F.lit(version).alias("version"))
        new.write.mode("overwrite").parquet(self._part("price_history", scan_id))
        added = self.spark.read.schema(new.schema).parquet(self._part("price_history", scan_id))
        now = TB.upsert_listings(state, TB.with_recorded_price(batch, added), complete, prune_missing, few, self.clusters)
        self._write_listings(now.select(*schemas.STORED_LISTINGS.fieldNames()).withColumn("version", F.lit(version).cast("long")), scan_id, clustered)
        self._summarise(scan_id, version)

    def _touched(self, batch: DataFrame, scan_id: str) -> tuple[DataFrame, bool]:
        """State of the searches of ``batch`` before the scan, and whether they are few enough to broadcast."""
        searches = batch.select("query", self._bucket().alias("bucket")).distinct()
        sizes = searches.groupBy("bucket").agg(F.sum(F.octet_length(F.coalesce("query", F.lit(""))) + 16).alias("size")).collect()  # one row a bucket
        few = sum(r["size"] for r in sizes) <= BROADCAST_BYTES
        log = self._log("listings", _STATE).filter((F.col("scan_id") != scan_id) & F.col("bucket").isin([r["bucket"] for r in sizes]))
        return self._state(log.join(F.broadcast(searches) if few else searches, ["bucket", "query"], "left_semi")), few

    def _version(self, but: str = "") -> int:
        """The highest version of the scans other than ``but``."""
        return self._table("versions", _VERSION).filter(F.col("scan_id") != but).agg(F.max("version")).first()[0] or 0

    def _summarise(self, scan_id: str, version: int) -> None:
        """Write the active count and last sight of each search of a scan, from the rows it wrote."""
        rows = self.spark.read.schema(_STATE).parquet(self._part("listings", scan_id))
        active = F.coalesce(F.col("is_active"), F.lit(True))
        (rows.groupBy("query").agg(F.count(F.when(active, 1)).alias("n_active"), F.max(F.when(active, F.col("scraped_at"))).alias("last_seen"))
         .withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").parquet(self._part("summaries", scan_id)))

    def summaries(self) -> DataFrame:
        """Searches with active listings: query, n_active, last_seen."""
        last = self._table("summaries", _SUMMARY).groupBy("query").agg(F.max_by(F.struct("n_active", "last_seen"), "version").alias("l"))
        return last.select("query", "l.*").filter("n_active > 0")

    def prune(self, now: datetime, days: int) -> list[tuple[str, int]]:
        """Retention: retire inactive listings last seen before ``now - days``, with their history."""
        listings, history = self.read("listings"), self.read("price_history")
        counts = [(r["table"], r["deleted"]) for r in TB.prune_counts(history, listings, now, days).collect()]
        if days > 0 and any(n for _, n in counts):
            version = self._version()
            TB.stale_listings(listings, now, days).select(*KEY, F.lit(version).cast("long").alias("retired")).write.mode("append").parquet(f"{self.root}/retired")
        return counts

    def compact(self) -> None:
        """Fold the log into a new base (see the module notes); every scan must have been applied whole."""
        open_ = [r["scan_id"] for r in self._table("versions", _VERSION).select("scan_id").distinct().toLocalIterator() if not self.applied(r["scan_id"])]
        if open_:
            raise ValueError(f"scans not applied whole, apply them again first: {open_}")
        (gen, before), upto = self._generation(), self._version()
        if upto <= before:
            return
        base, version = f"{BASE}{gen + 1}", F.lit(upto).cast("long").alias("version")
        self.read("price_history").select("*", version).write.mode("overwrite").parquet(self._part("price_history", base))
        self._write_listings(self._state(self._log("listings", _STATE)).select("*", version), base, clustered=True)
        self._publish(gen + 1, upto)
        later = self._table("versions", _VERSION).filter(F.col("version") > before).select("scan_id").distinct()
        self._delete_but({f"{BASE}{gen + 1}", f"{BASE}{gen}", *(r["scan_id"] for r in later.toLocalIterator())})

    def _publish(self, gen: int, upto: int) -> None:
        self.spark.range(1).select(F.lit(upto).cast("long").alias("upto")).write.mode("overwrite").parquet(f"{self.root}/generations/gen={gen}")

    def _delete_but(self, names: set[str]) -> None:
        """Delete the folders of scans and bases other than ``names`` (as many as one generation replaced)."""
        jvm = self.spark.sparkContext._jvm
        for table in ("listings", "price_history"):
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
            files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for one in files.listStatus(folder) if files.exists(folder) else []:
                name = one.getPath().getName()
                if name.startswith("scan_id=") and unquote(name.removeprefix("scan_id=")) not in names:
                    files.delete(one.getPath(), True)

    def copy_to(self, root: str, buckets: int | None = None, clusters: int | None = None) -> ListingStore:
        """A compact copy, in another layout if given: the current state and history as one scan each."""
        other = ListingStore(self.spark, root, buckets or self.buckets, clusters or self.clusters)
        one = F.lit(1).cast("long").alias("version")
        self.read("price_history").select("*", one).write.parquet(other._part("price_history", "base"))
        other._write_listings(self._state(self._log("listings", _STATE)).select("*", one), "base", other.clusters == self.clusters)
        self.spark.range(1).select(one).write.parquet(other._part("versions", "base"))
        other._summarise("base", 1)
        return other
