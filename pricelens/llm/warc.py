"""WARC archives: a deterministic sharded writer and its reader.

Records are sorted by ``page_id`` and cut into shards at fixed steps of the
running sum of payload bytes, so the shards depend on the rows alone, not on
Spark's partitions.  A shard is written by one task as gzip members (one per
record, no timestamps) to files that roll at a compressed size.  A file gets
its final name only when complete, from a temporary name of the task attempt;
attempts that run again write the same bytes to the same names.  The manifest
(a table of the files) is written last by Spark's own commit; an archive
without it is unfinished and is not read.

Of records with equal payloads, that with the largest ``page_id`` is the
response, the others are revisits that refer to it.  A group of equal payloads
is aggregated by digest before its members are told, and the members learn it
through marker rows that sort beside their record, so payloads are shuffled
once.

Null ``html`` is an empty payload.  A null ``page_id`` is never a revisit and
never referred to (nothing names it); such rows are dealt to shards of their
own by the hash of URL and payload.  Of repeated rows (same id and payload)
the first is the response and the rest revisit it.  A null ``url`` leaves out
the target URI.  An empty table gives an archive without files.  Other columns
are not written.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, staged

#: Payload bytes of a shard, and compressed bytes after which a file rolls.
SHARD_BYTES = 32 << 20
ROLL_BYTES = 8 << 20
#: Files of a manifest that are sent to all executors; a longer one is joined.
LISTED_FILES = 100_000
DATE = "2026-01-01T00:00:00Z"
SOFTWARE = "pricelens warc writer"
_NS = uuid.UUID("6f1c8a54-93cf-4a83-9a0c-7be9a1d5a2f1")
_MANIFEST = "file string, shard long, records long, bytes long, sha1 string, first_page_id long, last_page_id long"
_RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, digest: str, url: str | None, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NS, f'{page_id}|{digest}|{url if page_id is None else ''}|{copy}')}>"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("WARC-Block-Digest", f"sha1:{_sha1(block)}"), ("Content-Length", str(len(block)))])
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _line(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in value)


class _File:
    """One rolling file: written under a temporary name, named when closed."""

    def __init__(self, store: fs.FileSystem, folder: str, shard: int, seq: int):
        self.store, self.name = store, f"pages-{shard:06d}-{seq:05d}.warc.gz"
        t = TaskContext.get()
        self.temp, self.final = f"{folder}/_{t.taskAttemptId() if t else 0}-{uuid.uuid4().hex}-{self.name}", f"{folder}/{self.name}"
        self.out, self.sha, self.shard = store.open_output_stream(self.temp, compression=None), hashlib.sha1(), shard
        self.bytes = self.records = 0
        self.ids: list[int] = []
        info = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\n".encode()
        self.put(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NS, self.name)}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))

    def put(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)

    def add(self, member: bytes, page_id: int | None) -> None:
        self.put(member)
        self.records += 1
        if page_id is not None:
            self.ids = [self.ids[0] if self.ids else page_id, page_id]

    def close(self) -> tuple:
        self.out.close()
        self.store.move(self.temp, self.final)
        return (self.name, self.shard, self.records, self.bytes, self.sha.hexdigest(), *(self.ids or [None, None]))


def _shards(records: DataFrame, shard_bytes: int) -> list[int]:
    """First ``page_id`` of each shard: steps of the running sum of bytes in id order.

    The sum is exact whatever the partitions: it is taken within range-sorted
    parts of a staged narrow table, plus the parts before.  The driver gets
    one row per part and one per shard.
    """
    ids = staged(records.where(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.sum("n_bytes").alias("n"))
                 .repartitionByRange("page_id").withColumn("part", F.spark_partition_id()), "warc-ids")
    parts = sorted((r["first"], r["part"], r["n"]) for r in ids.groupBy("part").agg(F.min("page_id").alias("first"), F.sum("n").alias("n")).collect())
    before, total = {}, 0
    for _, part, n in parts:
        before[part] = total
        total += n
    if not before:
        return []
    offsets = records.sparkSession.createDataFrame(list(before.items()), "part int, before long")
    running = F.sum("n").over(Window.partitionBy("part").orderBy("page_id")) - F.col("n") + F.col("before")
    starts = ids.join(F.broadcast(offsets), "part").select("page_id", F.floor(running / F.lit(shard_bytes)).alias("shard"))
    return sorted(r[0] for r in starts.groupBy("shard").agg(F.min("page_id")).select("min(page_id)").collect())


def write_archive(pages: DataFrame, root: str | None = None, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> str:
    """Write ``pages`` (page_id, url, html) as WARC files; returns the archive's folder."""
    spark = pages.sparkSession
    root = root or new_folder(spark, "warc")
    records = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    narrow = records.select("page_id", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha1("payload").alias("digest"))
    groups = staged(narrow.where(F.col("page_id").isNotNull()).groupBy("digest")
                    .agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-groups")
    starts = _shards(narrow, shard_bytes)
    # rows without an id have no order: they are dealt by hash to as many further shards as their bytes ask for
    unnamed = narrow.where(F.col("page_id").isNull()).agg(F.sum("n_bytes")).first()[0]
    named, loose = len(starts), 0 if unnamed is None else -(-unnamed // shard_bytes) or 1
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * (named + loose))
    markers = (narrow.join(groups, "digest").where(F.col("page_id") < F.col("refers_to")).distinct()
               .select("page_id", F.lit(0).alias("kind"), "digest", "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload")))
    rows = records.select("page_id", F.lit(1).alias("kind"), F.sha1("payload").alias("digest"), F.lit(None).cast("long").alias("refers_to"), "url", "payload").unionByName(markers)
    cuts = spark.sparkContext.broadcast(np.array(starts, dtype=np.int64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            shard = np.maximum(np.searchsorted(cuts.value, ids, "right") - 1, 0)
            if b.column(0).null_count:
                spread = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False) % loose + named
                shard = np.where(b.column(0).is_null().to_numpy(zero_copy_only=False), spread, shard)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(shard, pa.int64())], [*b.schema.names[:-1], "shard"])

    store, folder = fs.FileSystem.from_uri(root)
    store.create_dir(f"{folder}/data", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(root)
        out, seq, shard, done = None, 0, -1, []
        marker, last, copies = (None, None, None), None, 0
        for b in batches:
            for page_id, kind, digest, refers_to, url, payload, at in zip(*(c for c in b.columns), strict=True):
                page_id, digest, at = page_id.as_py(), digest.as_py(), at.as_py()
                if not kind.as_py():
                    marker = (page_id, digest, refers_to.as_py())
                    continue
                if at != shard or out is None or out.bytes >= roll_bytes:
                    if out is not None:
                        done.append(out.close())
                    seq = seq + 1 if at == shard else 0
                    out, shard = _File(store, f"{folder}/data", at, seq), at
                payload, url = payload.as_py(), url.as_py()
                copies = copies + 1 if (page_id, digest) == last else 0
                last = (page_id, digest)
                refers = marker[2] if marker[:2] == last else page_id if copies and page_id is not None else None
                sha = _sha1(payload)
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", _record_id(page_id, sha, url, copies)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response")]
                if url is not None:
                    fields.append(("WARC-Target-URI", _line(url)))
                if page_id is not None:
                    fields.append(("X-Page-Id", str(page_id)))
                if refers is not None:
                    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers, sha, url, 0)), ("X-Refers-To-Page-Id", str(refers))]
                out.add(_member(fields, head + payload if refers is None else head), page_id)
        if out is not None:
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "shard", "records", "bytes", "sha1", "first_page_id", "last_page_id"), x, strict=True)) for x in done], schema=_MANIFEST_ARROW)

    rows = rows.withColumn("spread", F.shiftrightunsigned(F.xxhash64("url", "digest"), 1))
    placed = rows.mapInArrow(place, "page_id long, kind int, digest string, refers_to long, url string, payload binary, shard long")
    (placed.repartitionByRange(parts, "shard").sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
     .mapInArrow(write, _MANIFEST).write.parquet(f"{root}/manifest"))
    return root


_MANIFEST_ARROW = pa.schema([("file", pa.string()), ("shard", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string()), ("first_page_id", pa.int64()), ("last_page_id", pa.int64())])


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")


def _parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while line := stream.readline().rstrip(b"\r\n"):
            k, _, v = line.decode().partition(": ")
            head[k.lower()] = v
        block = stream.read(int(head["content-length"]))
        if stream.read(4) != b"\r\n\r\n" or head["warc-block-digest"] != f"sha1:{_sha1(block)}":
            raise ValueError(f"damaged record {head.get('warc-record-id')}")
        yield head, block


def read_archive(spark: SparkSession, root: str, payload: bool = True) -> DataFrame:
    """The records of an archive; ``payload`` is null for revisits or when not asked for.

    Only the files of the manifest are read, whatever else lies beside them.
    Their sizes and digests, and those of all records, are checked.
    """
    files = manifest(spark, root).select("file", "bytes", "sha1")
    data = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"{root}/data").withColumn("file", F.element_at(F.split("path", "/"), -1))
    missing = files.select("file", "bytes").exceptAll(data.select("file", F.col("length").alias("bytes"))).count()
    if missing:
        raise ValueError(f"{missing} files of the manifest are missing or of another size in {root}")
    listed = files.select("file", "sha1")
    if listed.count() <= LISTED_FILES:
        listed = F.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, sha1 in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                rows = []
                if hashlib.sha1(memoryview(content.as_buffer())).hexdigest() != sha1:
                    raise ValueError("a file differs from the manifest")
                for head, block in _parse(gzip.GzipFile(fileobj=io.BytesIO(memoryview(content.as_buffer())))):
                    if head["warc-type"] == "warcinfo":
                        continue
                    http, _, body = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    if head["warc-type"] == "response" and (len(body) != size or head["warc-payload-digest"] != f"sha1:{_sha1(body)}"):
                        raise ValueError(f"damaged payload {head['warc-record-id']}")
                    page, ref = head.get("x-page-id"), head.get("x-refers-to-page-id")
                    rows.append((page and int(page), head.get("warc-target-uri"), head["warc-type"], size, head["warc-payload-digest"].removeprefix("sha1:"), ref and int(ref), body if payload and head["warc-type"] == "response" else None))
                    if len(rows) == 256:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return data.join(listed, "file").select("content", "sha1").mapInArrow(run, _RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])
