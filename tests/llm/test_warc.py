import base64
import glob
import gzip
import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from pricelens.llm import queries, warc

ROWS = [(1, "u1", "x"), (2, None, "x"), (2, None, "x"), (3, "u\r\n3", None), (4, "é", ""), (None, "n", "x"), (None, None, None), (9, "z", "é\r\n\r\nWARC/1.1\r\n"), (5, "a", "x"), (6, "long", "ab" * 300_000)]


def archive(spark, tmp, rows=ROWS, parts=3, **k):
    d = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(parts)
    return warc.write_archive(d, f"file://{tmp}", **k)


def brute(rows):
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    seen, out = set(), []
    for i, _, h in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        p = (h or "").encode()
        again = (i, h or "") in seen
        seen.add((i, h or ""))
        refers = None if i is None else top[h or ""] if i != top[h or ""] or again else None
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_round_trip_and_edges(spark, tmp_path):
    root = archive(spark, tmp_path / "a", shard_bytes=8, roll_bytes=500)
    got = warc.read_archive(spark, root)
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == brute(ROWS)
    by = {r.page_id: r for r in got.collect()}
    assert by[9].payload.decode() == ROWS[7][2] and by[6].payload.decode() == ROWS[9][2] and by[3].url == "u%0D%0A3"
    files = warc.manifest(spark, root).collect()
    assert len(files) > 4 and sum(f.records for f in files) == len(ROWS)
    assert not [f for f in glob.glob(str(tmp_path / "a/data/*")) if os.path.basename(f).startswith("_")]


def test_same_rows_give_the_same_files(spark, tmp_path):
    a, b = (sorted(map(tuple, warc.manifest(spark, archive(spark, tmp_path / n, parts=p, shard_bytes=8, roll_bytes=500)).collect())) for n, p in (("a", 1), ("b", 5)))
    assert a == b


def test_records_are_separate_gzip_members(spark, tmp_path):
    archive(spark, tmp_path / "a", rows=[(1, "u", "hello"), (2, "v", "hello")])
    (f,) = glob.glob(str(tmp_path / "a/data/*.warc.gz"))
    text = gzip.decompress(open(f, "rb").read()).decode()
    assert text.count("WARC/1.1\r\n") == 3 and text.count("hello") == 1 and text.index("X-Page-Id: 1") < text.index("X-Page-Id: 2")


def test_damage_and_missing_files_are_told(spark, tmp_path):
    root = archive(spark, tmp_path / "a", rows=ROWS[:1])
    (f,) = glob.glob(str(tmp_path / "a/data/*.warc.gz"))
    whole = open(f, "rb").read()
    with open(f, "wb") as out:
        out.write(whole[:-9])
    with pytest.raises(ValueError, match="missing or of another size"):
        warc.read_archive(spark, root)
    with pytest.raises(Exception, match="(?i)path"):
        warc.read_archive(spark, f"file://{tmp_path}/none").count()


def test_empty_table_and_sql(spark, tmp_path):
    assert warc.read_archive(spark, archive(spark, tmp_path / "a", rows=ROWS[:1]).replace("/a", "/a")).count() == 1
    d = spark.createDataFrame(ROWS[:1], "page_id long, url string, html string").limit(0)
    assert warc.read_archive(spark, warc.write_archive(d, f"file://{tmp_path}/e")).count() == 0
    rows = [r for r in ROWS if r[0] not in (None, 2)]
    con = duckdb.connect()
    con.register("pages", spark.createDataFrame(rows, "page_id long, url string, html string").toPandas())
    cols = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    assert sorted(con.execute(f"SELECT {cols} FROM ({queries.ORACLE['op2_warc']})").fetchall(), key=str) == brute(rows)


def test_rows_without_id_fill_shards_of_their_own(spark, tmp_path):
    rows = [(None if i % 10 else i, f"u{i}", "x" * 300 + str(i)) for i in range(2000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    root = warc.write_archive(d, (tmp_path / "a").as_uri(), shard_bytes=20_000)
    n = [r.records for r in warc.manifest(spark, root).collect()]
    assert sum(n) == 2000 and len(n) > 25 and max(n) < 130
    assert warc.read_archive(spark, root).where("record_type = 'response'").count() == 2000


def test_reader_keeps_to_the_manifest(spark, tmp_path):
    import shutil

    d = spark.createDataFrame([(i, f"u{i}", f"p{i}") for i in range(50)], "page_id long, url string, html string")
    root = warc.write_archive(d, (tmp_path / "a").as_uri())
    (name,) = [r.file for r in warc.manifest(spark, root).collect()]
    shutil.copy(tmp_path / "a" / "data" / name, tmp_path / "a" / "data" / "pages-000009-00000.warc.gz")
    assert warc.read_archive(spark, root).count() == 50  # the stray file isn't read
    good = warc.manifest(spark, root)
    damaged = good.withColumn("sha1", F.reverse("sha1")).collect()
    spark.createDataFrame(damaged, good.schema).write.mode("overwrite").parquet(f"{root}/manifest")
    with pytest.raises(Exception, match="differs from the manifest"):
        warc.read_archive(spark, root).count()
