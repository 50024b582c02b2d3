import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest

from pricelens.llm import shards as S


def plain(key, weights):
    name = "" if key is None else str(key)
    cost = lambda i: -math.log((int(hashlib.md5(f"{name}:{i}".encode()).hexdigest()[:S.DIGITS], 16) + 0.5) / 16 ** S.DIGITS) / weights[i]
    return min((cost(i), i) for i in range(len(weights)) if weights[i])[1]


def check(got, rows, weights, grown):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows if d is not None)
    by = defaultdict(list)
    for r in got:
        assert r.shard == plain(r.doc_id, weights) and r.grown_shard == plain(r.doc_id, grown)
        by[r.shard].append(r)
    for own in by.values():
        own.sort(key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        keys = [(r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in own]
        assert keys == sorted(keys)


def test_against_plain_python(spark):
    rows = [(i, f"text {i} é" * (i % 4)) for i in range(400)] + [(7, "again")] * 150 + [(None, "x")] * 40 + [(401, None), (402, ""), (403, "long " * 50_000)]
    d = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, shard string, slot int").repartition(6)
    got = S.shard_rows(d, [1.0] * 10, [1.0] * 11).collect()
    check(got, rows, [1.0] * 10, [1.0] * 11)


def test_growing_moves_rows_into_the_new_shard_only(spark):
    d = spark.range(4000).selectExpr("id doc_id", "'x' text")
    got = S.shard_rows(d, [1.0] * 40, [1.0] * 41).collect()
    moved = [r for r in got if r.shard != r.grown_shard]
    assert all(r.grown_shard == 40 for r in moved) and 50 < len(moved) < 160


def test_weights(spark):
    d = spark.range(6000).selectExpr("id doc_id")
    n = Counter(r.shard for r in S.assign(d, [1, 2, 0, 3], "doc_id").collect())
    assert 2 not in n and abs(n[1] / n[0] - 2) < 0.25 and abs(n[3] / n[0] - 3) < 0.35
    for bad in ([], [0, 0], [1, -1]):
        with pytest.raises(ValueError):
            S.shard_of(d["doc_id"], bad)


def test_written_shards_keep_all_columns(spark, tmp_path):
    d = spark.createDataFrame([(i % 50, f"t{i}", "own", i) for i in range(500)], "doc_id long, text string, shard string, _at int")
    back = S.write_shards(d, str(tmp_path / "out"), [1.0] * 4, max_rows=20)
    assert sorted(map(tuple, back.select(*d.columns).collect())) == sorted(map(tuple, d.collect()))
    assert all(r.shard_ == plain(r.doc_id, [1.0] * 4) for r in back.collect())


def test_empty_table(spark):
    assert S.shard_rows(spark.createDataFrame([], "doc_id long, text string"), [1.0], [1.0, 1.0]).count() == 0
