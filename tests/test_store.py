"""Upsert, change-only history, drops, active flags, saved searches, retention
(through the versioned store, one scan per commit)."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pricelens.operators import history as H
from pricelens.operators import searches as SE
from pricelens.sources.store import ListingStore
from tests.conftest import T0, T1
from tests.helpers import batch, listing, report, rows


def _store(spark, tmpdir_path):
    return ListingStore(spark, tmpdir_path, buckets=4)


def _scan(store, spark, items, complete=True):
    comp = None
    if not complete:
        comp = spark.createDataFrame([(q, False) for q in {i["query"] for i in items}],
                                     "query string, complete boolean")
    _scan.n = getattr(_scan, "n", 0) + 1
    store.apply_scan(batch(spark, items), f"scan{_scan.n}", comp)


def test_change_only_history(spark, tmpdir_path):
    s = _store(spark, tmpdir_path)
    _scan(s, spark, [listing(111, 5000), listing(222, 7000)])
    _scan(s, spark, [listing(111, 4200, T1), listing(222, 7000, T1)])
    h = rows(s.read("price_history"), "listing_id", "price", order=["listing_id", "seen_at"])
    assert h == [("111", 5000), ("111", 4200), ("222", 7000)]


def test_drop_found_rise_not(spark, tmpdir_path):
    s = _store(spark, tmpdir_path)
    _scan(s, spark, [listing(111, 5000), listing(222, 7000)])
    _scan(s, spark, [listing(111, 4000, T1), listing(222, 7500, T1)])
    d = H.price_drops(s.read("price_history"), s.read("listings"), limit=10)
    assert rows(d, "listing_id", "previous_price", "current_price") == [("111", 5000, 4000)]


def test_history_is_per_query(spark, tmpdir_path):
    s = _store(spark, tmpdir_path)
    _scan(s, spark, [listing(111, 5000)])
    _scan(s, spark, [listing(111, 4000, T1, query="iphone 13 pro")])
    assert H.price_drops(s.read("price_history"), s.read("listings")).count() == 0
    h = rows(s.read("price_history"), "query", "price", order=["query"])
    assert h == [("iphone 13", 5000), ("iphone 13 pro", 4000)]


def test_unpriced_not_recorded(spark, tmpdir_path):
    s = _store(spark, tmpdir_path)
    _scan(s, spark, [listing(333, None)])
    assert s.read("price_history").count() == 0
    assert s.read("listings").count() == 1


def test_missing_goes_inactive_and_back(spark, tmpdir_path):
    s = _store(spark, tmpdir_path)
    _scan(s, spark, [listing(111), listing(222)])
    _scan(s, spark, [listing(111)])
    act = lambda: sorted(r[0] for r in s.read("listings").filter("is_active").select("id").collect())
    assert act() == ["111"]
    _scan(s, spark, [listing(111), listing(222, 6800)])
    assert act() == ["111", "222"]


def test_partial_scan_keeps_active(spark, tmpdir_path):
    s = _store(spark, tmpdir_path)
    _scan(s, spark, [listing(111), listing(222)])
    _scan(s, spark, [listing(111)], complete=False)
    assert s.read("listings").filter("is_active").count() == 2


def test_inactive_not_in_drops(spark, tmpdir_path):
    s = _store(spark, tmpdir_path)
    _scan(s, spark, [listing(111, 5000)])
    _scan(s, spark, [listing(111, 4000, T1)])
    _scan(s, spark, [listing(999, 9000, T1)])
    assert H.price_drops(s.read("price_history"), s.read("listings")).count() == 0


def test_kept_report(spark, tmpdir_path):
    s = _store(spark, tmpdir_path)
    _scan(s, spark, [listing(555, 5000, report=report(8, summary="fine"), composite=70.0)])
    _scan(s, spark, [listing(555, 4800, T1)])
    r = s.read("listings").collect()[0]
    assert r["price_nok"] == 4800
    assert r["ai_report"]["condition_score"] == 8
    assert r["composite_score"] == 70.0


def test_large_deactivation(spark, tmpdir_path):
    s = _store(spark, tmpdir_path)
    _scan(s, spark, [listing(i) for i in range(1500)])
    _scan(s, spark, [listing(i, at=T1) for i in range(1000)])
    l = s.read("listings")
    assert l.filter("is_active").count() == 1000
    assert not l.filter("id = '1200'").collect()[0]["is_active"]


def test_saved_searches(spark, tmpdir_path):
    s = _store(spark, tmpdir_path)
    _scan(s, spark, [listing(111), listing(222)])
    _scan(s, spark, [listing(333, at=T1, query="macbook air")])
    _scan(s, spark, [listing(111, at=T1)])
    got = rows(SE.saved_searches(s.read("listings")), "query", "n_active")
    assert sorted(got) == [("iphone 13", 1), ("macbook air", 1)]


def test_histories_of_one_id(spark, tmpdir_path):
    s = _store(spark, tmpdir_path)
    _scan(s, spark, [listing(111, 5000), listing(777, 100)])
    _scan(s, spark, [listing(111, 4500, T1, query="iphone 13 pro")])
    _scan(s, spark, [listing(111, 4000, T1)])
    h = H.listing_histories(s.read("price_history"), s.read("listings"), "111")
    assert rows(h.orderBy("query", "seen_at", "seq"), "query", "price") == [("iphone 13", 5000), ("iphone 13", 4000),
                                        ("iphone 13 pro", 4500)]
    assert H.listing_histories(s.read("price_history"), s.read("listings"), "nope").count() == 0


def test_prune_old_inactive(spark, tmpdir_path):
    now = datetime(2026, 9, 1, 12, 0)
    old, recent = now - timedelta(days=90), now - timedelta(days=10)
    s = _store(spark, tmpdir_path)
    _scan(s, spark, [listing(111, 5000, old), listing(222, 6000, old)])
    _scan(s, spark, [listing(222, 6000, recent)])
    assert dict(s.prune(now, 60)) == {"listings": 1, "price_history": 1}
    assert sorted(r[0] for r in s.read("listings").select("id").collect()) == ["222"]
    assert s.read("price_history").count() == 1


def test_prune_keeps_recent_active_and_zero_days(spark, tmpdir_path):
    now = datetime(2026, 9, 1, 12, 0)
    s = _store(spark, tmpdir_path)
    _scan(s, spark, [listing(111, 5000, now - timedelta(days=90))])          # old but active
    _scan(s, spark, [listing(222, 5000, now - timedelta(days=10), query="x")])
    _scan(s, spark, [listing(333, 5000, now - timedelta(days=5), query="x")])  # 222 inactive, recent
    assert dict(s.prune(now, 60)) == {"listings": 0, "price_history": 0}
    assert dict(s.prune(now, 0)) == {"listings": 0, "price_history": 0}
    assert s.read("listings").count() == 3


def test_a_b_a_gives_three_rows(spark, tmpdir_path):
    s = _store(spark, tmpdir_path)
    _scan(s, spark, [listing(1, 100)])
    _scan(s, spark, [listing(1, 90, T1)])
    _scan(s, spark, [listing(1, 100, T1 + timedelta(days=1))])
    assert s.read("price_history").count() == 3
    assert H.price_drops(s.read("price_history"), s.read("listings")).count() == 0


def test_duplicate_keys_in_batch(spark, tmpdir_path):
    s = _store(spark, tmpdir_path)
    _scan(s, spark, [listing(1, 100, composite=50.0), listing(1, 90), listing(1, 90)])
    l = s.read("listings").collect()
    assert len(l) == 1 and l[0]["price_nok"] == 90 and l[0]["composite_score"] == 50.0
    assert rows(s.read("price_history"), "price", order=["seq"]) == [(100,), (90,)]


def test_empty_batch_changes_nothing(spark, tmpdir_path):
    s = _store(spark, tmpdir_path)
    _scan(s, spark, [listing(1), listing(2)])
    _scan(s, spark, [])
    assert s.read("listings").filter("is_active").count() == 2


def test_landed_scans_applied_once(spark, tmpdir_path):
    import os
    from pricelens.streaming.maintenance import apply_landed
    from tests.helpers import batch as mk
    land = os.path.join(tmpdir_path, "landing")
    scans = [[listing(111, 5000), listing(222, 7000)],
             [listing(111, 4000, T1)],
             [listing(111, 3900, T1 + timedelta(days=1)), listing(222, 7000, T1 + timedelta(days=1))]]
    for i, items in enumerate(scans):
        df = mk(spark, items).drop("price_score", "composite_score", "ai_report")
        if i == 1:  # a partial scan: 222 must stay active
            df = df.withColumn("complete", F.lit(False))
        df.write.parquet(os.path.join(land, f"scan-{i:03d}"))
    s = _store(spark, os.path.join(tmpdir_path, "store"))
    assert apply_landed(s, land) == ["scan-000", "scan-001", "scan-002"]
    assert apply_landed(s, land) == []
    assert s.read("listings").filter("is_active").count() == 2
    assert rows(s.read("price_history"), "listing_id", "price", order=["listing_id", "seen_at"]) == \
        [("111", 5000), ("111", 4000), ("111", 3900), ("222", 7000)]


def test_scan_writes_only_its_searches(spark, tmpdir_path):
    s = ListingStore(spark, tmpdir_path, buckets=64)
    _scan(s, spark, [listing(1, query="iphone 13"), listing(2, query="macbook air")])
    s.apply_scan(batch(spark, [listing(1, 4000, T1, query="iphone 13")]), "second")
    part = spark.read.parquet(os.path.join(tmpdir_path, "listings", "scan_id=second"))
    assert [r["query"] for r in part.collect()] == ["iphone 13"]
    got = {r["id"]: (r["price_nok"], r["is_active"]) for r in s.read("listings").collect()}
    assert got == {"1": (4000, True), "2": (5000, True)}


def test_scan_ids_that_end_alike(spark, tmpdir_path):
    s = _store(spark, tmpdir_path)
    for scan_id, price in (("iphone_02", 5000), ("02", 4000), ("2", 3000), ("a/b=c %", 2000)):
        s.apply_scan(batch(spark, [listing(1, price)]), scan_id)
        assert s.applied(scan_id)
    assert sorted(r["price"] for r in s.read("price_history").collect()) == [2000, 3000, 4000, 5000]
    assert s.read("listings").collect()[0]["price_nok"] == 2000


def test_rerun_after_partial_failure_does_not_duplicate(spark, tmpdir_path):
    s = _store(spark, tmpdir_path)
    s.apply_scan(batch(spark, [listing(111, 5000)]), "s1")
    b2 = batch(spark, [listing(111, 4000, T1)])
    s.apply_scan(b2, "s2")
    marker = os.path.join(tmpdir_path, "listings", "scan_id=s2", "_SUCCESS")
    os.rename(marker, marker + ".lost")  # as if the upsert had not finished
    s.apply_scan(b2, "s2")
    assert rows(s.read("price_history"), "price", order=["seen_at"]) == [(5000,), (4000,)]
    assert s.read("listings").collect()[0]["price_nok"] == 4000
    d = H.price_drops(s.read("price_history"), s.read("listings"))
    assert rows(d, "listing_id", "previous_price", "current_price") == [("111", 5000, 4000)]


def test_leftovers_of_failed_jobs_do_not_matter(spark, tmpdir_path):
    s = _store(spark, tmpdir_path)
    s.apply_scan(batch(spark, [listing(1, 5000)]), "s1")
    for table in ("price_history", "listings"):
        left = os.path.join(tmpdir_path, table, "scan_id=s2", "_temporary", "0")
        os.makedirs(left)
        with open(os.path.join(left, "part-00000.parquet"), "w") as f:
            f.write("torn")
    assert s.read("listings").count() == 1 and s.read("price_history").count() == 1
    s.apply_scan(batch(spark, [listing(1, 4000, T1)]), "s2")
    assert rows(s.read("price_history"), "price", order=["seen_at"]) == [(5000,), (4000,)]


def test_retired_keys_can_come_back_and_copy(spark, tmpdir_path):
    now = datetime(2026, 9, 1, 12, 0)
    s = _store(spark, os.path.join(tmpdir_path, "a"))
    _scan(s, spark, [listing(1, 5000, now - timedelta(days=90)), listing(2, 6000, now - timedelta(days=90))])
    _scan(s, spark, [listing(2, 6000, now - timedelta(days=9))])
    assert dict(s.prune(now, 60)) == {"listings": 1, "price_history": 1}
    assert dict(s.prune(now, 60)) == {"listings": 0, "price_history": 0}
    _scan(s, spark, [listing(1, 4000, now), listing(2, 6000, now)])
    want = [("1", 4000), ("2", 6000)]
    assert rows(s.read("price_history"), "listing_id", "price", order=["listing_id"]) == want
    c = s.copy_to(os.path.join(tmpdir_path, "b"))
    assert rows(c.read("price_history"), "listing_id", "price", order=["listing_id"]) == want
    assert rows(c.read("listings"), "id", "price_nok", order=["id"]) == want
    _scan(c, spark, [listing(1, 3000, now)])
    assert c.read("price_history").count() == 3


def test_summaries_equal_the_folded_state(spark, tmp_path):
    """Random scans, complete and partial, a scan that fails before its summary, retention, a compact copy."""
    import random
    from datetime import datetime, timedelta

    from pricelens.operators import searches as SE
    from pricelens.sources.store import ListingStore
    from tests.helpers import batch, listing

    rng = random.Random(8)
    store, t0 = ListingStore(spark, str(tmp_path / "s"), buckets=2), datetime(2026, 1, 1)
    same = lambda st: sorted(map(tuple, SE.saved_searches(st.read("listings")).collect())) == sorted(map(tuple, SE.newest_first(st.summaries()).collect()))
    for n in range(5):
        at = t0 + timedelta(days=20 * n)
        items = [listing(rng.randrange(12), rng.randrange(100, 110), at=at, query=q) for q in rng.sample(["a", "b", "c"], 2) for _ in range(5)]
        rows = batch(spark, items)
        if n == 3:  # fails after the listings: not applied, and repeated
            summarise, store._summarise = store._summarise, lambda *_: None
            store.apply_scan(rows, f"s{n}")
            store._summarise = summarise
            assert not store.applied(f"s{n}")
        store.apply_scan(rows, f"s{n}", prune_missing=n % 2 == 0)
        assert store.applied(f"s{n}")
        store.prune(at, 30)
    assert same(store)
    plan = store.summaries()._jdf.queryExecution().optimizedPlan().toString()
    assert "price_nok" not in plan and len(store.summaries().inputFiles()) > 0 and all("/summaries/" in f for f in store.summaries().inputFiles())
    assert same(store.copy_to(str(tmp_path / "copy")))


def _all(s):
    state = sorted(map(str, s.read("listings").collect()))
    return state, sorted(map(str, s.read("price_history").collect())), sorted(map(str, s.summaries().collect()))


def _folders(s, table):
    return sorted(os.path.basename(x)[8:] for x in os.listdir(f"{s.root}/{table}") if x.startswith("scan_id="))


def test_compaction_in_place(spark, tmpdir_path):
    s = _store(spark, tmpdir_path)
    for name, items in (("a b/1", [listing(111, 5000), listing(222, 7000)]), ("two", [listing(111, 4200, T1)]), ("three", [listing(111, 4100, T1 + timedelta(days=1)), listing(333, 9, T1)])):
        s.apply_scan(batch(spark, items), name)
    assert s.prune(T1 + timedelta(days=70), 60)  # retires 222
    want = _all(s)
    planned = s.read("price_history")
    s.compact()
    assert _all(s) == want and planned.count() == len(want[1])  # a job planned before still finds its files
    s.compact()  # nothing new
    assert _folders(s, "listings").count("~2") == 0
    s.apply_scan(batch(spark, [listing(111, 4300, T1 + timedelta(days=2)), listing(222, 6900, T1 + timedelta(days=2))]), "four")
    want = _all(s)
    assert any("222" in x for x in want[0])
    s.compact()
    assert _all(s) == want
    assert _folders(s, "listings") == _folders(s, "price_history") == ["four", "~1", "~2"]
    s.apply_scan(batch(spark, [listing(111, 4300, T1 + timedelta(days=2))]), "four")  # applied already
    assert _all(s) == want


def test_compaction_that_fails_changes_nothing(spark, tmpdir_path, monkeypatch):
    s = _store(spark, tmpdir_path)
    s.apply_scan(batch(spark, [listing(111, 5000), listing(222, 7000)]), "one")
    s.apply_scan(batch(spark, [listing(111, 4200, T1)]), "two")
    want = _all(s)
    for step in ("_bucket", "_publish", "_delete_but"):
        with monkeypatch.context() as m:
            m.setattr(ListingStore, step, lambda *a: 1 / 0)
            try:
                s.compact()
                raise AssertionError("did not fail")
            except ZeroDivisionError:
                pass
        assert _all(s) == want
    s.apply_scan(batch(spark, [listing(111, 4000, T1 + timedelta(days=1))]), "three")
    want = _all(s)
    s.compact()
    assert _all(s) == want and _folders(s, "listings") == ["three", "~1", "~2"]


def test_compaction_asks_for_whole_scans(spark, tmpdir_path, monkeypatch):
    s = _store(spark, tmpdir_path)
    s.apply_scan(batch(spark, [listing(111, 5000)]), "one")
    with monkeypatch.context() as m:
        m.setattr(ListingStore, "_summarise", lambda *a: 1 / 0)
        try:
            s.apply_scan(batch(spark, [listing(111, 4200, T1)]), "two")
        except ZeroDivisionError:
            pass
    try:
        s.compact()
        raise AssertionError("compacted a scan that is not whole")
    except ValueError as e:
        assert "two" in str(e)
    s.apply_scan(batch(spark, [listing(111, 4200, T1)]), "two")
    s.compact()
    assert rows(s.read("price_history"), "price", order=["seen_at"]) == [(5000,), (4200,)]


def _above(plan, leaf):
    """The operators above each leaf whose line holds ``leaf``."""
    out, path = [], []
    for line in plan.splitlines():
        op = line.lstrip(" :+-")
        depth = len(line) - len(op)
        path = [(d, o) for d, o in path if d < depth] + [(depth, op)]
        if leaf in op:
            out.append([o for _, o in path[:-1]])
    return out


def test_stored_rows_are_never_exchanged(spark, tmpdir_path):
    """Folding the log, price changes and the upsert shuffle the batch only; many searches take the other way."""
    from pricelens.operators import tables as TB
    s = ListingStore(spark, tmpdir_path, buckets=4, clusters=5)
    s.apply_scan(batch(spark, [listing(i, 5000 + i, query=f"q{i % 3}") for i in range(40)]), "one")
    s.apply_scan(batch(spark, [listing(i, 4000 + i, T1, query=f"q{i % 3}") for i in range(20)]), "two")
    path = os.path.join(tmpdir_path, "batch")
    batch(spark, [listing(i, 3000, T1 + timedelta(days=1), query=f"q{i % 3}") for i in range(30)]).write.parquet(path)
    b = spark.read.parquet(path)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        state, few = s._touched(b, "three")
        assert few
        added = TB.append_history_from_state(state, b)
        for df in (s.read("listings"), added, TB.upsert_listings(state, TB.with_recorded_price(b, b.select(F.col("id").alias("listing_id"), "query", F.col("price_nok").alias("price"), "seq")), None, True, few, s.clusters)):
            above = _above(df._jdf.queryExecution().executedPlan().toString(), "Bucketed: true")
            assert above and not [o for ops in above for o in ops if o.startswith("Exchange")]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_many_searches_give_the_same_rows(spark, tmpdir_path, monkeypatch):
    import pricelens.sources.store as ST
    scans = [[listing(i, 5000 + 7 * i * n, T1 + timedelta(days=n), query=f"q{i % 4}") for i in range(n, 12 + n)] for n in range(3)]
    few = _store(spark, os.path.join(tmpdir_path, "few"))
    many = ListingStore(spark, os.path.join(tmpdir_path, "many"), buckets=3, clusters=5)
    for n, items in enumerate(scans):
        few.apply_scan(batch(spark, items), f"s{n}")
    monkeypatch.setattr(ST, "BROADCAST_BYTES", 0)
    for n, items in enumerate(scans):
        many.apply_scan(batch(spark, items), f"s{n}")
    assert _all(few) == _all(many)
    again = ListingStore(spark, many.root, buckets=64, clusters=64)  # the stored layout holds
    assert (again.buckets, again.clusters) == (3, 5) and _all(again) == _all(many)
    assert _all(many.copy_to(os.path.join(tmpdir_path, "copy"), clusters=7)) == _all(many)
