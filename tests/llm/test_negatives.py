import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.llm import negatives as N


def brute(rows, anchor):
    ok, seen = [], set()
    for v, e, l in rows:
        if v is None or l is None or not e or any(x is None or not math.isfinite(x) for x in e):
            continue
        ok.append((v, l, tuple(math.floor(256 * x) for x in e)))
    out = []
    for a in ok:
        if not anchor(a[0]) or a in seen:
            continue
        seen.add(a)
        score = lambda r: sum(x * y for x, y in zip(a[2], r[2], strict=True))
        rest = [(-score(r), r[0], r[1] == a[1]) for r in ok if r[0] != a[0] and len(r[2]) == len(a[2])]
        for s, p, _ in sorted(x for x in rest if x[2])[:5]:
            fit = sorted(x for x in rest if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s)[:5]
            out += [(a[0], p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fit)]
    return sorted(out)


def vectors(seed, n=420, dim=20, wide=1.0):
    rng = random.Random(seed)
    centre = [[rng.gauss(0.3 * wide, wide) for _ in range(dim)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.3 * wide) for x in rng.choice(centre)], rng.randrange(4)) for i in range(n)]
    rows += [(1000 + i, rows[0][1], rows[0][2] if i % 2 else 3) for i in range(160)]  # one vector, many times
    return rows


def odd(dim):
    x = [0.5] * dim
    return [(None, x, 1), (2000, None, 1), (2010, x, None), (2020, [], 1), (2030, [None, *x[1:]], 1), (2040, [math.nan, *x[1:]], 1), (2050, [math.inf, *x[1:]], 1),
            (2060, x + [1.0], 1), (2061, x + [2.0], 1), (2062, x + [1.9], 2), (2070, x, 1), (2070, x, 1), (2070, x, 2), (2071, x, 1), (2071, x, 1), (2080, [-v for v in x], 7), (2081, [1.0] * dim, 9)]


@pytest.mark.parametrize("seed,block,group,strip,wide", [(1, 4096, 16_384, 256, 1.0), (2, 50, 9, 4, 3000.0)])
def test_against_brute_force(spark, monkeypatch, seed, block, group, strip, wide):
    for name, value in (("BLOCK", block), ("GROUP", group), ("STRIP", strip)):
        monkeypatch.setattr(N, name, value)
    rows = vectors(seed, wide=wide) + odd(20)
    random.Random(seed).shuffle(rows)
    d = spark.createDataFrame([(*r, "x", b"d") for r in rows], "vec_id long, embedding array<double>, label int, key string, data binary").repartition(5)
    got = N.hard_negatives(N.quantised(d), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, lambda v: v % 10 == 0)
    assert len(want) > 200 and sorted(map(tuple, got.collect())) == want


def test_bounds_hold_and_skip():
    rng = np.random.default_rng(3)
    base = rng.normal(0, 200, (8, 33))
    q = np.floor(base[rng.integers(0, 8, 600)] + rng.normal(0, 8, (600, 33))).astype(np.int64)
    side = N._Side(q, *N.summaries(q))
    s = N.scores(q, q)
    left = []
    for (summary, n), mean in zip(side.levels, N.LEVELS, strict=True):
        least, most = N.bounds(summary, summary, n)
        assert (least <= s).all() and (s <= most).all()
        left.append((most - least).mean())
    assert left[0] > left[1] > left[2]  # finer segments, closer bounds
    fifth = np.sort(s, axis=1)[:, -5].astype(float)
    i, j, got = N.open_pairs(side, side, np.ones(s.shape, bool), fifth, np.full(600, np.inf), 5)
    assert {(a, b) for a, b in zip(i.tolist(), j.tolist())} == set(zip(*(x.tolist() for x in np.nonzero(s >= fifth[:, None])))) and (got == s[i, j]).all()
    least, most = N.bounds(side.levels[-1][0], side.levels[-1][0], side.levels[-1][1])
    assert (most >= fifth[:, None]).mean() < 0.6  # the finest bounds skip pairs


def test_empty_table(spark):
    d = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert N.hard_negatives(N.quantised(d), F.col("vec_id") % 100 == 0).count() == 0
