import random
import re

import pytest

from pricelens.llm import jaccard as J


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and 100 * o >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if find(k) == find(i) and rows[k][0] is not None]
        out.append((d, len(sets[i]), min(ids) if sets[i] and ids else d))
    return sorted(out, key=str)


def corpus(seed, groups=14):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    line = [word() for _ in range(14)]
    rows = [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two"), (905, "a b c d e"), (906, "a b c d e"), (None, "a b c d E"), (907, None), (907, None), (908, "x " * 3000), (909, "x " * 40)]
    i = 0
    for g in range(groups):
        base = [word() for _ in range(rng.choice([7, 20, 60, 150]))]
        for _ in range(rng.randint(1, 9)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.3:
                t = line + t
            rows.append((i, " ".join(t)))
            i += rng.randint(0, 1) or 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,part,pair,block", [(1, 20_000, 256, 16 << 20), (2, 2, 1, 3000), (3, 3, 2, 500)])
def test_components(spark, monkeypatch, seed, part, pair, block):
    monkeypatch.setattr(J, "LIST_PART", part)
    monkeypatch.setattr(J, "PAIR_PART", pair)
    monkeypatch.setattr(J, "BLOCK_BYTES", block)
    rows = corpus(seed)
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, sig string").repartition(3).select("doc_id", "text", "sig")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(d).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_chain_across_components_and_hub_bounds(spark, monkeypatch):
    """A drifting chain: neighbours link, far members don't, no single centre."""
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 6:i * 6 + 100])) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(d).collect()]
    assert sorted(got, key=str) == brute(rows) and {r[2] for r in got} == {0}


def test_one_of_each(spark):
    base = " ".join(f"w{i}" for i in range(50))
    rows = [(5, base, "x"), (3, base + " end", "x"), (3, base + " end", "x"), (7, "other words in this text only", "x"), (8, None, "x"), (None, base.upper(), "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, comp string")
    kept = J.one_of_each(d)
    assert kept.columns == d.columns and sorted((r.doc_id, r.text) for r in kept.where("text IS NOT NULL").collect()) == [(3, base + " end"), (7, rows[3][1])]


def test_one_of_each_keeps_clashing_columns_and_picks_among_ties(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(50))
    rows = [(2, base, "A", 10 * i, f"l{i % 3}", "f", "p") for i in range(200)] + [(i, base + f" x{i}", "B", i, "e", "f", "p") for i in range(3, 90)] + [(400 + i, f"text {i}", "C", i, "d", "g", "q") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _id string, _key long, lang string, file string, place string").repartition(5)
    d.write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    want = [r for r in rows if r[2] == "C"]
    for kept in (J.one_of_each(stored, flag_bytes=8), J.one_of_each(d)):
        got = [tuple(r) for r in kept.collect()]
        assert sorted(r for r in got if r[2] == "C") == sorted(want)
        (one,) = [r for r in got if r[2] != "C"]
        assert one in rows and one[0] == 2
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.near_duplicates(empty).count() == 0 and J.one_of_each(empty).count() == 0
