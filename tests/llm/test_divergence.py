import random
import re
from collections import Counter, defaultdict

import pytest

from pricelens.llm import divergence as D


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(rows, ranks=200):
    docs, tf, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((t or "", x or "", s or "") for t, x, s in rows):
        groups[lang].add(source)
        tf[lang, source].update(terms(text))
        docs[lang].update(set(terms(text)))
    f = lambda p, q: (p - q) * (p - q) // q
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]
        share = {}
        for s in sources:
            n = sum(tf[lang, s][t] for t in kept)
            share[s] = {t: 1 + 10 ** 9 * (tf[lang, s][t] + 1) // (n + len(kept)) for t in kept}
        total = {t: sum(tf[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + 10 ** 9 * (total[t] + 1) // (sum(total.values()) + len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum(f(share[s][t], share[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            own = [(-f(share[s][t], q[t]), t.encode()) for t in kept if tf[lang, s][t] and share[s][t] > q[t]]
            for part, got in (("pair", sorted(pairs)), ("term", sorted(own)[:ranks])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(got)]
    return sorted(out)


def corpus(seed, n=250):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in ("a", "é", "UN", "o") for c in ("r", "-s", "t1", "ß", "L x")]
    rows = []
    for _ in range(n):
        source = "hot" if rng.random() < 0.4 else rng.choice(["s1", "s2", "S 3", "s4", "s5", None, "quiet"])
        text = " ".join(rng.choice(words[:5 + 10 * len(source or "")]) for _ in range(rng.randrange(30))) if source != "quiet" else rng.choice(["", "12 34", None])
        rows.append((text, rng.choice(["en", "de", "x\0y", None]), source))
    rows += rows[:9] * 3 + [("only here", "rare", "a"), ("or there", "rare", "b"), (None, "bare", "a"), ("word " * 40_000 + "Ends", "en", "long"), ("中文 中文 Ñ", "en", "s1")]
    return rows


@pytest.mark.parametrize("seed,block,page,tile,pairs,sums", [(1, 24 << 20, 4096, 1024, 1 << 20, 1 << 20), (2, 1500, 3, 2, 7, 5)])
def test_against_brute_force(spark, monkeypatch, seed, block, page, tile, pairs, sums):
    for name, value in (("BLOCK_BYTES", block), ("PAGE", page), ("TILE", tile), ("PAIRS", pairs), ("SUMS", sums)):
        monkeypatch.setattr(D, name, value)
    rows = corpus(seed)
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(3)
    assert sorted(map(tuple, D.audit(d, term_ranks=20).collect())) == brute(rows, 20)


def test_empty_table(spark):
    assert D.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
