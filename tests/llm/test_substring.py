import random
import re

import pytest

from pricelens.llm import substring as S


def brute(rows, width):
    words = [re.findall("[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = {}
    for k, w in enumerate(words):
        for i in range(len(w) - width + 1):
            seen.setdefault(tuple(w[i:i + width]), []).append((k, i))
    gone = [[False] * len(w) for w in words]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i:i + width] = [True] * width
    return sorted(((d, len(w), sum(g), " ".join(x for x, y in zip(w, g, strict=True) if not y)) for (d, _), w, g in zip(rows, words, gone, strict=True)), key=str)


def corpus(seed, vocabulary, width):
    rng = random.Random(seed)
    word = lambda: rng.choice(["é", "W", "w"]) + str(rng.randrange(vocabulary))
    passages = [[word() for _ in range(rng.randint(width - 2, 3 * width))] for _ in range(6)]
    common = [word() for _ in range(width // 2)]
    rows = [(900, None), (901, ""), (902, " \t\n"), (903, "a " * (width - 1)), (904, "a " * (3 * width)), (905, "same text " * width), (905, "same text " * width), (None, "q r s " * width)]
    for i in range(60):
        t = []
        for _ in range(rng.randint(1, 4)):
            t += [word() for _ in range(rng.randint(0, 2 * width))]
            t += rng.choice([*passages, common, common])
        rows.append((i, rng.choice([" ", "\n", "  "]).join(t)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,gram,vocabulary,hot,index_words,block", [(35, 8, 5000, 20_000, 400_000, 8 << 20), (6, 3, 60, 2, 40, 400), (9, 3, 4, 3, 100, 2000), (35, 8, 3, 4, 500, 1500)])
def test_words_of_repeated_windows_go(spark, monkeypatch, width, gram, vocabulary, hot, index_words, block):
    monkeypatch.setattr(S, "BLOCK_BYTES", block)
    rows = corpus(width + vocabulary, vocabulary, width)
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string").repartition(4)
    got = S.dedup(d, width=width, gram=gram, hot=hot, index_words=index_words).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(rows, width)
    assert all(r.n_removed == sum(s.end - s.start for s in r.removed) for r in got)


def test_empty_table_and_bad_sizes(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert S.dedup(d).count() == 0
    with pytest.raises(ValueError):
        S.dedup(d, width=200)
