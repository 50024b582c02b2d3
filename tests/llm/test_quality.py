import re
from collections import Counter

import duckdb

from pricelens.llm import quality, queries

LONG = " ".join(f"w{i} the" for i in range(60_000))
ROWS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "a a a a a a"), (6, "the cat sat on the mat. " * 20),
    (7, LONG), (8, "# $ % & | < > * " * 30), (9, "x y z\nx y z\n\n \nq\nx y z"), (9, "x y z\nx y z\n\n \nq\nx y z"),
    (None, " ".join(f"word{i} of the" for i in range(40))), (11, "é\xa0日本 the THE Der"), (12, " ".join(f"Wort{i} und die" for i in range(30)) + "\n" + "same line here\nsame line here"),
]


def brute(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    tri = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_measures_and_verdict(spark):
    d = spark.createDataFrame([(i, t, "x", 5) for i, t in ROWS], "doc_id long, text string, n_words string, KEPT int")
    got = quality.quality_rules(d.drop("KEPT", "n_words"))
    rows = sorted(got.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    for r, (i, t) in zip(rows, sorted(ROWS, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), i
        n = r.n_words
        assert r.base_failed == (n < 50 or 100 * r.n_repeat_words > 50 * n)
        assert not (r.base_failed and r.kept)
    by = {r.doc_id: r.kept for r in rows}
    assert by[None] and by[12] and not by[8] and not by[1] and not by[5]


def test_clashing_columns_are_replaced(spark):
    d = spark.createDataFrame([("the cat", "x", 7)], "text string, kept string, n_words int")
    r = quality.quality_rules(d).collect()[0]
    assert r.n_words == 2 and r.kept is False


def test_empty_table_and_sql(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert quality.quality_rules(d.limit(0)).count() == 0
    con = duckdb.connect()
    con.register("documents", d.toPandas())
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE['op7_quality_rules']})").fetchall()
    got = quality.quality_rules(d).select(*cols).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_no_user_functions(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = quality.quality_rules(d)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Exchange"))


def test_helper_names_stay(spark):
    d = spark.createDataFrame([(1, "a b c a b c", "w", "l", "s", "p")], "doc_id long, text string, _w string, _l string, _s string, _p string")
    (r,) = quality.measures(d).collect()
    assert (r._w, r._l, r._s, r._p) == ("w", "l", "s", "p") and r.n_words == 6 and r.n_repeat_words == 6
    assert quality.quality_rules(d.limit(0)).count() == 0
