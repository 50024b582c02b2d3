import os
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricelens.llm import language

SF = "/root/testdata/sf0.01"


def corpus(spark):
    en = "the quick brown fox jumps over the lazy dog and runs through the forest with friends"
    de = "der schnelle braune Fuchs springt über den faulen Hund und läuft durch den Wald mit Freunden"
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de", "s") for i in range(60)]
    rows += [(100, None, "en", "s"), (101, "", "de", "s"), (102, "123 --- 456", None, None), (103, "der Hund", None, "x"),
             (104, "THE FOREST", None, "x"), (105, "a", None, "x"), (None, "the friends", None, "x"), (103, "der Hund", None, "x"), (106, "ÜBER DEN", None, "x")]
    rows.append((107, "the dog and the fox " * 40_000, None, "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")


def test_predictions_and_edges(spark):
    got = {r.doc_id: r for r in language.identify(corpus(spark)).collect()}
    assert got[100].lang_pred == got[101].lang_pred == got[102].lang_pred == "und" and got[100].score == got[102].score == 0.0
    assert got[103].lang_pred == "de" and got[104].lang_pred == "en" and got[None].lang_pred == "en" and got[106].lang_pred == "de" and got[107].lang_pred == "en"
    assert got[105].lang_pred in ("de", "en")
    assert all(0 <= r.score <= 1 for r in got.values())


def test_no_labels_and_empty_table(spark):
    d = corpus(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(d).select("lang_pred").distinct().collect()} == {"und"}
    assert language.identify(d.limit(0)).count() == 0


def test_lang_is_no_input_of_a_prediction(spark):
    d = corpus(spark)
    m = language.train(d)
    a = language.predict(d, m).select("doc_id", "lang_pred", "score").collect()
    b = language.predict(d.withColumn("lang", F.lit("xx")), m).select("doc_id", "lang_pred", "score").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_filter_returns_all_languages_of_an_ngram():
    rng = np.random.default_rng(0)
    names = [f"l{i}" for i in range(70)]  # two planes
    own = {n: rng.integers(0, 1 << 32, 50, dtype=np.uint32) for n in names}
    rows = np.zeros((1 << 14, 2), dtype=np.uint64)
    for k, n in enumerate(names):
        for at in language._places(own[n], len(rows)):
            rows[at, k // 64] |= np.uint64(1 << k % 64)
    f = language.LanguageFilter(names, rows, np.zeros(70))
    for k, n in enumerate(names):
        assert (f.masks(own[n])[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).all()


def plain_grams(text):
    """Letters folded to lower case, other runs one space, in UTF-8: every 4 bytes."""
    flat = " " + re.sub(r"[^a-z\x80-\U0010ffff]+", " ", re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), text)) + " "
    raw = re.sub(" +", " ", flat).encode()
    return [raw[i:i + 4] for i in range(len(raw) - 3)]


def test_full_filter_against_plain_sets(spark):
    texts = [("en", "The quick brown Fox, and the DOG!"), ("en", "two dogs run through the forest"), ("de", "Der schnelle Fuchs ÜBER dem Hund"),
             ("de", "the Hund läuft durch den Wald"), ("sv", "räven springer över hunden 12 gånger")]
    d = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(texts)], "doc_id long, text string, lang string")
    model = language.train(d, min_share=0, dominance=0)
    own = {k: {g for x, t in texts if x == k for g in plain_grams(t)} for k in model.langs}
    total = {k: sum(len(plain_grams(t)) for x, t in texts if x == k) for k in model.langs}
    assert model.langs == sorted(own, key=lambda k: (-total[k], k))
    # the filter returns all languages that hold an n-gram, and few others
    for g in set().union(*own.values()):
        (mask,) = model.masks(np.frombuffer(g, "<u4"))[:, 0]
        assert all(mask >> np.uint64(i) & np.uint64(1) for i, k in enumerate(model.langs) if g in own[k])
    asked = [t for _, t in texts] + ["dogs över den forest", "Über the Wald", "zzzz qqqq xxxx", "hunden"]
    n, hits = language._popcounts(model, pa.array(asked))
    for j, t in enumerate(asked):
        grams = plain_grams(t)
        assert n[j] == len(grams)
        for i, k in enumerate(model.langs):
            # each n-gram outside the language counts as false positive at most: recompute those from the rows
            false = sum(bool(model.masks(np.frombuffer(g, "<u4"))[0, 0] >> np.uint64(i) & np.uint64(1)) for g in grams if g not in own[k])
            assert hits[i, j] == sum(g in own[k] for g in grams) + false and false <= max(2, 0.3 * len(grams))
    q = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    for r in language.predict(q, model).collect():
        fixed = [max(0.0, (hits[i, r.doc_id] - n[r.doc_id] * f) / (1 - f)) for i, f in enumerate(model.false_positive)]
        best = max(range(len(fixed)), key=lambda i: (fixed[i], -i))
        assert r.lang_pred == model.langs[best] and r.score == pytest.approx(min(1, fixed[best] / n[r.doc_id]))


def test_helper_names_stay(spark):
    d = corpus(spark).withColumn("_grams", F.lit("g")).withColumn("_letters", F.lit("l")).withColumn("grams", F.lit("h"))
    (r,) = language.identify(d.where("doc_id < 60 OR doc_id = 106")).where("doc_id = 106").collect()
    assert (r._grams, r._letters, r.grams, r.lang_pred) == ("g", "l", "h", "de")


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_agreement_with_the_full_filter(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    full = language.identify(d, min_share=0, dominance=0).select("doc_id", F.col("lang_pred").alias("full"))
    agree, n = language.identify(d).join(full, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("full")).cast("int")), F.count("*")).first()
    print("agreement", agree, n)
    assert n >= 1000 and agree >= 0.99


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_held_out_accuracy(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    r = language.identify(d).where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).collect()[0]
    assert r[1] > 250 and r[0] >= 0.97
