import os
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from pricelens.llm import decontaminate, pii
from pricelens.llm.queries import PII_KEY
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in C.STAGES:
        path = str(tmp_path_factory.mktemp("p") / name)
        f(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in C.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "tokens"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_each_stage_against_brute_force(stages, spark):
    before, after = stages[0]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if r.text and any(c.isalpha() for c in r.text)}
    before, after = stages[1]
    want = {c for _, _, c in brute([(r.doc_id, r.text) for r in before.collect()])}
    assert {r.doc_id for r in after.collect()} == want and after.count() == len(want)
    before, after = stages[2]
    m = decontaminate.Matcher([(r.item_id, decontaminate.normal(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if not m.find(r.text)}
    before, after = stages[3]
    assert {r.doc_id: r.text for r in after.collect()} == {r.doc_id: r.text for r in pii.pseudonymised(before, PII_KEY).collect()}
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = stages[4]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: (t.encode(r.text, add_special_tokens=False).ids, r.text) for r in before.collect()}
    assert {r.doc_id: (r.ids, r.text) for r in after.collect()} == want


def test_run_gives_the_last_stage(spark, stages):
    got = C.run(spark, SF)
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == sorted((r.doc_id, r.n_tokens) for r in stages[-1][1].collect())


def test_language_stage_goes_by_its_prediction(spark):
    en = "the quick brown fox jumps over the lazy dog and runs through the forest with friends"
    de = "der schnelle braune Fuchs springt über den faulen Hund und läuft durch den Wald mit Freunden"
    aside = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 3 == 1]  # held out of the training
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de") for i in range(60)]
    rows += [(aside[0], de, "en"), (aside[1], "der Hund springt über den Wald", None), (aside[2], "Ο γρήγορος καστανός αλεπού πηδάει πάνω από το σκυλί", "en"),
             (aside[3], "zxq kjw vvq pqz xkz qqj wvx bgk", None), (aside[4], "a", "de"), (aside[5], "123", "en"), (aside[6], None, "en")]
    d = spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.lang for r in C.language_id(spark, d, SF).collect()}
    assert got == {**{i: "en" if i % 2 else "de" for i in range(60)}, aside[0]: "de", aside[1]: "de", aside[4]: "de"}
    bare = d.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.doc_id, r.lang) for r in C.language_id(spark, bare, SF).collect()} == {(r[0], None) for r in rows if r[1] and any(c.isalpha() for c in r[1])}
