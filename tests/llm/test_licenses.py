import os

import pytest
from pyspark.sql import functions as F

from pricelens.llm import licenses as L

SF = "/root/testdata/sf0.01"
FILLER = [" ".join(f"w{(i * 7 + j * 13) % 97}" for j in range(5 + i % 30)) for i in range(300)]


@pytest.fixture(scope="module")
def model():
    return L.fit(L.training_rows(FILLER))


def test_accuracy_on_rows_not_seen(model):
    import pyarrow as pa

    rows = L.training_rows([f"z{i} " + t for i, t in enumerate(FILLER[:80])], seed=99, variants=20)
    grams, starts, text, _, _ = L._features(pa.array([t for t, _ in rows]))
    first = {}
    for k, i in enumerate(text.tolist()):
        first.setdefault(i, k)
    p = model.probabilities(grams, starts)
    right = sum(model.classes[p[k].argmax()] == rows[i][1] for i, k in first.items())
    assert right / len(first) >= 0.95 and 0.3 <= model.least <= 0.9


def test_scan_and_edges(spark, model):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = [(1, "intro w1 w2 w3\n\nReleased under the MIT License.\nw5 w6"), (2, None), (3, ""), (4, "\n \n"), (5, "w1 w2 w3 w4\nw9 w8"),
            (6, mit), (7, " ".join(FILLER * 20) + "\nLicensed under the Apache License, Version 2.0."), (1, "intro w1 w2 w3\n\nReleased under the MIT License.\nw5 w6"),
            (None, "This work is licensed under the GNU General Public License, version 3."), (8, "All rights reserved. No part of this publication may be reproduced without written permission of the publisher."), (9, "é日本\nLicensed under CC BY-NC 4.0.")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, family string")
    got = sorted(((r.doc_id, r.paragraph, r.family) for r in L.scan(d.select("doc_id", "text"), model).collect()), key=str)
    assert got == sorted([(1, 2, "mit"), (1, 2, "mit"), (6, 0, "mit"), (7, 1, "apache"), (None, 0, "gpl"), (8, 0, "unknown"), (9, 1, "cc")], key=str)
    assert L.scan(d.limit(0), model).count() == 0


def test_families_must_resemble_a_template(model, spark):
    d = spark.createDataFrame([(1, "License license GPL copy MIT")], "doc_id long, text string")
    assert {r.family for r in L.scan(d, model).collect()} <= {"unknown"}


def test_training_without_documents(spark):
    m = L.train(spark.createDataFrame([], "doc_id long, text string"))
    assert m.classes[0] == "none"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_planted_lines_of_the_corpus(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {(r.doc_id, r.family) for r in L.scan(d, L.train(d)).collect()}
    for word, family in (("Apache License", "apache"), ("MIT License", "mit"), ("CC BY-NC", "cc"), ("GNU General", "gpl")):
        ids = [r.doc_id for r in d.where(F.col("text").contains(word)).collect()]
        assert ids and all((i, family) in got for i in ids)


def test_wording_far_from_the_templates_is_reported(model, spark):
    rows = ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED', "THIS SOFTWARE IS PROVIDED BY THE AUTHOR AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED",
            "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide copyright license to reproduce the Work", "mit mit mit mit mit mit", "Mit", "w1 w2 w3 w4 w5"]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), model).collect()}
    assert {i: r.family for i, r in got.items()} == {0: "mit", 1: "bsd", 2: "unknown"}
    assert got[2].similarity < 0.2 and 0 < got[2].probability <= 1


def test_notice_is_found_at_every_offset_of_prose(model, spark):
    import random

    rng = random.Random(1)
    fill = [w for t in FILLER for w in t.split()]
    notice = "Licensed under the Apache License, Version 2.0"
    rows = [(k, " ".join([*(rng.choice(fill) for _ in range(k)), notice, *(rng.choice(fill) for _ in range(60))])) for k in range(129)]
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert {r.doc_id for r in got if r.family == "apache"} == set(range(129))
    assert all(abs(r.word - r.doc_id) <= 3 for r in got if r.family == "apache")


def test_wrapped_notice_is_one_paragraph(model, spark):
    mit = L.TEMPLATES["mit"][2].split()
    wrapped = "\n".join(" ".join(mit[i:i + 9]) for i in range(0, len(mit), 9))
    a, b = FILLER[20], FILLER[21]
    rows = [(1, f"{a}\n\n{wrapped}\n\n{b}"), (2, "GPLv3"), (3, f"{a}\n\n  Apache-2.0\n\n{b}"), (4, "Mit"), (5, a)]
    got = [(r.doc_id, r.paragraph, r.family) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()]
    assert sorted(got) == [(1, 2, "mit"), (2, 0, "gpl"), (3, 2, "apache")]


def test_scores_against_plain_python(model):
    """Features, logits and probabilities computed anew, word by word."""
    import math
    import re

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    words = [w for t in FILLER[:40] for w in t.split()] + L.TEMPLATES["bsd"][1].split() + ["É", "x-y", "...", "(c)"]
    texts = [" ".join(rng.choice(words, n)) + sep + " ".join(rng.choice(words, n // 2)) for n in (1, 5, 7, 9, 16, 17, 31, 64, 65, 200) for sep in (" ", "\n", "\n \n")]
    x = L._stretches(pa.array(texts))
    p = model.probabilities(x.grams, x.starts)
    want, word = [], re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
    code = {}
    for t in texts:  # each word's hash, from a text of its own
        for v in word.findall(t):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in v)
            code[v] = int(L.words_of(pa.array([low]), lower=True, word_bytes=L._LETTERS).hashes[0])
    whole = 1 << 64

    def bucket(run):
        acc = code[run[0]]
        for v in run[1:]:
            acc = (acc * 0xD6E8FEB86659FD93 + code[v]) % whole
        return int(L.mix(np.array([(acc + len(run) - 1) % whole], dtype=np.uint64))[0]) >> (64 - L.BITS)

    for t in texts:
        paragraphs, own = [], []
        for line in t.split("\n"):
            found = word.findall(line)
            if found:
                own += found
            elif own:
                paragraphs.append(own)
                own = []
        for own in [*paragraphs, own]:
            at = 0
            while own:
                part = own[at:at + L.STRETCH]
                grams = {bucket(part[i:i + k]) for k in (1, 2, 3) for i in range(len(part) - k + 1)}
                z = [(sum(float(model.weights[g, c]) for g in grams) / math.sqrt(len(grams)) + float(model.bias[c])) / model.temperature for c in range(len(model.classes))]
                top = max(z)
                want.append([math.exp(v - top) / sum(math.exp(u - top) for u in z) for v in z])
                if at + L.STRETCH >= len(own):
                    break
                at += L.STRETCH // 2
    assert p.shape == (len(want), len(model.classes)) and np.abs(p - np.array(want)).max() < 1e-3


def test_sample_takes_whole_texts_and_is_bounded(spark):
    long = " ".join(f"v{i}" for i in range(9000))
    d = spark.createDataFrame([(i, long if i == 3 else f"line {i}\nother {i}") for i in range(50)], "doc_id long, text string")
    got = L.sampled_stretches(d, sample_docs=50, sample_stretches=1000)
    assert len(got) == 98 + -(-9000 // L.STRETCH) and any("v8999" in x for x in got)
    few = L.sampled_stretches(d, sample_docs=50, sample_stretches=40)
    assert len(few) == 40 and set(few) <= set(got) and few == L.sampled_stretches(d.repartition(4), sample_docs=50, sample_stretches=40)
