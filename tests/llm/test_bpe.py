import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pricelens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
FULL = Tokenizer.from_file(PATH)
TEXTS = [None, "", " ", "  \n\n x", "Hello world's it'll 123 $%^", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "日本 语", "é\xa0\x85 y", "\x00\x1c", "tab\tq" * 500, "same", "same", "word " * 30_000, "x" * 20_000, "😀 ok"]


def want(t):
    ids = FULL.encode(t or "", add_special_tokens=False).ids
    return ids, FULL.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("block", [64, 16 << 20])
def test_ids_and_decoding_are_the_librarys(spark, monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", block)
    d = spark.createDataFrame([(i, t, "keep", "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, extra string, ids string").repartition(3)
    got = {r.doc_id: r for r in bpe.encode(d, PATH).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert (got[i].ids, got[i].decoded) == want(t), t
        assert got[i].extra == "keep"


def test_digests_null_ids_and_empty_table(spark):
    d = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    rows = bpe.digests(bpe.encode(d, PATH)).collect()
    ids, text = want("a b")
    assert len(rows) == 3 and {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == {
        (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())}
    assert bpe.encode(d.limit(0), PATH).count() == 0


def test_words_of_random_texts():
    t, rng = bpe.Tokenizer(PATH), random.Random(3)
    alphabet = [chr(c) for c in range(0x250)] + list("  \n\t'sabre'll 12 \xa0\x85\x1c") * 8 + ["<|endoftext|>", "日", " ", "٠", "́", "😀"] * 3
    for _ in range(3000):
        x = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        assert [i for ids in t.encode(t.words(x)) for i in ids] == FULL.encode(x, add_special_tokens=False).ids


def test_other_kinds_of_file_are_refused():
    with pytest.raises(ValueError):
        bpe.Tokenizer(public_tokenizers.path("word_bpe_49k.json"))
