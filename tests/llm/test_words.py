import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pricelens.llm import common as C
from pricelens.llm.fmindex import FMIndex, repeated_windows

TEXT = st.text(alphabet="aAbB é\n\t\x0b\x1c\xa0日", max_size=60)
WORD = re.compile("[^\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    w = C.words_of(pa.array(texts, pa.string()), lower=True)
    want = [WORD.findall(t or "") for t in texts]
    assert w.counts.tolist() == [len(x) for x in want]
    flat = [x for ws in want for x in ws]
    assert [w.data[a:z].tobytes().decode() for a, z in zip(w.starts, w.ends, strict=True)] == flat
    ascii_lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    by_hash = {}
    for x, h in zip(flat, w.hashes.tolist(), strict=True):
        assert by_hash.setdefault(h, ascii_lower(x)) == ascii_lower(x)
    assert len(by_hash) == len({ascii_lower(x) for x in flat})


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_shingles(texts):
    sets = C.doc_shingles(C.words_of(pa.array(texts)), 3)
    for t, s in zip(texts, sets, strict=True):
        w = WORD.findall(t)
        assert len(s) == len({tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))}) * (len(w) > 0)


def test_word_longer_than_a_chunk_and_sliced_arrays():
    big = "x" * (3 << 20)
    w = C.words_of(pa.array(["skip", f"a {big} b", big]).slice(1))
    assert w.counts.tolist() == [3, 1]
    assert w.hashes[1] == w.hashes[3] and len(set(w.hashes.tolist())) == 3


def test_slices_bound_the_text_and_keep_all_rows():
    b = pa.RecordBatch.from_pydict({"text": ["abc", None, "d" * 50, "", "ef"]})
    got = list(C.slices(iter([b, b.slice(0, 0)]), "text", 10))
    assert [r for x in got for r in x.column(0).to_pylist()] == b.column(0).to_pylist()
    assert all(x.num_rows == 1 or x.column(0).nbytes < 60 for x in got)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=12), min_size=1, max_size=5), st.integers(1, 5))
def test_index_finds_the_windows_that_occur_twice(seqs, width):
    values = np.array([x for s in seqs for x in s], dtype=np.uint64)
    ends = np.cumsum([len(s) for s in seqs])
    index = FMIndex(values, ends)
    starts = ends - [len(s) for s in seqs]
    long = (ends - starts) >= width
    got = repeated_windows(index, index.symbols(values), starts[long], ends[long], width)
    seen = {}
    for s, a in zip(seqs, starts.tolist(), strict=True):
        for i in range(len(s) - width + 1):
            seen.setdefault(tuple(s[i:i + width]), []).append(a + i)
    assert sorted(np.flatnonzero(got).tolist()) == sorted(i for v in seen.values() if len(v) > 1 for i in v)
