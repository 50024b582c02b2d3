"""Language ID by language-bitmask n-gram filters.

Training counts every 4-byte letter n-gram per language over all labelled
rows.  A language owns the n-grams whose share of its text is at least
``MIN_SHARE`` and at least ``DOMINANCE`` of the share in the language that
uses them most, so a language owns at most ``1 / MIN_SHARE`` of them: the
filter's size is bounded whatever the corpus holds.  The filter is a
bit-sliced Bloom filter: each row is a mask with one bit per language, a
query takes the AND of ``HASHES`` rows and so gets all languages that own the
n-gram at once.  A text's popcounts per language are corrected for each
language's false-positive rate, and the largest decides.

Null text, or text without a letter, is ``und`` with score 0.  Texts too
short for an n-gram, and ties, go to the language with more training text,
then to the smaller name.  Without any labelled row every text is ``und``.
With a floor, as ``calibrated`` on labelled rows, a text of ``LEAST_GRAMS``
n-grams or more that no learned language explains (score below it) is ``und``
too; shorter texts are too little evidence for that.
Whole texts count, a bounded slice at a time; repeated rows train and are
answered once each; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.operators.attach import attach

from .common import fresh, mix, release, slices, staged, text_buffers

GRAM = 4
MIN_SHARE = 1e-5
DOMINANCE = 0.02
HASHES = 3
ROWS_PER_GRAM = 8
#: N-grams from which a text can be found to be in no learned language.
LEAST_GRAMS = 12
#: The floor is this part of the score that all but ``FLOOR_TAIL`` of the labelled rows reach.
FLOOR_PART, FLOOR_TAIL = 0.5, 0.001
_FLUSH = 2_000_000
#: Text bytes handled at once; each byte starts an n-gram of several words of memory.
SLICE_BYTES = 1 << 20

_FOLD = np.full(256, 32, dtype=np.uint8)
for _b in range(256):
    if 97 <= _b <= 122 or _b >= 0x80:
        _FOLD[_b] = _b
    elif 65 <= _b <= 90:
        _FOLD[_b] = _b + 32


def _grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of each text (letters folded, other runs one space), and each text's first."""
    padded = pc.binary_join_element_wise(pa.scalar(" ", col.type), pc.fill_null(col, ""), pa.scalar(" ", col.type), pa.scalar("", col.type))
    data, off = text_buffers(padded)
    body, off = data[off[0]:off[-1]], off - off[0]
    x = _FOLD[body]
    lead = np.flatnonzero(body[:-1] == 0xC3) + 1  # upper-case Latin letters with accents
    second = body[lead]
    x[lead[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]] += 0x20
    space = x == 32
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[off[:-1]] = True
    ends = np.concatenate(([0], np.cumsum(keep)))[off]
    x = x[keep].astype(np.uint32)
    if len(x) < GRAM:
        return np.empty(0, np.uint32), np.zeros(len(off), np.int64)
    g = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
    own = np.maximum(np.diff(ends) - GRAM + 1, 0)  # n-grams of each text
    whole = np.zeros(len(g) + 1, dtype=np.int64)
    some = own > 0
    np.add.at(whole, ends[:-1][some], 1)
    np.add.at(whole, (ends[:-1] + own)[some], -1)
    return g[np.cumsum(whole[:-1]) > 0], np.concatenate(([0], np.cumsum(own)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n), summed within the task; flushed when many."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        uniq, at = np.unique(keys, return_inverse=True)
        return uniq, np.bincount(at, weights=n, minlength=len(uniq)).astype(np.int64)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(keys)), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
        held.clear()

    for b in slices(batches, most=SLICE_BYTES):
        g, first = _grams(b.column(0))
        langs = b.column(1).to_pylist()
        for lang in dict.fromkeys(langs):
            own = [g[first[i]:first[i + 1]] for i, x in enumerate(langs) if x == lang]
            keys = np.sort(np.concatenate(own))
            if not len(keys):
                continue
            new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            held.setdefault(lang, []).append((keys[new], np.diff(np.append(new, len(keys)))))
            size += len(new)
        if size > _FLUSH:
            held = {k: [merged(v)] for k, v in held.items()}
            size = sum(len(v[0][0]) for v in held.values())
            if size > _FLUSH // 2:
                yield from flush()
                size = 0
    yield from flush()
    release()


@dataclass
class LanguageFilter:
    """The bit-sliced filter: ``planes`` of 64 languages each, rows x planes."""

    langs: list[str]
    rows: np.ndarray
    false_positive: np.ndarray

    def masks(self, grams: np.ndarray) -> np.ndarray:
        out = None
        for at in _places(grams, len(self.rows)):
            got = self.rows[at]
            out = got if out is None else out & got
        return out


def _places(grams: np.ndarray, m: int) -> list[np.ndarray]:
    h = mix(grams.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(m - 1)).astype(np.int64) for i in range(HASHES)]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", min_share: float = MIN_SHARE, dominance: float = DOMINANCE) -> LanguageFilter:
    """Fit the filter on all rows of ``docs`` whose language is not null.

    The driver receives the owned n-grams only, at most ``1 / min_share`` for
    each language.  With ``min_share`` and ``dominance`` 0 a language owns
    every n-gram it was seen with: the full filter, whose size only the number
    of distinct n-grams bounds.
    """
    counts = staged(docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
              .select(F.col(text).alias("text"), F.col(lang).alias("lang"))
              .mapInArrow(_count, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "gram-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    owned = (attach(counts, totals, "lang", "gram", "inner")
             .select("lang", "gram", (F.col("n") / F.col("total")).alias("share"), "total")
             .where(F.col("share") >= min_share)).toArrow()
    names, gram, share, total = (owned.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "gram", "share", "total"))
    size = dict(zip(names.tolist(), total.tolist(), strict=True))
    langs = sorted(size, key=lambda x: (-size[x], x))
    uniq, at = np.unique(gram, return_inverse=True)
    top = np.zeros(len(uniq))
    np.maximum.at(top, at, share)
    strong = share >= dominance * top[at]
    m = 1 << max(10, int(ROWS_PER_GRAM * max(1, len(uniq)) - 1).bit_length())
    rows = np.zeros((m, max(1, -(-len(langs) // 64))), dtype=np.uint64)
    for k, name in enumerate(langs):
        for places in _places(gram[strong & (names == name)].astype(np.uint32), m):
            rows[places, k // 64] |= np.uint64(1 << k % 64)
    fill = np.array([np.count_nonzero(rows[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)) / m for k in range(len(langs))])
    return LanguageFilter(langs, rows, fill ** HASHES)


def _popcounts(f: LanguageFilter, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of each text, and per language how many of them it owns."""
    g, first = _grams(col)
    masks = f.masks(g)
    hits = np.empty((len(f.langs), len(first) - 1), dtype=np.int64)
    for k in range(len(f.langs)):
        bit = (masks[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).astype(np.int64)
        hits[k] = np.diff(np.concatenate(([0], np.cumsum(bit)))[first])
    return np.diff(first), hits


def predict(docs: DataFrame, model: LanguageFilter, text: str = "text", floor: float = 0.0) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (share of n-grams explained, 0 to 1); under ``floor`` it is ``und``."""
    grams = fresh("grams", docs.columns)
    foreign = (F.col(grams) >= LEAST_GRAMS) & (F.col("score") < floor)
    return _scored(docs, model, text, grams).withColumn("lang_pred", F.when(foreign, F.lit("und")).otherwise(F.col("lang_pred"))).drop(grams)


def calibrated(docs: DataFrame, model: LanguageFilter, text: str = "text", lang: str = "lang") -> float:
    """The floor of ``predict`` by the labelled rows of ``docs``: half the score that all but 0.1 % of them reach."""
    labelled = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = _scored(labelled, model, "text", "grams").where((F.col("grams") >= LEAST_GRAMS) & (F.col("lang") == F.col("lang_pred")))
    low = rows.agg(F.percentile_approx("score", FLOOR_TAIL)).collect()[0][0]
    return FLOOR_PART * (low or 0.0)


def _scored(docs: DataFrame, model: LanguageFilter, text: str, grams: str) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``grams``, the number of n-grams."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField(grams, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = held.value
        for b in slices(batches, text, SLICE_BYTES):
            letters = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            n, hits = _popcounts(f, b.column(keep.index(text)))
            if f.langs:
                fp = f.false_positive[:, None]
                fixed = np.clip((hits - n * fp) / (1 - fp), 0, None)
                best = fixed.argmax(axis=0)
                score = np.where(letters, np.clip(fixed[best, np.arange(len(n))] / np.maximum(n, 1), 0, 1), 0.0)
                names = np.where(letters, np.array(f.langs, dtype=object)[best], "und")
            else:
                score, names = np.zeros(len(n)), np.full(len(n), "und", dtype=object)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(score), pa.array(n)], [*keep, "lang_pred", "score", grams])
        release()

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.select(*keep, letters.alias(fresh("letters", keep))).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of the documents that training never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, **options) -> DataFrame:
    """Train (with ``options``) on the rows not held out and predict every row of ``docs``."""
    marked = docs.withColumn("held_out", held_out())
    model = train(marked.where(~F.col("held_out")), **options)
    return predict(marked, model)
