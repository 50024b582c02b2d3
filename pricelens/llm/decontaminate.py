"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in normal form (lower case, every run of other characters
than letters and digits one space).  A test item of ``m`` characters has an
error budget ``k = floor(m * error_rate)`` and is cut into ``k + 1`` pieces: a
passage within ``k`` edits of it must hold one piece unchanged, at its place.
All pieces are searched at once (Aho-Corasick); around each hit's diagonal
Myers' bit-parallel distance decides, with the item as one big-integer column.
The answer is exact for the stated budget.

Documents are read once, by one stage, and not shuffled.  The benchmark is a
stated query set: Spark writes it to the shared folder in blocks of about
``BLOCK_CHARS`` characters, dealt by hash.  A task reads the blocks from there,
one after another, and holds one at a time beside ``ROUND_BYTES`` of documents
(with a single block, a slice of them).  The driver sees counts only and nothing
is broadcast.

Null or empty texts match nothing.  Items without letters or digits match
nothing; items shorter than ``MIN_CHARS`` in normal form match without errors
and at whole words: anywhere in a text if they have ``MIN_WORDS`` words or
more, else only a text that equals them whole.  Equal items are all reported.  Whole texts are
searched.  Other columns pass through; a column ``matches`` is replaced.  Ids of
items are whole numbers or strings.  An empty benchmark matches nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import new_folder, release, slices

ERROR_RATE = 0.08
MIN_CHARS = 40
MIN_WORDS = 3
#: Characters of the items that a task holds at once, about.
BLOCK_CHARS = 2_000_000
#: Text bytes that a task searches for one block after another, if there are several.
ROUND_BYTES = 32 << 20
_OTHER = re.compile(r"[\W_]+")


def _match_type(item_id: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("item_id", item_id), T.StructField("errors", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def best_match(item: str, text: str) -> tuple[int, int]:
    """Fewest edits between ``item`` and any part of ``text``, and that part's end."""
    m = len(item)
    eq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        eq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        e = eq[c] if c in eq else 0
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """The pieces of a block of items, ready to search texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS):
        ids: dict[str, list[int]] = defaultdict(list)
        for i, text in items:
            if text:
                ids[text].append(i)
        self.whole = {t: v for t, v in ids.items() if len(t) < min_chars and t.count(" ") + 1 < MIN_WORDS}
        self.items = [(t, v, int(len(t) * error_rate) if len(t) >= min_chars else 0) for t, v in ids.items() if t not in self.whole]
        self.min_chars = min_chars
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (t, _, k) in enumerate(self.items):
            for j in range(k + 1):
                a, z = j * len(t) // (k + 1), (j + 1) * len(t) // (k + 1)
                pieces[t[a:z]].append((n, a))
        self.pieces = ahocorasick.Automaton()
        for p, places in pieces.items():
            self.pieces.add_word(p, (len(p), places))
        self.pieces.make_automaton()

    def find(self, raw: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, errors, start, end) of each item's best passage, in the text's normal form."""
        text = normal(raw)
        out = [(i, 0, 0, len(text)) for i in self.whole.get(text, ())]
        if not self.items:
            return out
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (n, places) in self.pieces.iter(text):
            for item, at in places:
                starts[item].add(end + 1 - n - at)
        for item, diagonals in starts.items():
            t, ids, k = self.items[item]
            if len(t) < self.min_chars:
                at = min((d for d in diagonals if (not d or text[d - 1] == " ") and text[d + len(t):d + len(t) + 1] in ("", " ")), default=None)
                out += [(i, 0, at, at + len(t)) for i in ids if at is not None]
                continue
            best = None
            for lo, hi in _windows(sorted(diagonals), k, len(t), len(text)):
                errors, end = best_match(t, text[lo:hi])
                if errors <= k and (best is None or errors < best[0]):
                    best = (errors, lo, lo + end)
            if best is not None:
                errors, lo, end = best
                _, back = best_match(t[::-1], text[max(lo, end - len(t) - k):end][::-1])
                out += [(i, errors, end - back, end) for i in ids]
        return sorted(out)


def _windows(diagonals: list[int], k: int, m: int, n: int) -> Iterator[tuple[int, int]]:
    """Stretches of text that hold every passage on the diagonals, overlapping ones merged."""
    lo, hi = None, None
    for d in diagonals:
        a, z = max(0, d - k), min(n, d + m + k)
        if hi is not None and a <= hi:
            hi = z
            continue
        if hi is not None:
            yield lo, hi
        lo, hi = a, z
    if hi is not None:
        yield lo, hi


def _blocks(benchmark: DataFrame, item_id: str, text: str, most: int) -> tuple[str, int]:
    """Write the items in blocks of about ``most`` characters: their folder and number."""
    items = (benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull())
             .groupBy(F.col(item_id).alias("id"), F.col(text).alias("item")).agg(F.count("*").alias("copies")))
    n = -(-(items.agg(F.sum(F.length("item"))).first()[0] or 0) // most)
    folder = new_folder(benchmark.sparkSession, "benchmark")
    if n:
        (items.withColumn("block", F.pmod(F.xxhash64("id", "item"), F.lit(n))).repartition("block")
         .write.partitionBy("block").parquet(folder))
    return folder, n


def _read_block(folder: str, k: int) -> list[tuple[int | str, str]]:
    store, root = fs.FileSystem.from_uri(folder)
    place = f"{root}/block={k}"
    if store.get_file_info(place).type == fs.FileType.NotFound:
        return []
    rows = pq.read_table(place, filesystem=store, columns=["id", "item", "copies"], partitioning=None)
    return [(i, normal(t)) for i, t, n in zip(*(c.to_pylist() for c in rows.columns), strict=True) for _ in range(n)]


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
            error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with ``matches``: the items found in the text, each with its best passage."""
    keep = [c for c in docs.columns if c.lower() != "matches"]
    id_type = T.StringType() if isinstance(benchmark.schema[item_id].dataType, T.StringType) else T.LongType()
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("matches", _match_type(id_type))])
    folder, n = _blocks(benchmark.withColumn(item_id, F.col(item_id).cast(id_type)), item_id, item_text, block_chars)
    if not n:
        return docs.select(*keep, F.array().cast(schema["matches"].dataType).alias("matches"))
    return docs.select(*keep).mapInArrow(_search(folder, n, keep.index(text), text, error_rate, min_chars, to_arrow_type(schema["matches"].dataType)), schema)


def _rounds(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for b in slices(batches, text):
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _search(folder: str, n: int, at: int, text: str, error_rate: float, min_chars: int, found_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = lambda k: Matcher(_read_block(folder, k), error_rate, min_chars)
        only = None
        for held in _rounds(batches, text, ROUND_BYTES if n > 1 else 0):
            found = [[[] for _ in range(b.num_rows)] for b in held]
            for k in range(n):
                m = only or block(k)
                only = m if n == 1 else None
                for b, rows in zip(held, found, strict=True):
                    for row, x in zip(rows, b.column(at), strict=True):
                        row += m.find(x.as_py())
                del m
            for b, rows in zip(held, found, strict=True):
                new = [[dict(zip(("item_id", "errors", "start", "end"), x, strict=True)) for x in sorted(r)] for r in rows]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, found_type)], [*b.schema.names, "matches"])
        release()

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document row and item found: doc_id, item_id, errors, start, end."""
    return matches(docs.select("doc_id", "text"), benchmark, **options).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a test item."""
    return matches(docs, benchmark, **options).where(F.size("matches") == 0).select(*docs.columns)
