"""BPE encoding and decoding through a distinct-word table.

One chain of two shuffles.  Map side, texts are split into pre-token words and
packed into blocks: a block keeps its texts as numbers of its own distinct
words.  The first shuffle deals the blocks' distinct words by the hash of the
word, so that equal words of all blocks meet and each is encoded once; the
second brings the ids home to their block, where they are joined back by
position and decoded through the id-to-piece table (bounded by the
vocabulary).  A frequent word is one entry of a block, however often it
occurs, so no word can make a task hot.

The tokenizer is a byte-level BPE file of the ``tokenizers`` library; its path
is a parameter.  Null text counts as empty: no ids, empty decoding.  Whole
texts are encoded whatever their length (a text longer than a block is a block
of its own).  Repeated rows are answered once each; the kept columns pass
through, and the operator's own columns replace those of the same name.

Blocks are numbered by partition, so the input should be a table scan or a
staged table, whose partitions come back in the same order when a task is run
again.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from .common import fresh, release, slices

#: Text bytes of a block.
BLOCK_BYTES = 16 << 20
#: Words of an output batch.
_OUT_WORDS = 1 << 18


def _cls(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


_SPACE = r"\t-\r \x85\xa0"
_SPLIT = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_cls('L')}]+| ?[{_cls('N')}]+| ?[^{_SPACE}{_cls('L')}{_cls('N')}]+"
    rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_WIDE = re.compile("[^\x00-ɏ]")


class Tokenizer:
    """Splitting, encoding of one word, and the id-to-piece table of a file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as File

        self.file = File.from_file(path)
        self.file.no_truncation()
        self.file.no_padding()
        spec = json.loads(self.file.to_str())
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE tokenizer file without normalizer is needed")
        self.plain = spec["pre_tokenizer"]["use_regex"] and not spec["pre_tokenizer"]["add_prefix_space"]
        self.added = [x["content"] for x in spec["added_tokens"]]
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError("added tokens that take their surroundings are not supported")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def words(self, text: str) -> list[str]:
        """The pre-token words and added tokens that make up ``text``."""
        if self.cut and any(x in text for x in self.added):
            return [w for part in self.cut.split(text) if part for w in ([part] if part in self.added else self._words(part))]
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if self.plain and not _WIDE.search(text):
            return _SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.file.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.file.encode_batch(words, add_special_tokens=False)]

    def pieces(self) -> dict[int, bytes]:
        """id -> bytes: the id-to-piece table."""
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        back = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in keep)}
        return {i: s.encode() if s in self.added else bytes(back[c] for c in s) for s, i in self.file.get_vocab(with_added_tokens=True).items()}


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def _split_blocks(path: str, routes: int, text_at: int, text: str):
    """Texts -> blocks: rows (kind 0: words of a block and route, kind 2: the block's texts)."""

    def flush(block: int, seqs: list[np.ndarray], table: dict[str, int], kept: list[pa.RecordBatch]) -> list[tuple[int, int, int, bytes]]:
        lens = np.array([len(s) for s in seqs], dtype=np.int64)
        flat = np.concatenate(seqs) if seqs else np.empty(0, np.int32)
        order = np.argsort(-np.bincount(flat, minlength=len(table)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(table), dtype=np.int32)
        rank[order] = np.arange(len(table), dtype=np.int32)
        flat = rank[flat]
        own_words = list(table)
        raw = [own_words[k].encode() for k in order.tolist()]
        by_route: dict[int, list[int]] = defaultdict(list)
        for k, w in enumerate(raw):
            by_route[zlib.crc32(w) % routes].append(k)
        rows = [(r, block, 0, B.pack(B.planes(np.array([len(raw[k]) for k in own])), b"".join(raw[k] for k in own), B.planes(np.diff(own, prepend=0)))) for r, own in by_route.items()]
        rows.append((routes + block % routes, block, 2, B.pack(B.planes(lens), B.planes(flat), len(table).to_bytes(8, "little"), B.ipc(pa.Table.from_batches(kept)))))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, n, size = _tokenizer(path), 0, 0
        part = TaskContext.get().partitionId() << 32
        table: dict[str, int] = defaultdict()
        table.default_factory = table.__len__
        seqs, kept = [], []
        for b in slices(batches, text, BLOCK_BYTES // 4):
            col = b.column(text_at)
            for s in col.to_pylist():
                seqs.append(np.array(list(map(table.__getitem__, t.words(s))), dtype=np.int32) if s else np.empty(0, np.int32))
            own = pa.array(np.arange(b.num_rows))  # copied, since a slice would hold the whole batch with its texts
            kept.append(pa.RecordBatch.from_arrays([c.take(own) for i, c in enumerate(b.columns) if i != text_at], [c for i, c in enumerate(b.schema.names) if i != text_at]))
            size += col.nbytes
            if size >= BLOCK_BYTES:
                yield B.rows(flush(part + n, seqs, table, kept))
                n, size, seqs, kept = n + 1, 0, [], []
                table.clear()
        if kept:
            yield B.rows(flush(part + n, seqs, table, kept))
        table.clear()
        del seqs, kept
        release()

    return run


def _encode_words(path: str, routes: int):
    """Words (kind 0) -> their ids (kind 1), each distinct word of a route encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, route, known = _tokenizer(path), -1, {}
        for b in batches:
            for r, block, kind, data in B.items(b):
                if kind == 2:
                    yield B.rows([(block, block, kind, data)])
                    continue
                if r != route:
                    route, known = r, {}
                lens, raw, places = B.unpack(data)
                cuts = np.concatenate(([0], np.cumsum(B.numbers(lens)))).tolist()
                words = [raw[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                new = [w for w in words if w not in known]
                for w, ids in zip(new, t.encode([w.decode() for w in new]), strict=True):
                    known[w] = np.array(ids, dtype=np.int32)
                ids = [known[w] for w in words]
                yield B.rows([(block, block, 1, B.pack(places, B.planes(np.array([len(x) for x in ids])), B.planes(np.concatenate(ids))))])

    return run


def _join_back(path: str, schema: T.StructType):
    """Ids and texts of a block -> one row per text with its ids and their decoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _tokenizer(path).pieces()
        block, got = None, []
        for b in batches:
            for _, at, kind, data in B.items(b):
                if at != block:
                    block, got = at, []
                if kind == 1:
                    got.append(B.unpack(data))
                    continue
                lens, seq, n, kept = B.unpack(data)
                n = int.from_bytes(n, "little")
                # each word's ids are flat[start:start + size], in the order in which the routes came back
                start, size, text, flat = np.zeros(n, np.int64), np.full(n, -1, np.int64), [b""] * n, []
                for places, sizes, ids in got:
                    at_word, many, ids = np.cumsum(B.numbers(places)), B.numbers(sizes), B.numbers(ids).astype(np.int32)
                    ends = np.cumsum(many)
                    size[at_word], start[at_word] = many, sum(map(len, flat)) + ends - many
                    flat.append(ids)
                    ids = ids.tolist()
                    for k, x, y in zip(at_word.tolist(), (ends - many).tolist(), ends.tolist(), strict=True):
                        text[k] = b"".join([pieces[i] for i in ids[x:y]])
                if (size < 0).any():
                    raise RuntimeError("a block's words did not all come back")
                got, ids = [], None
                flat = np.concatenate(flat) if flat else np.empty(0, np.int32)
                seq, ends = B.numbers(seq).astype(np.int32), np.cumsum(B.numbers(lens))
                table = pa.ipc.open_stream(kept).read_all()
                i, rows = 0, len(ends)
                while i < rows:
                    a = int(ends[i - 1]) if i else 0
                    j = max(i + 1, int(np.searchsorted(ends, a + _OUT_WORDS, "right")))
                    part = seq[a:int(ends[j - 1])]
                    many = size[part]
                    offsets = np.concatenate(([0], np.cumsum(many)))
                    at_id = np.arange(offsets[-1]) - np.repeat(offsets[:-1], many) + np.repeat(start[part], many)
                    cut = np.concatenate(([a], ends[i:j])) - a
                    lists = pa.ListArray.from_arrays(pa.array(offsets[cut].astype(np.int32)), pa.array(flat[at_id]))
                    order = part.tolist()
                    decoded = [b"".join([text[k] for k in order[x:z]]).decode("utf-8", "replace") for x, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    cols = table.slice(i, j - i).combine_chunks()
                    yield pa.RecordBatch.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols.columns), lists, pa.array(decoded, pa.string())], schema.names)
                    i = j
        release()

    return run


def encode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``ids`` (array<int>) and ``decoded`` (the ids' text)."""
    keep = [c for c in docs.columns if c != text and c.lower() not in ("ids", "decoded")]
    body = fresh("text", keep)
    routes = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType(), True)), T.StructField("decoded", T.StringType())])
    blocks = docs.select(*keep, F.col(text).alias(body)).mapInArrow(_split_blocks(tokenizer, routes, len(keep), body), B.ROW)
    words = blocks.repartition(routes, "route").sortWithinPartitions("route").mapInArrow(_encode_words(tokenizer, routes), B.ROW)
    return words.repartition(routes, "block").sortWithinPartitions("block", "kind").mapInArrow(_join_back(tokenizer, schema), schema)


def digests(encoded: DataFrame) -> DataFrame:
    """``n_tokens`` and SHA-256 of the ids (decimal, comma-joined) and of the decoded text."""
    return encoded.select(
        *[c for c in encoded.columns if c not in ("ids", "decoded")],
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
