"""Substring dedup with a compressed FM-index per shard.

A window is ``WIDTH`` consecutive words of one text; every word is removed
that a window covers whose word sequence also starts anywhere else.

Each window is owned by its minimizer, the ``GRAM``-word hash that is least
within it; equal windows have equal minimizers.  Consecutive windows with the
same minimizer place form a run, whose words are a segment.

1. Texts are written in blocks to the shared folder.
2. The distinct minimizers of a block go to the partition that owns the hash
   and come back if they occur twice.
3. Segments of such minimizers, equal ones of a block once, are dealt by
   minimizer into shards, so that all places of a window meet in one shard.
   The shard indexes its segments (equal ones twice at most) and streams them
   through the index: backward search over the wavelet matrix gives the
   matching statistics, and windows that occur twice are reported.
4. Blocks mark the reported windows and drop the words they cover.

A minimizer in very many places (a short common line) has its windows dealt on
by their own hash, ``HOT`` places a part, so no shard holds an unbounded
group; copies collapse before they are shipped.

Null and empty texts have no words.  Texts of fewer words than ``WIDTH`` are
kept.  Whole texts count.  Repeated rows are copies of each other, so their
windows go.  The kept columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from .common import Words, mix, release, slices, staged, window_hashes, words_of
from .fmindex import FMIndex, repeated_windows

WIDTH, GRAM = 35, 8
BLOCK_BYTES = 8 << 20
#: Places of a minimizer that a shard takes together; words of an index.
HOT, INDEX_WORDS = 20_000, 400_000
_POS = np.uint64(28)
_U = np.uint64


class Runs:
    """Runs of windows with one minimizer place: first and last window start, and the minimizer."""

    def __init__(self, w: Words, width: int, gram: int):
        n = len(w.starts)
        self.w, self.width = w, width
        self.first = self.last = np.empty(0, np.int64)
        self.token = np.empty(0, np.int64)
        if n < width:
            return
        h = window_hashes(w.hashes, gram)
        key = h >> _POS << _POS | np.arange(len(h), dtype=_U)
        span, have = width - gram + 1, 1
        while have < span:
            step = min(have, span - have)
            key = np.minimum(key[:-step], key[step:])
            have += step
        place = (key & ((_U(1) << _POS) - _U(1))).astype(np.int64)  # of the minimizer, for each window start
        whole = w.left()[:len(place)] >= width
        new = np.ones(len(place), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | ~whole[:-1]
        start = np.flatnonzero(new & whole)
        stop = np.flatnonzero(whole & np.append(new[1:] | ~whole[1:], True))
        self.first, self.last = start, stop
        self.token = (h[place[start]] >> _U(8)).astype(np.int64)

    def window_hash(self, at: np.ndarray) -> np.ndarray:
        acc = np.full(len(at), self.width, dtype=_U)
        for j in range(self.width):
            acc *= _U(0xD6E8FEB86659FD93)
            acc += self.w.hashes[at + j]
        return mix(acc)

    def segment_hash(self, pick: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Of the run's words: its first and last window cover them all."""
        a, z = self.first[pick], self.last[pick]
        return mix(self.window_hash(a) * _U(3) ^ self.window_hash(z) * _U(5) + (z - a).astype(_U))


def _blocks(columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, held = TaskContext.get().partitionId() << 32, 0, []
        for b in slices(batches, "_text", BLOCK_BYTES // 2):
            held.append(b)
            size += b.column(columns).nbytes
            if size >= BLOCK_BYTES:
                yield B.rows([(block, block, 2, B.pack(B.ipc(pa.Table.from_batches(held))))])
                block, size, held = block + 1, 0, []
        if held:
            yield B.rows([(block, block, 2, B.pack(B.ipc(pa.Table.from_batches(held))))])

    return run


def _texts(data: bytes) -> list[pa.RecordBatch]:
    return pa.ipc.open_stream(B.unpack(data)[0]).read_all().to_batches()


def _send(routes: int, width: int, gram: int):
    """The distinct minimizers of each block, with their number of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, block, _, data in B.items(b):
                token = np.sort(np.concatenate([Runs(words_of(t.column(t.num_columns - 1)), width, gram).token for t in _texts(data)]))
                new = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.empty(0, np.int64)
                many = np.diff(np.append(new, len(token)))
                token = token[new]
                cuts = np.searchsorted(token, np.array([(r << 56) // routes for r in range(routes + 1)], dtype=np.int64))
                out = [(r, block, 0, B.pack(B.planes(np.diff(token[a:z], prepend=0)), B.planes(many[a:z]))) for r, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if a < z]
                if out:
                    yield B.rows(out)

    return run


def _by_route(batches: Iterator[pa.RecordBatch], answer) -> Iterator[pa.RecordBatch]:
    """Hand the rows of each route to ``answer``, one route after another."""
    route, held = None, []
    for b in batches:
        for r, block, _, data in B.items(b):
            if r != route and held:
                yield from answer(held)
                held = []
            route = r
            held.append((block, data))
    if held:
        yield from answer(held)
    held.clear()
    release()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Minimizers of two places or more, back to the blocks that have them."""

    def answer(held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = [[B.numbers(x) for x in B.unpack(data)] for _, data in held]
        tokens = [np.cumsum(p[0]) for p in parts]
        _, at = np.unique(np.concatenate(tokens), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)[at]
        a = 0
        for (block, _), t in zip(held, tokens, strict=True):
            many = total[a:a + len(t)]
            a += len(t)
            keep = many > 1
            if keep.any():
                yield B.rows([(block, block, 1, B.pack(B.planes(np.diff(t[keep], prepend=0)), B.planes(many[keep])))])

    return _by_route(batches, answer)


def _segments(routes: int, width: int, gram: int, hot: int):
    """The distinct segments of a block's shared minimizers, dealt by minimizer."""

    def cut(t: pa.RecordBatch, token: np.ndarray, many: np.ndarray, out: dict[int, list]) -> None:
        w = words_of(t.column(t.num_columns - 1))
        runs = Runs(w, width, gram)
        if not len(runs.token) or not len(token):
            return
        at = np.searchsorted(token, runs.token)
        at[at == len(token)] = 0
        pick = np.flatnonzero(token[at] == runs.token)
        places = many[at[pick]]
        cold, warm = pick[places <= hot], pick[places > hot]
        first, last, own, seg = runs.first[cold], runs.last[cold], runs.token[cold], runs.segment_hash(cold)
        if len(warm):  # single windows, dealt on by their own hash
            parts = np.repeat(-(-places[places > hot] // hot), runs.last[warm] - runs.first[warm] + 1)
            start = np.concatenate([np.arange(a, z + 1) for a, z in zip(runs.first[warm].tolist(), runs.last[warm].tolist(), strict=True)])
            h = runs.window_hash(start)
            part = mix(np.repeat(runs.token[warm], runs.last[warm] - runs.first[warm] + 1).astype(_U) * _U(7) + h % parts.astype(_U)) >> _U(8)
            first, last, own, seg = np.append(first, start), np.append(last, start), np.append(own, part.astype(np.int64)), np.append(seg, mix(h * _U(3) ^ h * _U(5)))
        for k, (a, z, m, s) in enumerate(zip(w.starts[first].tolist(), w.ends[last + width - 1].tolist(), own.tolist(), seg.tolist(), strict=True)):
            if s in out:
                out[s][0] = 2
            else:
                out[s] = [1, m, w.data[a:z].tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, got = None, []
        for b in batches:
            for _, block, kind, data in B.items(b):
                if block != at:
                    at, got = block, []
                if kind == 1:
                    got.append([B.numbers(x) for x in B.unpack(data)])
                    continue
                token = np.concatenate([np.cumsum(g[0]) for g in got] or [np.empty(0, np.int64)])
                many = np.concatenate([g[1] for g in got] or [np.empty(0, np.int64)])
                order = np.argsort(token)
                found: dict[int, list] = {}
                for t in _texts(data):
                    cut(t, token[order], many[order], found)
                if not found:
                    continue
                seg = np.array(list(found), dtype=_U)
                copies, owner, text = zip(*found.values(), strict=True)
                owner, copies = np.array(owner, dtype=np.int64), np.array(copies, dtype=np.int64)
                route = (mix(owner.astype(_U)) % _U(routes)).astype(np.int64)
                order = np.lexsort((owner, route))
                cuts = np.searchsorted(route[order], np.arange(routes + 1))
                out = []
                for r, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    if a < z:
                        own = order[a:z]
                        texts = [text[k] for k in own.tolist()]
                        out.append((r, block, 0, B.pack(seg[own].tobytes(), B.planes(np.diff(owner[own], prepend=0)), B.planes(copies[own]), B.planes(np.array([len(x) for x in texts])), b"".join(texts))))
                yield B.rows(out)
        release()

    return run


def _match(width: int, index_words: int):
    """Index the segments of each shard and report their repeated windows."""

    def search(values: np.ndarray, counts: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """For each segment a mask of its repeated windows."""
        ends = np.cumsum(counts)
        starts = ends - counts
        twice = np.flatnonzero(copies > 1)
        again = np.concatenate([values[starts[k]:ends[k]] for k in twice.tolist()] or [np.empty(0, _U)])
        index = FMIndex(np.concatenate((values, again)), np.concatenate((ends, len(values) + np.cumsum(counts[twice]))))
        repeats = repeated_windows(index, index.symbols(values), starts, ends, width)
        place = np.arange(len(values)) - np.repeat(starts, counts)
        mask = np.zeros(len(counts), dtype=np.int64)
        np.bitwise_or.at(mask, np.repeat(np.arange(len(counts)), counts)[repeats], np.int64(1) << place[repeats])
        return mask

    def answer(held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = [B.unpack(data) for _, data in held]
        seg = [np.frombuffer(p[0], _U) for p in parts]
        owner = np.concatenate([np.cumsum(B.numbers(p[1])) for p in parts])
        copies = np.concatenate([B.numbers(p[2]) for p in parts])
        uniq, first, at = np.unique(np.concatenate(seg), return_index=True, return_inverse=True)
        copies = np.bincount(at, weights=copies).astype(np.int64)
        order = np.argsort(owner[first], kind="stable")  # segments of one minimizer side by side
        cuts = [np.concatenate(([0], np.cumsum(B.numbers(p[3])))) for p in parts]
        base = np.concatenate(([0], np.cumsum([len(s) for s in seg])))
        part = np.searchsorted(base, first, "right") - 1

        def text(k: int) -> bytes:
            p, i = int(part[k]), int(first[k] - base[part[k]])
            return parts[p][4][cuts[p][i]:cuts[p][i + 1]]

        mask = np.zeros(len(uniq), dtype=np.int64)
        own = owner[first][order]
        groups = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        sizes = np.diff(np.append(groups, len(own)))
        useful = np.repeat(np.bincount(np.repeat(np.arange(len(groups)), sizes), weights=copies[order]) > 1, sizes)
        todo = order[useful].tolist()
        own = own[useful]
        a = 0
        most = max(1, index_words // (2 * width))
        while a < len(todo):
            z = min(len(todo), a + most)
            while z < len(todo) and own[z] == own[z - 1]:
                z += 1
            w = words_of(pa.array([text(k) for k in todo[a:z]], pa.binary()))
            mask[todo[a:z]] = search(w.hashes, w.counts, copies[todo[a:z]])
            a = z
        a = 0
        for (block, _), s in zip(held, seg, strict=True):
            got = mask[at[a:a + len(s)]]
            a += len(s)
            if got.any():
                yield B.rows([(block, block, 1, B.pack(s[got > 0].tobytes(), B.planes(got[got > 0])))])

    return lambda batches: _by_route(batches, answer)


def _finish(width: int, gram: int, hot: bool, schema: T.StructType):
    def drop(t: pa.RecordBatch, seg: np.ndarray, mask: np.ndarray) -> pa.RecordBatch:
        col = t.column(t.num_columns - 1)
        w = words_of(col)
        n = len(w.starts)
        edge = np.zeros(n + 1, dtype=np.int64)
        if len(seg):
            runs = Runs(w, width, gram)

            def hits(h: np.ndarray) -> np.ndarray:
                at = np.searchsorted(seg, h)
                at[at == len(seg)] = 0
                return np.where(seg[at] == h, mask[at], 0)

            got = hits(runs.segment_hash()) if len(runs.token) else np.empty(0, np.int64)
            for j in range(width - gram + 1):
                start = runs.first[got >> j & 1 > 0] + j
                np.add.at(edge, start, 1)
                np.add.at(edge, start + width, -1)
            if hot and len(runs.token):
                every = np.flatnonzero(w.left() >= width)
                h = runs.window_hash(every)
                start = every[hits(mix(h * _U(3) ^ h * _U(5))) > 0]
                np.add.at(edge, start, 1)
                np.add.at(edge, start + width, -1)
        gone = np.cumsum(edge[:n]) > 0
        removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[w.firsts()])
        kept, spans = [], []
        for raw, a, m, out in zip(col, w.firsts()[:-1].tolist(), w.counts.tolist(), removed.tolist(), strict=True):
            words = raw.as_buffer().to_pybytes().split() if raw.is_valid else []
            if out:
                g = np.concatenate(([False], gone[a:a + m], [False]))
                cut = np.flatnonzero(g[1:] != g[:-1]).reshape(-1, 2).tolist()
                spans.append([{"start": x, "end": z} for x, z in cut])
                kept.append(b" ".join([x for x, y in zip(words, g[1:-1].tolist(), strict=True) if not y]).decode())
            else:
                spans.append([])
                kept.append(b" ".join(words).decode())
        span = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        return pa.RecordBatch.from_arrays([*t.columns[:-1], pa.array(w.counts), pa.array(removed), pa.array(kept, pa.string()), span], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, got = None, []
        for b in batches:
            for _, block, kind, data in B.items(b):
                if block != at:
                    at, got = block, []
                if kind == 1:
                    s, m = B.unpack(data)
                    got.append((np.frombuffer(s, _U), B.numbers(m)))
                    continue
                seg = np.concatenate([g[0] for g in got] or [np.empty(0, _U)])
                mask = np.concatenate([g[1] for g in got] or [np.empty(0, np.int64)])
                order = np.argsort(seg)
                for t in slices(iter(_texts(data)), "_text", 2 << 20):
                    yield drop(t, seg[order], mask[order])
        release()

    return run


def dedup(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = WIDTH, gram: int = GRAM, hot: int = HOT, index_words: int = INDEX_WORDS) -> DataFrame:
    """``keep``, n_words, n_removed, kept (the words kept, joined by one space), removed (word spans)."""
    if not width / 2 < width - gram + 1 <= 60:
        raise ValueError("a run's first and last window must cover it, and its windows fit a mask")
    routes = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("removed", span)])
    held = staged(docs.select(*keep, F.col(text).alias("_text")).mapInArrow(_blocks(len(keep)), B.ROW), "text-blocks")

    def routed(df: DataFrame) -> DataFrame:
        return df.repartition(routes, "route").sortWithinPartitions("route")

    def home(df: DataFrame) -> DataFrame:
        return df.unionByName(held).repartition(routes, "block").sortWithinPartitions("block", "kind")

    shared = routed(held.mapInArrow(_send(routes, width, gram), B.ROW)).mapInArrow(_shared, B.ROW)
    segments = home(shared).mapInArrow(_segments(routes, width, gram, hot), B.ROW)
    repeats = routed(segments).mapInArrow(_match(width, index_words), B.ROW)
    return home(repeats).mapInArrow(_finish(width, gram, True, schema), schema)
