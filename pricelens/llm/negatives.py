"""Hard-negative mining by segment summary filtering.

Vectors are cut into segments; of each the mean and the deviation are stored.
For two vectors with means ``m, m'`` and deviations ``d, d'`` of a segment of
length ``n`` the inner product lies within the sum of ``n (m m' - d d')`` and
``n (m m' + d d')``.  Pairs are judged by one segment first, those left open
by more and shorter ones, and only the rest is scored exactly.

1. *Index.*  Rows are packed in blocks sorted by label: ids, labels, whole
   numbers ``floor(256 x)`` and the summaries of the shortest segments, from
   which those of longer ones follow.
2. *Tiles.*  Anchors are dealt to groups of about ``GROUP`` anchors, blocks of
   rows to parts; each tile (group, part) is streamed by one task that holds
   the group, one block and the best rows so far.  Nothing goes through the
   driver, and memory doesn't depend on the sizes of the tables.
3. *Positives.*  In each tile the best rows of an anchor's label are kept; a
   pair is skipped when its upper bound is below the anchor's worst kept row,
   or below the lower bounds of as many rows.  The tiles' answers are ranked.
4. *Negatives.*  The same over rows of other labels, with a window of scores
   for each positive: pairs whose bounds lie outside of all windows, or below
   the rows kept for them, are skipped.

The result is exact: bounds only skip what can't be among the answers.

Rows without id, label or vector, with an empty vector or with a null or
non-finite component take no part; neither do components of ``2**26`` or more
in magnitude, whose scores need not fit 64 bits.  Only vectors of equal
length are compared.  Equal scores go by the smaller id.  A repeated row is a
row of its own among positives and negatives; rows with the anchor's own id
are neither, and a repeated anchor is answered once for each different label
or vector.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, staged

SCALE = 256
#: Lengths of the shortest segments, and numbers of them joined at each level, coarse to fine.
SEGMENT, LEVELS = 4, (16, 4, 1)
#: Rows of a block, anchors that a task holds at once, anchors compared with a block at once.
BLOCK, GROUP, STRIP = 4096, 16_384, 256
_LIMIT = float(1 << 26)
_BLOCK = "tile long, kind int, block long, dim int, rows int, data binary"


def quantised(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label and ``q``, the vector in whole numbers, of the rows that take part."""
    q = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) >= _LIMIT))
    fine = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad
    return rows.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), q.cast("array<long>").alias("q"))


# ------------------------------------------------------------------ summaries

def summaries(q: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each segment (the last is filled up with zeros)."""
    wide = -(-q.shape[1] // segment) * segment
    x = np.zeros((len(q), wide))
    x[:, :q.shape[1]] = q
    x = x.reshape(len(q), -1, segment)
    mean = x.mean(axis=2)
    return mean, np.sqrt(((x - mean[:, :, None]) ** 2).mean(axis=2))


def joined(mean: np.ndarray, dev: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Summaries of ``n`` segments taken together, from theirs."""
    if n == 1:
        return mean, dev
    wide = -(-mean.shape[1] // n) * n
    pad = lambda x: np.pad(x, ((0, 0), (0, wide - x.shape[1]))).reshape(len(x), -1, n)
    m, d = pad(mean), pad(dev)
    top = m.mean(axis=2)
    return top, np.sqrt(np.maximum((d ** 2 + m ** 2).mean(axis=2) - top ** 2, 0))


def bounds(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each pair, with room for rounding."""
    middle, reach = length * (a[0] @ b[0].T), length * (a[1] @ b[1].T)
    room = 1e-9 * np.outer(_norm(a, length), _norm(b, length)) + 1e-3
    return middle - reach - room, middle + reach + room


def _norm(s: tuple[np.ndarray, np.ndarray], length: int) -> np.ndarray:
    return np.sqrt(length * (s[0] ** 2 + s[1] ** 2).sum(axis=1))


class _Side:
    """Vectors with their summaries at each level."""

    def __init__(self, q: np.ndarray, mean: np.ndarray, dev: np.ndarray):
        self.q, self.levels = q, [(joined(mean, dev, n), n * SEGMENT) for n in LEVELS]

    def take(self, at) -> _Side:
        out = object.__new__(_Side)
        out.q, out.levels = self.q[at], [((m[at], d[at]), n) for (m, d), n in self.levels]
        return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where they can't round, else in whole numbers."""
    if not a.size or not b.size or int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 1 << 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def open_pairs(a: _Side, b: _Side, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row and score of the allowed pairs whose score is within ``low`` and ``high`` of the anchor.

    Coarse bounds go first; anchors and rows without open pairs are left out
    of the finer ones.  Of more than ``want`` pairs of an anchor that surely
    score ``high`` or less, those below the lower bounds of ``want`` are skipped.
    """
    i, j, low = np.arange(len(a.q)), np.arange(len(b.q)), low.copy()
    for level in range(len(LEVELS)):
        if not allowed.any():
            break
        (sa, n), (sb, _) = a.levels[level], b.levels[level]
        least, most = bounds((sa[0][i], sa[1][i]), (sb[0][j], sb[1][j]), n)
        allowed &= (most >= low[i][:, None]) & (least <= high[i][:, None])
        if want < allowed.shape[1]:
            sure = np.where(allowed & (most <= high[i][:, None]), least, -np.inf)
            low[i] = np.maximum(low[i], np.partition(sure, -want, axis=1)[:, -want])
            allowed &= most >= low[i][:, None]
        rows, cols = allowed.any(axis=1), allowed.any(axis=0)
        i, j, allowed = i[rows], j[cols], allowed[np.ix_(rows, cols)]
    if not allowed.any():
        none = np.empty(0, np.int64)
        return none, none, none
    s = scores(a.q[i], b.q[j])
    allowed &= (s >= low[i][:, None]) & (s <= high[i][:, None])
    x, y = np.nonzero(allowed)
    return i[x], j[y], s[x, y]


class Best:
    """The ``most`` best rows of each slot: greatest score, then smallest id."""

    def __init__(self, n: int, most: int):
        self.most = most
        self.slot, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.floor = np.full(n, -np.inf)

    def add(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ident = np.append(self.slot, slot), np.append(self.score, score), np.append(self.id, ident)
        order = np.lexsort((ident, -score, slot))
        slot, score, ident = slot[order], score[order], ident[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = rank < self.most
        self.slot, self.score, self.id = slot[keep], score[keep], ident[keep]
        full = rank == self.most - 1
        self.floor[slot[full]] = score[full]


# --------------------------------------------------------------- blocks, tiles

def _packed(kind: int, extra: bool = False):
    """Rows into blocks of one vector length, sorted by label: ids, labels, numbers, summaries (and windows of scores)."""

    def flush(block: int, dim: int, rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[1], r[0]))
        ids, labels = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        q = np.array([r[2] for r in rows], np.int64)
        mean, dev = summaries(q)
        parts = [ids.tobytes(), labels.tobytes(), q.astype(np.int32).tobytes(), mean.astype("<f8").tobytes(), dev.astype("<f8").tobytes()]
        if kind == 0:
            parts.append(np.array([r[3] for r in rows], np.int64).tobytes())
        if extra:
            parts.append(np.array([[*r[4], *([_NONE] * (extra - len(r[4])))] for r in rows], np.int64).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((0, kind, block, dim, len(rows), b"".join(parts)), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["tile", "kind", "block", "dim", "rows", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, {}
        for b in (x.slice(k, 1024) for x in batches for k in range(0, x.num_rows, 1024)):
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = held.setdefault(len(row[2]), [])
                own.append(row)
                if len(own) == BLOCK:
                    yield flush(block, len(row[2]), held.pop(len(row[2])))
                    block += 1
        for dim, own in held.items():
            yield flush(block, dim, own)
            block += 1
        held.clear()
        release()

    return run


_NONE = np.iinfo(np.int64).min


def _unpacked(dim: int, rows: int, data: bytes, kind: int, extra: int) -> tuple:
    segments, at, out = -(-dim // SEGMENT), 0, []
    for many, t in ((1, "<i8"), (1, "<i8"), (dim, "<i4"), (segments, "<f8"), (segments, "<f8"), *([(1, "<i8")] if kind == 0 else []), *([(extra, "<i8")] if extra else [])):
        size = rows * many * int(t[2])
        out.append(np.frombuffer(data, t, rows * many, at).reshape((rows, many) if many > 1 or t == "<f8" or t == "<i4" else rows))
        at += size
    return tuple(out)


class _Group:
    """Anchors of one length that a tile holds, sorted by label, with what is kept for them."""

    def __init__(self, blocks: list[tuple], extra: int, most: int, strip: int):
        cols = [np.concatenate(c) for c in zip(*blocks, strict=True)]
        order = np.argsort(cols[1], kind="stable")
        self.id, self.label, q, mean, dev, self.key = (c[order] for c in cols[:6])
        self.side = _Side(q.astype(np.int64), mean, dev)
        self.windows = cols[6][order].reshape(len(order), extra) if extra else None
        self.best = Best(len(self.id) * max(1, extra), most)
        cuts = np.flatnonzero(np.concatenate(([True], self.label[1:] != self.label[:-1], [True])))
        self.strips = [(lo, min(lo + strip, z)) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) for lo in range(a, z, strip)]


def _positives(g: _Group, ids, labels, side: _Side, most: int) -> None:
    for lo, hi in g.strips:
        a, z = np.searchsorted(labels, g.label[lo]), np.searchsorted(labels, g.label[lo], "right")
        if a == z:
            continue
        allowed = ids[None, a:z] != g.id[lo:hi, None]
        i, j, s = open_pairs(g.side.take(slice(lo, hi)), side.take(slice(a, z)), allowed, g.best.floor[lo:hi], np.full(hi - lo, np.inf), most)
        g.best.add(i + lo, s, ids[a:z][j])


def _negatives(g: _Group, ids, labels, side: _Side, most: int) -> None:
    n = g.windows.shape[1]
    for lo, hi in g.strips:
        top = g.windows[lo:hi]
        used = top != _NONE
        least = np.where(used, -(-80 * top // 100), 0)
        floor = np.maximum(least, g.best.floor.reshape(-1, n)[lo:hi])
        low = np.where(used, floor, np.inf).min(axis=1)
        high = np.where(used, top, -np.inf).max(axis=1)
        a, z = np.searchsorted(labels, g.label[lo]), np.searchsorted(labels, g.label[lo], "right")
        allowed = ids[None, :] != g.id[lo:hi, None]
        allowed[:, a:z] = False
        # several windows share the pairs: the lower bounds of a few can't close those of a lower window
        i, j, s = open_pairs(g.side.take(slice(lo, hi)), side, allowed, low, high, len(ids) + 1)
        for k in range(n):
            own = used[i, k] & (s >= floor[i, k]) & (s <= top[i, k])
            g.best.add((i[own] + lo) * n + k, s[own], ids[j[own]])


def _tiles(anchors: DataFrame, blocks: DataFrame, groups: int, parts: int, extra: int, most: int, step) -> DataFrame:
    """(key, slot, score, id): the best rows of each anchor (and window) in each tile."""
    per = lambda df, own, n, other, tile: df.withColumn("_own", F.pmod(F.xxhash64("block"), F.lit(n))).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(other - 1)))).withColumn("tile", F.expr(tile)).drop("_own", "_other")
    dealt = per(anchors, "group", groups, parts, f"_own * {parts} + _other").unionByName(per(blocks, "part", parts, groups, f"_other * {parts} + _own"))
    columns = [c.split()[0] for c in _BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, waiting, held = None, {}, {}

        def answer() -> Iterator[pa.RecordBatch]:
            for g in held.values():
                slots = max(1, extra)
                for k in range(0, len(g.best.slot), 50_000):
                    s, score, ident = (x[k:k + 50_000] for x in (g.best.slot, g.best.score, g.best.id))
                    yield pa.RecordBatch.from_arrays([pa.array(g.key[s // slots]), pa.array((s % slots).astype(np.int32)), pa.array(score), pa.array(ident)], ["key", "slot", "score", "id"])
            held.clear()
            waiting.clear()

        for b in batches:
            for at, kind, _, dim, rows, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != tile:
                    yield from answer()
                    tile = at
                if kind == 0:
                    waiting.setdefault(dim, []).append(_unpacked(dim, rows, data, 0, extra))
                    continue
                if dim in waiting:
                    held[dim] = _Group(waiting.pop(dim), extra, most, STRIP)
                if dim in held:
                    ids, labels, q, mean, dev = _unpacked(dim, rows, data, 1, 0)
                    step(held[dim], ids, labels, _Side(q.astype(np.int64), mean, dev), most)
        yield from answer()
        release()

    return (dealt.select(*columns).repartition(groups * parts, "tile").sortWithinPartitions("tile", "kind", "dim", "block")
            .mapInArrow(run, "key long, slot int, score long, id long"))


def _ranked(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` as ``quantised`` gives them; ``is_anchor`` is a condition on
    ``vec_id``.  For each of an anchor's best ``positives`` rows of its label:
    the best ``negatives`` rows of other labels that score 80 to 100 % of it.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = staged(rows, "vectors")
    blocks = staged(rows.mapInArrow(_packed(1), _BLOCK), "vector-blocks")
    anchors = staged(rows.where(is_anchor).dropDuplicates(["vec_id", "label", "q"]).withColumn("key", F.monotonically_increasing_id()).select("vec_id", "label", "q", "key"), "anchors")
    groups = max(1, -(-anchors.count() // GROUP))
    parts = max(1, -(-tasks // groups))
    found = _tiles(anchors.mapInArrow(_packed(0), _BLOCK), blocks, groups, parts, 0, positives, _positives)
    best = staged(_ranked(found, positives).select("key", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = best.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("windows"))
    asked = anchors.join(windows, "key").select("vec_id", "label", "q", "key", "windows")
    found = _ranked(_tiles(asked.mapInArrow(_packed(0, positives), _BLOCK), blocks, groups, parts, positives, negatives, _negatives), negatives)
    return (found.withColumn("place", F.col("slot") + 1).join(best, ["key", "place"]).join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key")
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
