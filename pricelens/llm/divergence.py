"""Source divergence audit by single-pass in-memory indexing.

How far the words of each source of a language lie from every other source's,
and which terms set it apart from its language.

1. *Blocks.*  Tasks read the documents once.  Postings (language, term,
   source, occurrences, documents) are built in memory; when a block is full,
   it is spilled as a run sorted by term and cut into hash shards.
2. *Merge.*  A shard's runs are merged with a heap over their pages into the
   frequencies of the terms kept: those in ``MIN_DOCS`` documents of their
   language.  A task holds one shard's packed runs and the open pages.
3. *Pairs.*  With ``f(p, q) = floor((p - q)**2 / q)`` and each source's share
   ``z`` of a term that it doesn't have, a pair's sum over all kept terms is
   ``V f(z, z')``, plus corrections for the terms of either source, taken from
   a table of how many terms have which share, plus corrections for the
   terms of both.  Only the last needs the terms: their source lists are
   streamed, in tiles of ``TILE`` sources at most, and summed by pair.
4. *Terms.*  A term's value for a source is ``f`` of its shares there and in
   the language; the first ``TERM_RANKS`` are kept.

Shares are whole numbers: ``1 + floor(SCALE (count + 1) / (N + V))``, with
``N`` the source's or language's occurrences of kept terms and ``V`` the number
of kept terms.  All sums are exact.

Null text, language and source are empty strings.  Every row is a document,
repeated rows too.  Texts without terms still make their source occur.  A
language without kept terms has value 0 for each pair and no term rows.  Ties
go by the UTF-8 order of the item.  An empty table gives no rows.  Other
columns are not read.
"""

from __future__ import annotations

import heapq
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from .common import release, slices, staged, words_of

MIN_DOCS = 3
TERM_RANKS = 200
SCALE = 1_000_000_000
#: Bytes of postings that a block holds before it is spilled, and rows of a run's page.
BLOCK_BYTES, PAGE = 24 << 20, 4096
#: Hash shards of each shuffle partition, taken one after another.
ROUTES = 4
#: Sources of a term that are paired at once; pairs a task computes, and sums it holds, at once.
TILE, PAIRS, SUMS = 1024, 1 << 20, 1 << 20

_TERM = np.zeros(256, dtype=bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RUN = pa.schema([("key", pa.large_binary()), ("source", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


# ------------------------------------------------------------ 1. blocks, runs

def _slice_postings(col: pa.Array, group: np.ndarray) -> pa.Table:
    """(group, term, n, docs) of a slice of texts; ``group`` of each text."""
    w = words_of(col, hashed=False, word_bytes=_TERM)
    letters = _LOWER[w.data[_TERM[w.data]]]
    ends = np.concatenate(([0], np.cumsum(w.ends - w.starts))).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_binary(), len(w.starts), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
    code, many = terms.indices.to_numpy().astype(np.int64), max(1, len(terms.dictionary))
    pair, n = np.unique(np.repeat(np.arange(len(col)), w.counts) * many + code, return_counts=True)
    own, at = np.unique(group[pair // many] * many + pair % many, return_inverse=True)
    return pa.table({"group": own // many, "term": terms.dictionary.take(pa.array(own % many)), "n": np.bincount(at, n, len(own)).astype(np.int64), "docs": np.bincount(at, minlength=len(own))})


def _runs(shards: int):
    def folded(tables: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(tables).group_by(["group", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return t.select(["group", "term", "n_sum", "docs_sum"]).rename_columns(["group", "term", "n", "docs"])

    def spilled(run: int, t: pa.Table, groups: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        """Rows of the run: its part of each shard, sorted by language, term and source."""
        lang = pa.array([g[0].encode() for g in groups], pa.large_binary())
        source = pa.array([g[1] for g in groups], pa.string())
        term = t["term"].combine_chunks().dictionary_encode()
        shard = np.array([zlib.crc32(x) % shards for x in term.dictionary.to_pylist()], dtype=np.int64)[term.indices.to_numpy()]
        key = pc.binary_join_element_wise(lang.take(t["group"].combine_chunks()), t["term"].combine_chunks(), pa.scalar(b"\0", pa.large_binary()))
        rows = pa.table({"shard": shard, "key": key, "source": source.take(t["group"].combine_chunks()), "n": t["n"], "docs": t["docs"]})
        rows = rows.sort_by([("shard", "ascending"), ("key", "ascending"), ("source", "ascending")])
        shard = rows["shard"].to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, _RUN, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows.slice(a, z - a).drop_columns("shard").combine_chunks().cast(_RUN), max_chunksize=PAGE)
            yield B.rows([(int(shard[a]), run, 0, sink.getvalue())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, groups, held, size = TaskContext.get().partitionId() << 32, {}, [], 0
        for b in slices(batches, "text"):
            own = [groups.setdefault(g, len(groups)) for g in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            held.append(_slice_postings(b.column(0), np.array(own, dtype=np.int64)))
            size += held[-1].nbytes
            if size > BLOCK_BYTES:
                held = [folded(held)]
                size = held[0].nbytes
                if size > BLOCK_BYTES // 2:
                    yield from spilled(seq, held[0], list(groups))
                    seq, groups, held, size = seq + 1, {}, [], 0
        if held:
            yield from spilled(seq, folded(held), list(groups))
        held.clear()
        release()

    return run


# -------------------------------------------------------------------- 2. merge

def merged(runs: list[bytes]) -> Iterator[pa.Table]:
    """Sums by key and source over sorted runs: tables in key order, no key in two of them.

    The heap has the first key of each run's open page; each round takes the
    rows up to the least of the open pages' last keys.
    """
    heap = []

    def open_page(i: int, reader) -> None:
        for page in reader:
            if page.num_rows:
                heapq.heappush(heap, (page["key"][0].as_py(), i, page, reader))
                return

    for i, data in enumerate(runs):
        open_page(i, iter(pa.ipc.open_stream(data)))
    while heap:
        last = min(page["key"][-1].as_py() for _, _, page, _ in heap)
        taken = []
        while heap and heap[0][0] <= last:
            _, i, page, reader = heapq.heappop(heap)
            many = pc.sum(pc.less_equal(page["key"], pa.scalar(last, pa.large_binary()))).as_py()
            taken.append(page.slice(0, many))
            if many < page.num_rows:
                page = page.slice(many)
                heapq.heappush(heap, (page["key"][0].as_py(), i, page, reader))
            else:
                open_page(i, reader)
        t = pa.Table.from_batches(taken).group_by(["key", "source"]).aggregate([("n", "sum"), ("docs", "sum")])
        yield t.select(["key", "source", "n_sum", "docs_sum"]).rename_columns(["key", "source", "n", "docs"]).sort_by([("key", "ascending"), ("source", "ascending")])


def _merge(min_docs: int):
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("leads", pa.bool_())])

    def kept(t: pa.Table) -> pa.RecordBatch | None:
        key = t["key"].combine_chunks().dictionary_encode()
        at = key.indices.to_numpy()
        n, docs = (t[c].to_numpy() for c in ("n", "docs"))
        first = np.concatenate(([True], at[1:] != at[:-1]))
        starts = np.flatnonzero(first)
        total, seen = (np.add.reduceat(x, starts)[at] for x in (n, docs))
        use = seen >= min_docs
        if not use.any():
            return None
        lang, term = zip(*(x.rsplit(b"\0", 1) for x in key.dictionary.to_pylist()), strict=True)
        names = lambda x: pa.array([v.decode() for v in x], pa.string()).take(pa.array(at[use]))
        return pa.RecordBatch.from_arrays([names(lang), names(term), t["source"].combine_chunks().filter(pa.array(use)), pa.array(n[use]), pa.array(total[use]), pa.array(first[use])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for b in batches:
            for at, _, _, data in B.items(b):
                if at != shard:
                    yield from filter(None, map(kept, merged(held)))
                    shard, held = at, []
                held.append(data)
        yield from filter(None, map(kept, merged(held)))
        held.clear()
        release()

    return run


def frequencies(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, source, n (occurrences there), total (in the language), leads (on one row of each term) of the kept terms."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = docs.select("text", "lang", "source").mapInArrow(_runs(ROUTES * parts), B.ROW)
    return (runs.repartition(parts, "route").sortWithinPartitions("route", "block")
            .mapInArrow(_merge(min_docs), "lang string, term string, source string, n long, total long, leads boolean"))


# -------------------------------------------------------------------- 3. pairs

def _share(n: str, total: str) -> str:
    return f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + 1 AS DECIMAL(20, 0))) div greatest(CAST({total} + v AS DECIMAL(20, 0)), 1)"


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _both(most_pairs: int, most_sums: int):
    """Corrections of source pairs for the terms of both, as sums (high * 2**32 + low)."""
    names = ["lang", "a", "b", "high", "low"]

    def folded(parts: list[np.ndarray]) -> np.ndarray:
        x = np.concatenate(parts, axis=1)
        x = x[:, np.lexsort((x[1], x[0]))]
        new = np.flatnonzero(np.concatenate(([True], (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1]))))
        return np.vstack([x[:2, new], np.add.reduceat(x[2], new), np.add.reduceat(x[3], new)])

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            x = folded(parts)
            for k in range(0, x.shape[1], 50_000):
                part = x[:, k:k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * part.shape[1], pa.string()), *map(pa.array, part)], names)
        held.clear()

    def lists(col: pa.ListArray) -> tuple[np.ndarray, ...]:
        at = col.offsets.to_numpy()
        flat = col.values
        return at, *(flat.field(k).to_numpy() for k in range(3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            lang = batch.column(0).to_pylist()
            at, a_id, a_p, a_z = lists(batch.column(1))
            bt, b_id, b_p, b_z = lists(batch.column(2))
            many = np.diff(at) * np.diff(bt)
            i = 0
            while i < len(lang):
                # rows of one language, as many as make most_pairs pairs
                j = i + 1
                total = int(many[i])
                while j < len(lang) and lang[j] == lang[i] and total + many[j] <= most_pairs:
                    total += int(many[j])
                    j += 1
                row = np.repeat(np.arange(i, j), many[i:j])
                step = np.arange(total) - np.repeat(np.cumsum(many[i:j]) - many[i:j], many[i:j])
                wide = np.diff(bt)[row]
                x, y = at[row] + step // wide, bt[row] + step % wide
                apart = a_id[x] != b_id[y]
                x, y = x[apart], y[apart]
                if len(x):
                    g = _gap(a_p[x], b_p[y]) - _gap(a_p[x], b_z[y]) - _gap(a_z[x], b_p[y]) + _gap(a_z[x], b_z[y])
                    own = held.setdefault(lang[i], [])
                    own.append(np.vstack([a_id[x], b_id[y], g >> 32, g & 0xFFFFFFFF]))
                    own[:] = [folded(own)]
                    size = sum(p[0].shape[1] for p in held.values())
                    if size > most_sums:
                        yield from flush(held)
                i = j
        yield from flush(held)
        release()

    return run


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank from documents (text, lang, source)."""
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    freq = staged(frequencies(docs, min_docs), "frequencies")
    langs = freq.where("leads").groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    stats = (docs.select("lang", "source").distinct().join(freq.groupBy("lang", "source").agg(F.sum("n").alias("n_source")), ["lang", "source"], "left").join(langs, "lang", "left")
             .na.fill(0, ["v", "n_lang", "n_source"]))
    stats = stats.withColumn("id", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1).withColumn("z", F.expr(_share("0L", "n_source")))
    stats = staged(stats, "sources")
    priced = staged(freq.join(stats, ["lang", "source"]).withColumn("p", F.expr(_share("n", "n_source"))).withColumn("q", F.expr(_share("total", "n_lang"))), "shares")

    terms = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= term_ranks)

    lists = priced.groupBy("lang", "term", F.expr(f"id DIV {TILE}").alias("tile")).agg(F.collect_list(F.struct("id", "p", "z")).alias("a"))
    if (stats.agg(F.max("id")).first()[0] or 0) < TILE:
        tiles = lists.select("lang", "a", F.col("a").alias("b"))
    else:
        lists = staged(lists, "source-lists")
        tiles = lists.select("lang", "term", "a").join(lists.select("lang", "term", F.col("a").alias("b")), ["lang", "term"]).select("lang", "a", "b")
    both = tiles.mapInArrow(_both(PAIRS, SUMS), "lang string, a long, b long, high long, low long").select("lang", "a", "b", F.expr("CAST(high AS DECIMAL(38, 0)) * 4294967296BD + low").cast("decimal(38, 0)").alias("value"))
    one = stats.select("lang", F.col("id").alias("a"), F.col("z").alias("za"), "v")
    other = stats.select("lang", F.col("id").alias("b"), F.col("z").alias("zb"))
    exact = lambda n, x: F.expr(f"CAST({n} AS DECIMAL(18, 0)) * CAST({x} AS DECIMAL(20, 0))").cast("decimal(38, 0)").alias("value")
    base = one.join(other, "lang").where("a <> b").select("lang", "a", "b", exact("v", _f("za", "zb")))
    shares = staged(priced.groupBy("lang", "id", "z", "p").agg(F.count("*").alias("n")), "share-counts")
    of_a = shares.select("lang", F.col("id").alias("a"), F.col("z").alias("za"), "p", "n").join(other, "lang").where("a <> b").select("lang", "a", "b", exact("n", f"{_f('p', 'zb')} - {_f('za', 'zb')}"))
    of_b = shares.select("lang", F.col("id").alias("b"), F.col("z").alias("zb"), "p", "n").join(one, "lang").where("a <> b").select("lang", "a", "b", exact("n", f"{_f('za', 'p')} - {_f('za', 'zb')}"))
    pairs = base.unionByName(of_a).unionByName(of_b).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").cast("long").alias("value"))
    named = lambda c, name: stats.select("lang", F.col("id").alias(c), F.col("source").alias(name))
    pairs = pairs.join(named("a", "source"), ["lang", "a"]).join(named("b", "item"), ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)
