"""N-gram Jaccard join by set-relation skipping.

A text's set is its distinct 5-word shingles; two sets link when
``100 * |x & y| >= 80 * |x | y|``.  The join is exact (shingles are compared
by 48-bit hashes, sets by 64-bit hashes) and returns the components of the links.

1. *Sharing.*  Blocks of texts send their distinct shingles, delta-coded, to
   the shuffle partition that owns the hash range, which returns those that
   some other text has too, with their document frequency.  A text of which
   fewer than 80 % come back can link with nothing and is done.  Shingles that
   several texts of a block share are sent once per block, so a shingle in a
   third of all texts costs an entry a block, not one a text.
2. *Index.*  Equal sets become one class.  A class enters the index lists of
   its rarest shingles (unshared ones count first), as many as the prefix rule
   asks for: any linked pair meets in a list.
3. *Computed answers.*  In each list the class whose shingles are the most
   widespread is the list's hub; overlaps are computed for hub and member
   only, one each.  Linked members form components.
4. *Derived answers.*  Lists whose members are all in one component are
   skipped.  In the others only pairs across components remain: blocks of
   equal size are skipped or cut by position, and of two members ``x``, ``y``
   of hub ``h`` the computed overlaps bound theirs,
   ``o(x,h) + o(y,h) - |h| <= |x & y| <= min(o) + min(|x| - o(x,h), |y| - o(y,h))``;
   only pairs that neither bound decides are compared.

Work on a list grows with its members, plus the undecided pairs across
components.  Long lists are dealt out in parts, arrays of hubs with many
members as well.

Null and empty texts have empty sets: no links, their own component.  Texts
of fewer than five words have their whole word sequence as one shingle.
Repeated rows are linked like other copies (a repeated ``doc_id`` is one
more row with that id); a null ``doc_id`` never names a component.  Blocks are
numbered by partition: give a table scan or a staged table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import doc_shingles, fresh, release, slices, staged, words_of
from .graph import components

BLOCK_BYTES = 8 << 20
#: Similarity as whole numbers: links need PART * |x & y| >= SHARE * |x | y|.
PART, SHARE = 100, 80
BITS = 48
#: Hash ranges of each shuffle partition, taken one after another.
ROUTES = 8
#: Members of a list, or classes compared with one, that a task takes together.
LIST_PART, PAIR_PART = 20_000, 256
#: Bytes of keep flags (a bit a row) that one scan gets.
FLAG_BYTES = 32 << 20
_BIT = "shiftrightunsigned(element_at(`{words}`, CAST(`{place}` DIV 64 AS INT) + 1), CAST(`{place}` % 64 AS INT)) & 1L = 1L"
_SETS = "doc_id long, text_key long, n_shingles long, sig long, tokens binary, prefix binary, alone long, central long"


def _least_overlap(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of ``n`` must share with any set it links with."""
    return -(-SHARE * n // PART)


# ------------------------------------------------------------ 1. shared shingles

def _send(routes: int):
    def flush(block: int, sets: list[np.ndarray], ids: list[pa.RecordBatch]) -> list[tuple[int, int, int, bytes]]:
        n = np.array([len(s) for s in sets], dtype=np.int64)
        token = (np.concatenate(sets) >> np.uint64(64 - BITS)).astype(np.int64)
        doc = np.repeat(np.arange(len(sets)), n)
        order = np.argsort(token, kind="stable")
        token, doc = token[order], doc[order]
        new = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.empty(0, np.int64)
        many = np.diff(np.append(new, len(token)))
        token, ref = token[new], doc[new]
        multi = np.flatnonzero(many > 1)
        ref[multi] = len(sets) + np.arange(len(multi))
        cuts = np.searchsorted(token, np.array([(r << BITS) // routes for r in range(routes + 1)], dtype=np.int64))
        out = []
        for r in range(routes):
            a, z = int(cuts[r]), int(cuts[r + 1])
            if a < z:
                own = many[a:z]
                out.append((r, block, 0, B.pack(B.planes(np.diff(token[a:z], prepend=0)), B.planes(ref[a:z]), B.planes(own[own > 1]), len(sets).to_bytes(8, "little"))))
        inside = np.repeat(many > 1, many)
        sig = b"".join(hashlib.blake2b(s.tobytes(), digest_size=8).digest() for s in sets)
        out.append((routes + block % routes, block, 2, B.pack(B.planes(n), sig, B.planes(many[multi]), B.planes(doc[inside]), B.ipc(pa.Table.from_batches(ids)))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, sets, ids = TaskContext.get().partitionId() << 32, 0, [], []
        for b in slices(batches, "text", 1 << 20):
            for s in doc_shingles(words_of(b.column(1), lower=True)):
                sets.append(s)
            ids.append(b.select(["doc_id", "text_key"]))
            size += b.column(1).nbytes
            if size >= BLOCK_BYTES:
                yield B.rows(flush(block, sets, ids))
                block, size, sets, ids = block + 1, 0, [], []
        if sets:
            yield B.rows(flush(block, sets, ids))
        del sets, ids
        release()

    return run


def _share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of a route that two or more texts have, back to their blocks."""
    route, held = None, []

    def answer() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        token, ref, many = (np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
        _, at = np.unique(token, return_inverse=True)
        df = np.bincount(at, weights=many).astype(np.int64)[at]
        first = 0
        for block, t, *_ in held:
            own = slice(first, first + len(t))
            first += len(t)
            keep = df[own] > 1
            if keep.any():
                yield B.rows([(block, block, 1, B.pack(B.planes(np.diff(t[keep], prepend=0)), B.planes(ref[own][keep]), B.planes(df[own][keep])))])

    for b in batches:
        for r, block, kind, data in B.items(b):
            if kind == 2:
                yield B.rows([(block, block, 2, data)])
                continue
            if r != route:
                yield from answer()
                route, held = r, []
            delta, refs, counts, docs = B.unpack(data)
            ref = B.numbers(refs)
            many = np.ones(len(ref), dtype=np.int64)
            many[ref >= int.from_bytes(docs, "little")] = B.numbers(counts)
            held.append((block, np.cumsum(B.numbers(delta)), ref, many))
    yield from answer()
    held.clear()
    release()


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text with its shared shingles, null where it can link with nothing."""
    block, got = None, []
    for b in batches:
        for _, at, kind, data in B.items(b):
            if at != block:
                block, got = at, []
            if kind == 1:
                got.append([B.numbers(x) for x in B.unpack(data)])
                continue
            sizes, sig, many, inside, table = B.unpack(data)
            n, many, inside = B.numbers(sizes), B.numbers(many), B.numbers(inside)
            ids = pa.ipc.open_stream(table).read_all().combine_chunks()
            empty = np.empty(0, np.int64)
            token = np.concatenate([np.cumsum(x[0]) for x in got] or [empty])
            ref = np.concatenate([x[1] for x in got] or [empty])
            df = np.concatenate([x[2] for x in got] or [empty])
            times = np.ones(len(ref), dtype=np.int64)
            listed = ref >= len(n)
            times[listed] = many[ref[listed] - len(n)]
            starts = np.concatenate(([0], np.cumsum(many)))
            doc = np.repeat(ref, times)
            step = np.arange(len(doc)) - np.repeat(np.cumsum(times) - times, times)
            wide = np.repeat(listed, times)
            doc[wide] = inside[starts[doc[wide] - len(n)] + step[wide]]
            token, df = np.repeat(token, times), np.repeat(df, times)
            shared = np.bincount(doc, minlength=len(n))
            able = (shared >= _least_overlap(n)) & (n > 0)
            keep = able[doc]
            token, df, doc = token[keep], df[keep], doc[keep]
            order = np.lexsort((token, doc))
            token, df, doc = token[order], df[order], doc[order]
            ends = np.cumsum(np.bincount(doc, minlength=len(n)))
            rare = np.lexsort((token, df, doc))
            most = np.maximum(0, shared - _least_overlap(n) + 1)  # index entries beside the unshared shingles
            whole, prefix, central = [], [], []
            for a, z, k, m, total in zip((ends - np.diff(ends, prepend=0)).tolist(), ends.tolist(), able.tolist(), most.tolist(), np.maximum(n, 1).tolist(), strict=True):
                whole.append(B.planes(np.diff(token[a:z], prepend=0)) if k else None)
                prefix.append(B.planes(token[rare[a:min(z, a + m)]]) if k else None)
                central.append(int(df[a:z].sum()) * 1000 // total)
            cols = [*(pa.array(c.to_pylist(), pa.int64()) for c in ids.columns), pa.array(n), pa.array(np.frombuffer(sig, np.int64)), pa.array(whole, pa.binary()), pa.array(prefix, pa.binary()), pa.array(n - shared), pa.array(central, pa.int64())]
            result = pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "n_shingles", "sig", "tokens", "prefix", "alone", "central"])
            for i in range(0, len(n), 1000):
                yield result.slice(i, 1000)
            del token, ref, df, doc, order, rare, wide, listed, step, times, whole, prefix, result
            got = []
            release()


def shingle_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, sig (of the set), and for texts that may link
    the shared shingles, the index entries among them and the number of unshared ones."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routes = ROUTES * parts
    sent = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key")).mapInArrow(_send(routes), B.ROW)
    shared = sent.repartition(parts, "route").sortWithinPartitions("route").mapInArrow(_share, B.ROW)
    return shared.repartition(parts, "block").sortWithinPartitions("block", "kind").mapInArrow(_collect, _SETS)


# ------------------------------------------------------------------- 2. index

def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index entries of each class: its rarest shingles up to the prefix length."""
    for b in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
        token = [B.numbers(x) for x in b.column(2).to_pylist()]
        at = np.repeat(np.arange(len(token)), [len(t) for t in token])
        if len(at):
            first = np.concatenate(([0], np.cumsum([len(t) for t in token])))[:-1]
            sig, n, _, alone, central = (c.take(pa.array(at)) for c in b.columns)
            pos = alone.to_numpy() + np.arange(len(at)) - first[at]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token)), sig, n, pa.array(pos), central], ["token", "sig", "n", "pos", "central"])
    release()


def _need(x: str, y: str) -> str:
    """Overlap that sets of these sizes need to link."""
    return f"ceil({SHARE} * ({x} + {y}) / {SHARE + PART})"


def _compared(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) -> (a, b, na, nb, o): each class ``a`` is laid beside the classes it is compared with."""
    parts = staged(pairs.groupBy("a").agg(F.count("*").alias("many")), "pair-counts")
    dealt = staged(pairs.join(parts, "a").select("a", "b", F.expr(f"pmod(xxhash64(b), ceil(many / {PAIR_PART}))").cast("int").alias("part")), "pairs")
    wanted = dealt.select("a", "part", "b", F.col("b").alias("sig")).unionByName(dealt.select("a", "part").distinct().select("a", "part", F.lit(None).cast("long").alias("b"), F.col("a").alias("sig")))
    laid = wanted.join(classes.select("sig", F.col("n_shingles").alias("n"), "tokens"), "sig").select("a", "part", "b", "n", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n_base = None, 0
        for batch in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
            out = []
            for a, _, b, n, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = np.cumsum(B.numbers(t))
                if b is None:
                    base, n_base = t, n
                    continue
                at = np.searchsorted(base, t)
                at[at == len(base)] = 0
                out.append((a, b, n_base, n, int((base[at] == t).sum()) if len(base) else 0))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b", "na", "nb", "o"])
        release()

    return (laid.repartition("a", "part").sortWithinPartitions(F.col("a"), F.col("part"), F.col("b").asc_nulls_first())
            .mapInArrow(run, "a long, b long, na long, nb long, o long"))


_LINKED = f"{PART} * o >= {SHARE} * (na + nb - o)"


# --------------------------------------------------------- 4. derived answers

def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs across components of each tile of a list, probes against members,
    that the bounds leave open or decide as links."""
    key, held = None, []

    def pairs() -> Iterator[pa.RecordBatch]:
        members, probes = ([r[1:] for r in held if r[0] == kind] for kind in (False, True))
        if not members or not probes:
            return
        sig, n, pos, comp, also_probe, o, hub_n = (np.array(x) for x in zip(*members, strict=True))
        hub_n = int(hub_n[0])
        place = n << 32 | pos  # rows come sorted by it
        sizes = np.unique(n)
        out = []
        for p_sig, p_n, p_pos, p_comp, _, p_o, _ in probes:
            size = sizes[(SHARE * sizes <= PART * p_n) & (SHARE * p_n <= PART * sizes)]
            need = -(-SHARE * (p_n + size) // (SHARE + PART))
            open_ = (p_n - p_pos >= need) & (size >= need)  # else the whole block is skipped
            size, need = size[open_], need[open_]
            lo, hi = np.searchsorted(place, size << 32), np.searchsorted(place, (size << 32 | size - need) + 1)
            j = np.concatenate([np.arange(a, z) for a, z in zip(lo.tolist(), hi.tolist(), strict=True)] or [np.empty(0, np.int64)])
            # of two probes, the pair comes from the one with the smaller id
            j = j[(comp[j] != p_comp) & (~also_probe[j] | (sig[j] > p_sig))]
            if not len(j):
                continue
            need = -(-SHARE * (p_n + n[j]) // (SHARE + PART))
            known = (p_o >= 0) & (o[j] >= 0)
            keep = ~known | (np.minimum(p_o, o[j]) + np.minimum(p_n - p_o, n[j] - o[j]) >= need)
            sure = known & (p_o + o[j] - hub_n >= need)
            out += [(min(p_sig, s), max(p_sig, s), d) for s, d in zip(sig[j[keep]].tolist(), sure[keep].tolist(), strict=True)]
        if out:
            a, b, sure = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sure)], ["a", "b", "sure"])

    for batch in batches:
        for token, row, col, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (token, row, col) != key:
                yield from pairs()
                key, held = (token, row, col), []
            held.append(rest)
    yield from pairs()
    held.clear()
    release()


def links(classes: DataFrame) -> DataFrame:
    """Links (a, b) between classes that make the same components as all links do."""
    postings = staged(classes.select("sig", "n_shingles", "prefix", "alone", "central").mapInArrow(_postings, "token long, sig long, n long, pos long, central long"), "postings")
    hubs = staged(postings.groupBy("token").agg(F.count("*").alias("many"), F.max(F.struct("central", "sig", "n", "pos")).alias("hub")).where("many > 1")
                  .select("token", "many", F.col("hub.sig").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.pos").alias("hub_pos")), "hubs")
    lists = staged(postings.drop("central").join(hubs, "token"), "lists")
    met = lists.where("sig <> hub").where(f"least(n - pos, hub_n - hub_pos) >= {_need('n', 'hub_n')} AND {PART} * least(n, hub_n) >= {SHARE} * greatest(n, hub_n)")
    computed = staged(_compared(met.select(F.col("hub").alias("a"), F.col("sig").alias("b")).distinct(), classes), "computed")
    direct = computed.where(_LINKED).select("a", "b")
    comp = staged(components(direct), "components")
    of = lambda node: comp.select(F.col("node").alias(node), F.col("comp").alias(f"{node}_comp"))
    apart = staged(lists.select("token", "sig", "hub").join(of("sig"), "sig", "left").join(of("hub"), "hub", "left")
                   .where("coalesce(sig_comp, sig) <> coalesce(hub_comp, hub)").select("token").distinct(), "mixed-lists")
    rows = (lists.join(apart, "token").join(of("sig"), "sig", "left").join(of("hub"), "hub", "left")
            .join(computed.select(F.col("a").alias("hub"), F.col("b").alias("sig"), "o"), ["hub", "sig"], "left")
            .withColumn("comp", F.coalesce("sig_comp", "sig"))
            .withColumn("o", F.when(F.col("sig") == F.col("hub"), F.col("n")).otherwise(F.coalesce("o", F.lit(-1))))
            .withColumn("probe", F.col("comp") != F.coalesce("hub_comp", "hub"))
            .withColumn("parts", F.expr(f"CAST(ceil(many / {LIST_PART}) AS INT)")).withColumn("own", F.expr("CAST(pmod(xxhash64(sig), parts) AS INT)")))
    rows = staged(rows, "mixed-rows")
    # Tiles of a list: members fill a column, probes (those apart from the hub's component) a row.
    every = F.explode(F.expr("sequence(0, parts - 1)"))
    cells = rows.withColumn("as_probe", F.lit(False)).withColumn("row", every).withColumn("col", F.col("own")).unionByName(
        rows.filter("probe").withColumn("as_probe", F.lit(True)).withColumn("row", F.col("own")).withColumn("col", every))
    found = staged(cells.select("token", "row", "col", "as_probe", "sig", "n", "pos", "comp", "probe", "o", "hub_n")
                   .repartition("token", "row", "col").sortWithinPartitions("token", "row", "col", "n", "pos")
                   .mapInArrow(_across, "a long, b long, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure")), "across")
    done = computed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _compared(found.where("NOT sure").join(done, ["a", "b"], "left_anti").select("a", "b"), classes).where(_LINKED)
    return direct.unionByName(found.where("sure").select("a", "b")).unionByName(more.select("a", "b"))


def _grouped(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Every row with its set, and the component of each set that may link."""
    sets = staged(shingle_sets(docs, doc_id, text), "sets")
    classes = staged(sets.where("tokens IS NOT NULL").groupBy("sig").agg(
        *[F.first(c).alias(c) for c in ("n_shingles", "tokens", "prefix", "alone", "central")],
        F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("stays")), "classes")
    comp = components(links(classes))
    return sets, staged(classes.select("sig", "least", "stays").join(comp.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig")), "named")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links, itself included) of every row."""
    sets, named = _grouped(docs, doc_id, text)
    least = staged(named.groupBy("comp").agg(F.min("least").alias("component_id")), "least")
    by_sig = staged(named.join(least, "comp").select("sig", "component_id"), "by-class")
    alone = sets.where("tokens IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return sets.where("tokens IS NOT NULL").select("doc_id", "n_shingles", "sig").join(by_sig, "sig").select("doc_id", "n_shingles", "component_id").unionByName(alone)


def _placed(docs: DataFrame, file: str, place: str) -> DataFrame:
    """``docs`` with the file and the place in it of each row; written first unless it is a plain scan of files."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or "_metadata" not in [x.name() for x in (plan.metadataOutput().apply(i) for i in range(plan.metadataOutput().size()))]:
        docs = staged(docs, "documents")
    return docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", flag_bytes: int = FLAG_BYTES) -> DataFrame:
    """``docs`` with one document of each component: that of the least ``doc_id`` (null last).

    Rows that repeat an id and its text count as one document; of those that
    differ in other columns the one with the least hash of all columns stays.
    The rows are chosen on ids and hashes and told by file and place in it.
    The scan drops the others by a bit a row, so no text is shuffled.  The bits
    are broadcast, ``flag_bytes`` at most: with more, files are taken in turns.
    """
    file, place = fresh("file", docs.columns), fresh("place", docs.columns)
    rows = _placed(docs, file, place)
    docs = rows.drop(file, place)
    sets, named = _grouped(docs, doc_id, text)
    stays = named.groupBy("comp").agg(F.min("stays").alias("s")).select("s.doc_id", "s.text_key")
    keep = staged(stays.unionByName(sets.where("tokens IS NULL").select("doc_id", "text_key")).distinct(), "kept")
    narrow = staged(rows.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("key"), F.xxhash64(*docs.columns).alias("tie"),
                                F.col(file).alias("file"), F.col(place).alias("place")), "places")
    same = narrow["id"].eqNullSafe(keep["doc_id"]) & (narrow["key"] == keep["text_key"])
    chosen = narrow.join(keep, same, "left_semi").groupBy("id", "key").agg(F.min(F.struct("tie", "file", "place")).alias("row")).select("row.file", "row.place", F.lit(1).cast("long").alias("bit"))
    bits = (narrow.select("file", "place", F.lit(0).cast("long").alias("bit")).unionByName(chosen)
            .groupBy("file", F.expr("place DIV 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(bit, CAST(place % 64 AS INT))")).alias("bits")))
    flags = staged(bits.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words")), "flags")
    total = flags.agg(F.sum(F.size("words"))).first()[0] or 0
    turns = max(1, -(-8 * total // flag_bytes))
    turn = lambda c: F.pmod(F.xxhash64(c), F.lit(turns))
    out = None
    for i in range(turns):
        part, known = (rows, flags) if turns == 1 else (rows.where(turn(file) == i), flags.where(turn("file") == i))
        known = known.select(F.col("file").alias(fresh("flag_file", rows.columns)), F.col("words").alias(fresh("words", rows.columns)))
        kept = part.join(F.broadcast(known), part[file] == known[known.columns[0]])
        kept = kept.where(F.expr(_BIT.format(words=known.columns[1], place=place))).select(*[part[c] for c in docs.columns])
        out = kept if out is None else out.unionByName(kept)
    return out
