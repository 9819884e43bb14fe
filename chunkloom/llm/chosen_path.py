"""Jaccard similarity join on word shingles by chosen paths.

Documents with the same set of five-word shingles count once: the join runs on these classes,
each a node with a number of its own. A node carries a MinHash sketch, so that a coordinate of
the sketch is a uniformly sampled token of its set: two sets share it with probability equal to
their similarity. A path of a run is a sequence of such sampled tokens. The first token puts
every set in a bucket; a bucket of more than LEAF sets is split again and again, each set following
two sampled tokens, so that a pair above the threshold keeps 2 x 0.8 > 1 common paths in the mean;
buckets that are small, or that splitting hardly divides (near copies of each other), are
compared by brute force on their exact sets, large ones in pairs of blocks over several tasks.
Runs are repeated until the target recall; of a bucket's pairs, those that share too few sampled
tokens for the threshold (``least_shared``, a tenth of the recall's allowance) are not compared.

A pair counts only in its first common bucket, which each side knows from its list of buckets,
so every link is counted once though no pair leaves a task: a bucket returns one row per set
with its number of links and one edge of a spanning forest.

Defined results: a null text, or one without words, has no shingles and no links and is a
class of its own; a text of fewer than five words has one shingle. Rows are told apart by their
content, not by doc_id: rows of one doc_id with different sets are different nodes, with the same
set copies of each other, and a null doc_id hinders no link. Numbers that are the smallest
doc_id of some rows leave nulls out, and are null if all are. ``keep_one`` keeps of each class the
row of smallest doc_id (nulls last, then by a hash of the text), once if it is repeated, and all
rows without shingles. An empty table gives an empty result. Only doc_id and text are read;
``keep_one`` passes all columns through; names that begin with ``__cl_`` are its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import Scratch, bit_of, bitmap_of, bits_set, has_bit, list_array, mix64, shingle_hashes, slices, table, word_bounds, word_hashes
from chunkloom.llm.components import connected_components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.99999
COORDINATES = 32
#: Sets in a bucket that one task compares; larger ones are split or compared in blocks.
LEAF = 1024

_SEEDS = (mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)).astype(np.uint32)


def runs_for(recall: float, threshold: float) -> int:
    """Runs after which a pair at the threshold shares a first bucket with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold))


def least_shared(recall: float, threshold: float) -> int:
    """Coordinates that all pairs at the threshold share, but for a tenth of those that ``recall`` allows to be lost."""
    below = 0.0
    for c in range(COORDINATES + 1):
        below += math.comb(COORDINATES, c) * threshold**c * (1 - threshold) ** (COORDINATES - c)
        if below > (1 - recall) / 10:
            return c
    return COORDINATES


def _shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = word_bounds(data, off)
    per_doc = np.bincount(np.searchsorted(off, starts, side="right") - 1, minlength=len(off) - 1) if len(starts) else np.zeros(len(off) - 1, np.int64)
    return shingle_hashes(word_hashes(data, starts, ends), per_doc, k)


def _set_names(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set of shingles, 0 for an empty one."""
    a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        at = (np.cumsum(n) - n)[full]
        a[full] = np.add.reduceat(h, at)
        b[full] = np.bitwise_xor.reduceat(mix64(h), at)
    return a.view(np.int64), b.view(np.int64)


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in slices(batch, "text"):
                h, n = _shingles(data, off, k)
                full = np.flatnonzero(n)
                at = (np.cumsum(n) - n)[full]
                sig = np.zeros((len(full), COORDINATES), np.int32)
                a, b = _set_names(h, n)
                if len(full):
                    short = (h >> np.uint64(32)).astype(np.uint32)
                    x, y = np.empty_like(short), np.empty_like(short)
                    for c in range(COORDINATES):
                        np.multiply(short, _SEEDS[c], out=x)
                        np.right_shift(x, np.uint32(15), out=y)
                        np.bitwise_xor(x, y, out=x)
                        sig[:, c] = np.minimum.reduceat(x, at).view(np.int32)
                per = np.where(n > 0, COORDINATES, 0)
                cols = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(a), pa.array(b), pa.array(n.astype(np.int64)), list_array(sig.reshape(-1), per, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "tkey", "set_a", "set_b", "n", "sig"])

    return run


def _pack(h: np.ndarray) -> np.ndarray:
    """Five bytes of each shingle hash."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].reshape(-1)


def _unpack(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = raw.reshape(-1, 5)
    return out.view("<u8").reshape(-1)


def _sets(k: int, bitmap: np.ndarray):
    """Shingle sets of the documents whose bit is set, once for equal ones of a slice; others may come too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bits_set(bitmap, batch.column(0).to_numpy())))
            for _, _, data, off in slices(batch, "text"):
                h, n = _shingles(data, off, k)
                a, b = _set_names(h, n)
                size = np.concatenate([[0], np.cumsum(n * 5)]).astype(np.int32)
                sets = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(size.tobytes()), pa.py_buffer(_pack(h).tobytes())])
                out = pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n.astype(np.int64)), sets], names=["set_a", "set_b", "n", "shingles"])
                yield out.take(pa.array(np.sort(np.unique(np.column_stack([a, b, n]), axis=0, return_index=True)[1])))

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys in sorted batches; a run may span batches."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        if not t.num_rows:
            continue
        cols = [t.column(k).to_numpy() for k in keys]
        new = np.zeros(t.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        at = np.concatenate([[0], np.flatnonzero(new)])
        for i, j in zip(at[:-1], at[1:], strict=True):
            yield tuple(int(c[i]) for c in cols), t.slice(i, j - i)
        rest = t.slice(at[-1])
    if rest is not None and rest.num_rows:
        yield tuple(int(rest.column(k)[0].as_py()) for k in keys), rest


def _flat(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, first of each row and end) of a list column."""
    c = t.column(name).combine_chunks()
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    off = c.offsets.to_numpy().astype(np.int64)
    return c.values.to_numpy(), off


def _to_compare(key: tuple, t: pa.Table, threshold: float, least: int) -> np.ndarray:
    """todo[i, j], i < j: pairs of this bucket that no earlier one holds and that may reach the threshold."""
    leaf, one, two = key
    m = t.num_rows
    n = t.column("n").to_numpy()
    todo = np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :]) - 1e-9
    todo &= np.arange(m)[:, None] < np.arange(m)[None, :]
    if one != two:
        side = t.column("block").to_numpy() == one
        todo &= side[:, None] != side[None, :]
    rep = t.column("rep").to_numpy()
    todo &= rep[:, None] != rep[None, :]
    values, off = _flat(t, "sig")
    sig = values[off[0] : off[-1]].reshape(m, COORDINATES)
    shared = np.zeros((m, m), np.int8)
    for c in range(COORDINATES):
        shared += sig[:, c][:, None] == sig[:, c][None, :]
    todo &= shared >= least
    values, off = _flat(t, "leaves")
    flat = values[off[0] : off[-1]]
    early = flat < leaf
    if early.any():
        names, col = np.unique(flat[early], return_inverse=True)
        member = np.zeros((m, len(names)), np.float32)
        member[np.repeat(np.arange(m), np.diff(off))[early], col] = 1
        todo &= (member @ member.T) == 0
    return todo


_KEYS = ["leaf", "one", "two"]


def _live(threshold: float, least: int):
    """The sets of each bucket that take part in a comparison there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(cols, (np.int64, np.int32, np.int32, np.int64, np.int32), strict=True)], names=[*_KEYS, "rep", "block"])

        for key, t in _groups(batches, _KEYS):
            todo = _to_compare(key, t, threshold, least)
            at = np.flatnonzero(todo.any(0) | todo.any(1))
            if len(at):
                out.append([*(np.full(len(at), k) for k in key), t.column("rep").to_numpy()[at], t.column("block").to_numpy()[at]])
            if len(out) > 5000:
                yield rows()
        if out:
            yield rows()

    return run


def _components_of(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index in each node's component."""
    lab = np.arange(n)
    while True:
        was = lab.copy()
        np.minimum.at(lab, u, lab[v])
        np.minimum.at(lab, v, lab[u])
        lab = lab[lab]
        if (lab == was).all():
            return lab


def _links(todo: np.ndarray, t: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of ``todo`` whose sets reach the threshold, by exact intersections."""
    n = t.column("n").to_numpy()
    m = t.num_rows
    raw = [np.frombuffer(x.as_buffer(), np.uint8) for x in t.column("shingles").combine_chunks()]
    sets = [_unpack(x) for x in raw]
    if todo.sum() <= 4 * m:
        u, v = np.nonzero(todo)
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(u, v, strict=True)])
        ok = common >= threshold * (n[u] + n[v] - common) - 1e-9
        return u[ok], v[ok]
    row = np.repeat(np.arange(m), [len(x) for x in sets])
    token, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[col] > 1
    row, col = row[shared], (np.cumsum(times > 1) - 1)[col[shared]]
    width = int((times > 1).sum())
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    common = np.zeros((m, m), np.float32)
    step = max(1024, (1 << 22) // m)
    for a in range(0, width, step):
        lo, hi = np.searchsorted(col, [a, a + step])
        part = np.zeros((m, min(step, width - a)), np.float32)
        part[row[lo:hi], col[lo:hi] - a] = 1
        common += part @ part.T
    u, v = np.nonzero(todo & (common >= threshold * (n[:, None] + n[None, :] - common) - 1e-9))
    return u, v


def _compare(threshold: float, least: int):
    """One row for each linked set of a bucket: rep, its links there, the smallest set of its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t in _groups(batches, _KEYS):
            rep = t.column("rep").to_numpy()
            t = t.take(pa.array(np.unique(rep, return_index=True)[1]))  # a set may come from several slices
            rep, w = t.column("rep").to_numpy(), t.column("w").to_numpy()
            u, v = _links(_to_compare(key, t, threshold, least), t, threshold)
            if not len(u):
                continue
            links = np.zeros(len(rep), np.int64)
            np.add.at(links, u, w[v])
            np.add.at(links, v, w[u])
            lab = _components_of(len(rep), u, v)  # rows are sorted by rep
            hit = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (rep, links, rep[lab])], names=["rep", "links", "low"])

    return run


def _hash(*cols):
    return F.xxhash64(*cols)


def _leaves(classes: DataFrame, runs: int, scratch: Scratch) -> DataFrame:
    """(leaf, rep, size) of every set in a bucket with a partner."""
    small = classes.select("rep", "sig")
    level = small.select("rep", F.posexplode(F.slice("sig", 1, runs)).alias("run", "token"))
    level = scratch.keep(level.select("rep", _hash("run", "token").alias("path"), F.lit(0).cast("long").alias("was")))
    done, kept = [], [level]
    depth = 0
    while True:
        size = scratch.keep(level.groupBy("path").agg(F.count("*").alias("size"), F.max("was").alias("was")).filter("size > 1"))
        kept.append(size)
        # A split that leaves most sets together finds near copies; more splits would not part them.
        stop = (F.col("size") <= LEAF) | (F.col("was") * 0.6 < F.col("size")) if depth else F.col("size") <= LEAF
        marked = size.withColumn("leaf", stop).select("path", "size", "leaf")
        rows = level.select("rep", "path").join(marked, "path")
        done.append(rows.filter("leaf").select(F.col("path").alias("leaf"), "rep", "size"))
        if not marked.filter("not leaf").limit(1).count():
            break
        depth += 1
        wide = rows.filter("not leaf").join(small, "rep")
        at = [F.pmod(_hash("path", F.lit(b)), F.lit(COORDINATES)).cast("int") for b in (0, 1)]
        steps = F.array(*[_hash("path", F.lit(b), F.get("sig", a)) for b, a in enumerate(at)])
        level = scratch.keep(wide.select("rep", F.explode(steps).alias("path"), F.col("size").alias("was")))
        kept.append(level)
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    out = scratch.keep(out.dropDuplicates(["leaf", "rep"]))
    scratch.drop(*kept)
    return out


_SET = ["set_a", "set_b", "n"]


def _linked(documents: DataFrame, threshold: float, recall: float, k: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tkey, set_a, set_b, n) of every row, and (set_a, set_b, n, node, first, w, links, component) of every class."""
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), "text")
    d = scratch.keep(d.mapInArrow(_sketch(k), "doc_id long, tkey long, set_a long, set_b long, n long, sig array<int>"))
    full = d.filter("n > 0")
    ids = full.groupBy(*_SET).agg(F.min("doc_id").alias("first"), F.count("*").alias("w"), F.any_value("sig").alias("sig"))
    # Numbers from 0, given once and read back from the written table.
    ids = scratch.keep(ids.withColumn("node", F.monotonically_increasing_id()))
    classes = ids.select(F.col("node").alias("rep"), "w", "n", "sig")
    leaves = _leaves(classes, runs_for(recall, threshold), scratch)
    lists = leaves.groupBy("rep").agg(F.collect_set("leaf").alias("leaves"))
    lists = scratch.keep(lists.join(classes, "rep"))
    # Blocks of a large bucket: each set goes to the pairs of blocks that its own is in.
    blocks = F.when(F.col("size") <= LEAF, F.lit(1)).otherwise(F.ceil(F.col("size") / (LEAF // 2)).cast("int"))
    b = leaves.withColumn("blocks", blocks).withColumn("block", F.pmod(_hash("rep"), F.col("blocks")).cast("int"))
    b = b.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    b = b.select("leaf", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "rep", "block")
    dealt = lambda d: d.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "rep")
    least = least_shared(recall, threshold)
    live = dealt(b.join(lists.select("rep", "n", "sig", "leaves"), "rep")).mapInArrow(_live(threshold, least), "leaf long, one int, two int, rep long, block int")
    live = scratch.keep(live)
    named = ids.select("set_a", "set_b", "n", F.col("node").alias("rep"), "first").join(live.select("rep").distinct(), "rep", "left_semi")
    named = scratch.keep(named)
    texts = documents.select(bit_of(F.col("doc_id").cast("long")).alias("bit"), "text")
    sets = texts.mapInArrow(_sets(k, bitmap_of(named, "first")), "set_a long, set_b long, n long, shingles binary")
    heavy = sets.join(named.drop("first"), _SET).select("rep", "shingles")
    heavy = lists.select("rep", "w", "n", "sig", "leaves").join(heavy, "rep")
    found = scratch.keep(dealt(live.join(heavy, "rep")).mapInArrow(_compare(threshold, least), "rep long, links long, low long"))
    cc = connected_components(found.select(F.col("rep").alias("u"), F.col("low").alias("v")), scratch)
    links = found.groupBy(F.col("rep").alias("node")).agg(F.sum("links").alias("links"))
    per = ids.drop("sig").join(links, "node", "left").join(cc, "node", "left")
    per = per.withColumns({"links": F.coalesce("links", F.lit(0)), "component": F.coalesce("component", "node")})
    per = scratch.keep(per)
    scratch.drop(ids, leaves, lists, live, named, found)
    return d.drop("sig"), per


def similarity_join(documents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, k: int = WORDS) -> DataFrame:
    """doc_id, class_id, n_links, kept, set_id for every document.

    class_id is the smallest doc_id reachable by links, its own included; n_links the number of
    other rows at ``threshold`` or above (copies included); kept tells whether the row's doc_id is
    the smallest of its class (true for all of a class without doc_ids); set_id is the smallest
    doc_id with the same shingle set.
    """
    d, per = _linked(documents, threshold, recall, k, Scratch(documents.sparkSession))
    low = per.groupBy("component").agg(F.min("first").alias("low"))
    per = per.join(low, "component").select(*_SET, "first", "w", "links", "low", F.lit(True).alias("has"))
    out = d.join(per, _SET, "left")
    class_id = F.when(F.col("has"), F.col("low")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        class_id.alias("class_id"),
        F.coalesce(F.col("w") - 1 + F.col("links"), F.lit(0)).alias("n_links"),
        F.col("doc_id").eqNullSafe(class_id).alias("kept"),
        F.when(F.col("has"), F.col("first")).otherwise(F.col("doc_id")).alias("set_id"),
    )


def keep_one(documents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, k: int = WORDS) -> DataFrame:
    """One row of each class, and all rows without shingles, with all columns.

    Texts are shuffled only for rows that may go: the others pass by a bitmap.
    """
    scratch = Scratch(documents.sparkSession)
    d, per = _linked(documents, threshold, recall, k, scratch)
    # Classes of more than one row, and in each the row that stays.
    size = per.groupBy("component").agg(F.sum("w").alias("rows")).filter("rows > 1")
    many = per.select(*_SET, "component").join(size.select("component"), "component")
    rows = scratch.keep(d.join(many, _SET).select("doc_id", "tkey", "component"))
    stays = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tkey")).alias("stays")
    # A large class is met by several copies of its line, each by a share of its rows.
    parts = F.ceil(F.count("*") / LEAF).cast("int").alias("parts")
    stays = rows.groupBy("component").agg(stays, parts).select("component", "stays", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    most = stays.agg(F.coalesce(F.max("part"), F.lit(0)) + 1).first()[0]
    rows = rows.join(stays.groupBy("component").agg(F.max("part").alias("last")).filter("last > 0"), "component", "left") if most > 1 else rows.withColumn("last", F.lit(0))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "tkey"), F.coalesce("last", F.lit(0)) + 1).cast("int")).drop("last")
    rows = rows.join(stays, ["component", "part"])
    first = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("tkey") == F.col("stays.tkey"))
    n = rows.groupBy(F.col("doc_id").alias("__cl_doc"), F.col("tkey").alias("__cl_tkey")).agg(F.max(first).alias("__cl_first"), F.count("*").alias("__cl_n"))
    n = scratch.keep(n.filter("not __cl_first or __cl_n > 1"))
    at = documents.withColumn("__cl_key", F.xxhash64("text"))
    hit = has_bit(bitmap_of(n, "__cl_doc", "__cl_tkey"))(bit_of(F.col("doc_id").cast("long"), F.col("__cl_key")))
    some = at.filter(hit).join(n, F.col("doc_id").cast("long").eqNullSafe(F.col("__cl_doc")) & (F.col("__cl_key") == F.col("__cl_tkey")), "left")
    some = some.filter("__cl_first is null or __cl_first")
    out = at.filter(~hit).select(documents.columns).union(some.filter("__cl_first is null").select(documents.columns))
    if n.filter("__cl_first").limit(1).count():  # repeated rows
        out = out.union(some.filter("__cl_first").dropDuplicates(["__cl_doc", "__cl_tkey"]).select(documents.columns))
    return out


def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(table(spark, sf_dir, "documents"))


QUERIES = {"op7_chosen_path": op7_chosen_path}
