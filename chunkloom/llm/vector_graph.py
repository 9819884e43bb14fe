"""Embedding near-dedup over a robust-pruned flat graph built on overlapping cluster shards.

1. Vectors are scaled to length 1; exact copies within a label are one point with a weight.
2. Centres are fitted for each label on a bounded sample; each point goes to its CLOSEST nearest
   centres and to those within MARGIN of the best, so shards overlap. A shard above SHARD points is
   split again by centres of its own; one that splitting hardly divides, a group of near copies, is
   dealt into blocks, and every pair of blocks is a shard, so that the group is shared out and no
   pair is lost.
3. In each shard every point's nearest points are pruned robustly (a candidate goes if one kept
   before is nearer to it by the factor ALPHA) to at most DEGREE; both ends list an edge.
4. The lists of all shards are united for each point.
5. In each shard all its points are queries: a greedy search over the united lists starts at the
   medoids of the shard's parts and keeps a beam; as soon as it meets points within the range it expands
   through all of them. Cosines are taken only of points that a search meets. What is found is
   verified by cosine in double precision.
6. A pair found in several shards counts once: in the first common one. A shard returns one row
   per point, with its number of links and one edge of a spanning forest, and never pairs.

``audit`` measures recall on a stated set of queries against brute force over all rows in blocks.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing, nor do those with a null label; vectors of different lengths link with nothing of
another length. Rows are told apart by label and vector, not by vec_id: repeated rows are copies
and link with each other, rows of one vec_id with different vectors are different points, and a null
vec_id hinders no link; component_id is the smallest vec_id that is not null, or null if none is,
and kept compares null-safely. An empty table gives an empty result. Only vec_id, embedding and
label are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import Scratch, table
from chunkloom.llm.components import connected_components

COSINE = 0.98
#: Vectors and bytes of vectors that fitting the centres reads at most, and centres of each label at most.
SAMPLE = 40_000
SAMPLE_BYTES = 48 << 20
MAX_CENTRES = 512
CLOSEST = 2
#: Splitting of large cells: levels, sample and centres of each, points that a task deals out at once, the share that tells near copies.
MAX_LEVELS = 4
SPLIT_SAMPLE = 2048
SPLIT_CENTRES = 256
PIECE = 20_000
SHRINK = 0.6
#: A point also goes to every centre whose cosine is less than its best by no more than this.
MARGIN = 0.06
SHARD = 1024
DEGREE = 24
CANDIDATES = 48
ALPHA = 1.2
BEAM = 16
#: Starts of a search besides the medoids.
SPREAD = 64
#: The search expands points of a cosine this much below the range too, as paths between neighbours pass there.
SLACK = 0.05


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centres(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k centres of unit vectors by spherical k-means."""
    if k <= 1 or len(x) <= k:
        return _unit(x.mean(0, keepdims=True) + 1e-9) if k <= 1 else x
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        s = np.zeros_like(c)
        np.add.at(s, at, x)
        empty = np.linalg.norm(s, axis=1) < 1e-9
        s[empty] = x[r.choice(len(x), int(empty.sum()))]
        c = _unit(s)
    return c


def _closest(sim: np.ndarray, closest: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, centre) for the closest centres and those within the margin of the best."""
    best = np.partition(sim, -min(closest, sim.shape[1]), axis=1)[:, -min(closest, sim.shape[1]) :]
    return np.nonzero(sim >= np.minimum(best.min(1), best.max(1) - MARGIN)[:, None])


def _split_centres(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Centres of one cell from its sample."""
    x = np.stack(pdf.sort_values("point", kind="stable")["unit"].to_list())
    k = min(SPLIT_CENTRES, -(-int(pdf["size"].iloc[0]) // (SHARD // 4)), max(1, len(x) // 2))
    return pd.DataFrame({"cell": [key[0]], "centres": [fit_centres(x, k).reshape(-1).tolist()]})


def _split_assign(key: tuple, points: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
    """The parts of a cell that a piece of its points goes to."""
    if not len(points):
        return pd.DataFrame({"point": [], "parent": [], "part": [], "was": []})
    x = np.stack(points["unit"].to_list())
    c = np.asarray(centres["centres"].iloc[0]).reshape(-1, x.shape[1]) if len(centres) else x[:0]
    who, part = _closest(x @ c.T, CLOSEST) if len(c) else (np.arange(len(x)), np.zeros(len(x), np.int64))
    return pd.DataFrame({"point": points["point"].to_numpy()[who], "parent": key[0], "part": part, "was": points["size"].to_numpy()[who]})


def _refine(cells: DataFrame, points: DataFrame, scratch: Scratch) -> DataFrame:
    """(point, cell), with cells above SHARD split by centres of their own, level by level.

    A cell of which a split leaves more than SHRINK together is a group of near copies, and stays.
    """
    level = cells.select("point", "cell", F.lit(None).cast("long").alias("was"))
    done = None
    for depth in range(MAX_LEVELS):
        size = level.groupBy("cell").agg(F.count("*").alias("size"), F.max("was").alias("was"))
        big = scratch.keep(size.filter((F.col("size") > SHARD) & (F.col("was").isNull() | (F.col("size") < F.col("was") * SHRINK))).select("cell", "size"))
        if not big.limit(1).count():
            break
        rest = level.join(big, "cell", "left_anti").select("point", "cell")
        done = rest if done is None else done.union(rest)
        rows = scratch.keep(level.select("point", "cell").join(big, "cell").join(points.select("point", "unit"), "point"))
        picked = rows.filter(F.pmod(F.xxhash64("point", F.lit(depth)), F.lit(1_000_000)) < F.lit(SPLIT_SAMPLE * 1_000_000) / F.col("size"))
        centres = picked.groupBy("cell").applyInPandas(_split_centres, "cell long, centres array<double>")
        pieces = F.ceil(F.col("size") / PIECE).cast("int")
        c = centres.join(big, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), pieces - 1))).select("cell", "salt", "centres")
        r = rows.withColumn("salt", F.pmod(F.xxhash64("point"), pieces).cast("int"))
        out = r.groupBy("cell", "salt").cogroup(c.groupBy("cell", "salt")).applyInPandas(_split_assign, "point long, parent long, part int, was long")
        level = scratch.keep(out.select("point", F.xxhash64("parent", "part").alias("cell"), "was"))
    level = level.select("point", "cell")
    return level if done is None else done.union(level)


def _assign(centres: dict[tuple[int, int], np.ndarray], closest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            vecs = [np.asarray(v, np.float64) for v in batch.column(2).to_numpy(zero_copy_only=False)]
            dim = np.array([len(v) for v in vecs])
            rows, cell = [], []
            for key in sorted({*zip(label.tolist(), dim.tolist(), strict=True)}):
                at = np.flatnonzero((label == key[0]) & (dim == key[1]))
                c = centres.get(key)
                if c is None:  # a kind that the sample didn't hold
                    rows.append(at)
                    cell.append(np.zeros(len(at), np.int64))
                    continue
                sim = np.stack([vecs[i] for i in at]) @ c.T
                who, near = _closest(sim, closest)
                rows.append(at[who])
                cell.append(near)
            at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            cells = np.concatenate(cell) if cell else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(label[at].astype(np.int64)), pa.array(dim[at].astype(np.int32)), pa.array(cells.astype(np.int32))], names=["point", "label", "dim", "cell"])

    return run


def robust_prune(sim: np.ndarray, top: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """kept[i, r]: of point i's candidates top[i], by falling similarity, those that no kept one is nearer to by ``alpha`` (on distances)."""
    n, most = top.shape
    far = 1 - np.take_along_axis(sim, top, 1)
    kept = np.zeros((n, most), bool)
    count = np.zeros(n, np.int64)
    for r in range(most):
        covered = kept[:, :r] & (alpha * (1 - sim[top[:, r][:, None], top[:, :r]]) <= far[:, r : r + 1])
        kept[:, r] = ~covered.any(1) & (count < degree)
        count += kept[:, r]
    return kept


def _build(degree: int, candidates: int, alpha: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point", kind="stable")
        point = pdf["point"].to_numpy()
        x = np.stack(pdf["unit"].to_list()).astype(np.float32)
        sim = x @ x.T
        np.fill_diagonal(sim, -2)
        m = min(candidates, len(point) - 1)
        if m <= 0:
            return pd.DataFrame({"point": point, "near": [[]] * len(point)})
        top = np.argpartition(-sim, m - 1, axis=1)[:, :m]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(sim, top, 1), axis=1, kind="stable"), 1)
        kept = robust_prune(sim, top, degree, alpha)
        u, v = np.nonzero(kept)[0], top[kept]
        # Both ends know an edge, so that every point can be reached.
        pair = np.unique(np.concatenate([u * len(point) + v, v * len(point) + u]))
        cut = np.searchsorted(pair // len(point), np.arange(len(point) + 1))
        ends = point[pair % len(point)]
        return pd.DataFrame({"point": point, "near": [ends[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]})

    return run


def search_ranges(x: np.ndarray, lists: list[np.ndarray], least: float, beam: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (u, v), u < v, of cosine ``least`` or above that the search of u or that of v met.

    All points are queries at once, as rows of matrices. Each query opens its best unopened point
    until that is worse than the ``beam`` best it has met; then it opens every point in range, or
    a little beyond, that it has met, until it meets no more. ``sim`` holds the cosines of met
    points alone; -2 stands for the others.
    """
    n = len(x)
    degree = np.array([len(a) for a in lists])
    near = np.full((n, max(1, degree.max(initial=0))), n, np.int64)  # n: no neighbour
    near[np.arange(near.shape[1])[None, :] < degree[:, None]] = np.concatenate(lists).astype(np.int64)
    sim = np.full((n, n + 1), -2, x.dtype)
    opened = np.zeros((n, n + 1), bool)
    opened[:, n] = True
    sim[:, starts] = x @ x[starts].T

    def meet(q: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take the cosines of the points' neighbours that their queries have not met."""
        v = near[points]
        q = np.broadcast_to(q[:, None], v.shape)
        new = (v < n) & (sim[q, v] == -2)
        q, v = q[new], v[new]
        for k in range(0, len(q), 1 << 16):
            a, b = q[k : k + (1 << 16)], v[k : k + (1 << 16)]
            sim[a, b] = np.einsum("ij,ij->i", x[a], x[b])
        return q, v

    bound = np.full(n, -2, x.dtype)
    live, step = np.arange(n), 0
    while len(live):
        s = sim[live]
        if step % 4 == 0 and beam < n:
            bound[live] = np.partition(s, n + 1 - beam, axis=1)[:, n + 1 - beam]
        todo = np.where(opened[live], -2, s)
        pick = todo.argmax(1)
        best = todo[np.arange(len(live)), pick]
        go = (best > -2) & (best >= bound[live])
        live, pick = live[go], pick[go]
        opened[live, pick] = True
        meet(live, pick)
        step += 1
    reach = least - SLACK
    q, v = np.nonzero((sim >= reach) & ~opened)
    while len(q):
        opened[q, v] = True
        news = [meet(q[k : k + 4096], v[k : k + 4096]) for k in range(0, len(q), 4096)]
        q, v = (np.concatenate(c) for c in zip(*news, strict=True))
        new = np.unique((q * (n + 1) + v)[sim[q, v] >= reach])
        q, v = new // (n + 1), new % (n + 1)
        shut = ~opened[q, v]
        q, v = q[shut], v[shut]
    found = sim[:, :n] >= least
    return np.nonzero(np.triu(found | found.T, 1))


def _lowest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest number in each node's component."""
    lab = np.arange(n)
    while True:
        was = lab.copy()
        np.minimum.at(lab, u, lab[v])
        np.minimum.at(lab, v, lab[u])
        lab = lab[lab]
        if (lab == was).all():
            return lab


def medoids(x: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """The medoid of each connected part of the graph, so that no pocket is out of reach, and evenly spread points."""
    n = len(x)
    lab = _lowest(n, np.repeat(np.arange(n), [len(a) for a in lists]), np.concatenate(lists).astype(np.int64))
    _, part = np.unique(lab, return_inverse=True)
    middle = np.zeros((part.max() + 1, x.shape[1]))
    np.add.at(middle, part, x)
    near = np.einsum("ij,ij->i", x, middle[part])
    order = np.lexsort((-near, part))
    first = order[np.concatenate([[True], part[order][1:] != part[order][:-1]])]
    return np.unique(np.concatenate([first, np.arange(0, n, max(1, n // SPREAD))]))


def _search(least: float, beam: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        pdf = pdf.sort_values("point", kind="stable")
        point, w = pdf["point"].to_numpy(), pdf["w"].to_numpy()
        n = len(point)
        x = np.stack(pdf["unit"].to_list()).astype(np.float64)
        lists = []
        for a in pdf["near"]:
            a = np.asarray(a, np.int64)
            at = np.searchsorted(point, a)
            at[at == n] = 0
            lists.append(np.unique(at[point[at] == a]))
        starts = medoids(x, lists)
        u, v = search_ranges(x.astype(np.float32), lists, least - 1e-4, beam, starts)
        exact = np.empty(len(u))
        for k in range(0, len(u), 1 << 18):
            exact[k : k + (1 << 18)] = np.einsum("ij,ij->i", x[u[k : k + (1 << 18)]], x[v[k : k + (1 << 18)]])
        u, v = u[exact >= least], v[exact >= least]
        # Count a pair in its first common shard only.
        mine = [set(s) for s in pdf["shards"]]
        lists = [np.asarray(sorted(s)) for s in mine]
        flat = np.concatenate(lists)
        owner = np.repeat(np.arange(n), [len(s) for s in lists])
        early = flat < shard
        if early.any() and len(u):
            names, col = np.unique(flat[early], return_inverse=True)
            member = np.zeros((n, len(names)), np.float32)
            member[owner[early], col] = 1
            first = (member @ member.T)[u, v] == 0
        else:
            first = np.ones(len(u), bool)
        links = np.zeros(n, np.int64)
        np.add.at(links, u[first], w[v[first]])
        np.add.at(links, v[first], w[u[first]])
        lab = _lowest(n, u, v)
        hit = np.zeros(n, bool)
        hit[u] = hit[v] = True
        return pd.DataFrame({"point": point[hit], "links": links[hit], "low": point[lab[hit]]})

    return run


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of length 1 in double precision; null for those that link with nothing."""
    for batch in batches:
        label, col = batch.column(1), batch.column(2)
        n = batch.num_rows
        none = np.asarray(col.is_null()) | np.asarray(label.is_null())
        size = np.where(none, 0, np.asarray(col.value_lengths().fill_null(0)))
        flat = np.asarray(col.filter(pa.array(~none)).flatten().to_numpy(zero_copy_only=False), np.float64)  # null components are NaN
        owner = np.repeat(np.arange(n), size)
        ok = ~none & (size > 0)
        ok[owner[~np.isfinite(flat)]] = False
        top = np.zeros(n)
        np.maximum.at(top, owner, np.where(np.isfinite(flat), np.abs(flat), 0))
        ok &= top > 0
        scaled = np.where(ok[owner], flat, 0) / np.where(top > 0, top, 1)[owner]  # so that squares neither overflow nor vanish
        norm = np.sqrt(np.bincount(owner, weights=scaled * scaled, minlength=n))
        unit = scaled / np.where(norm > 0, norm, 1)[owner]
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(ok, size, 0))]).astype(np.int32), mask=np.append(~ok, False))
        yield pa.RecordBatch.from_arrays([batch.column(0), label, pa.ListArray.from_arrays(offsets, pa.array(unit[ok[owner]]))], names=["vec_id", "label", "unit"])


def _points(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, unit (double, null if the vector links with nothing)."""
    e = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    return e.mapInArrow(_units, "vec_id long, label long, unit array<double>")


def near_duplicates(embeddings: DataFrame, least: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark)
    rows = scratch.keep(_points(embeddings).withColumn("key", F.md5(F.concat_ws(",", F.col("label").cast("string"), F.col("unit").cast("array<string>")))))
    points = rows.filter("unit is not null").groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("w"), F.first("label").alias("label"), F.first("unit").alias("unit"))
    # Numbers of their own, given once and read back from the written table.
    points = scratch.keep(points.withColumn("point", F.monotonically_increasing_id()))
    sizes = {(r["label"], r["dim"]): r["count"] for r in points.groupBy("label", F.size("unit").alias("dim")).count().orderBy(F.desc("count"), "label", "dim").limit(MAX_CENTRES).collect()}
    longest = points.agg(F.max(F.size("unit"))).first()[0]
    centres = {}
    if longest:
        most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * longest)))
        sample = points.select("label", "unit", F.xxhash64("key").alias("h")).orderBy("h", "key").limit(most).select("label", "unit").toArrow().combine_chunks()
        label, dim = sample["label"].to_numpy(), sample["unit"].combine_chunks().value_lengths().to_numpy()
        for kind in sorted({*zip(label.tolist(), dim.tolist(), strict=True)}):
            part = sample["unit"].filter(pa.array((label == kind[0]) & (dim == kind[1]))).combine_chunks()
            x = part.flatten().to_numpy().reshape(-1, kind[1]).astype(np.float32)
            k = min(MAX_CENTRES, -(-sizes.get(kind, 1) // (SHARD // 4)), max(1, len(x) // 4))
            centres[kind] = fit_centres(x, int(k))
        del sample
    cells = points.select("point", "label", "unit").mapInArrow(_assign(centres, CLOSEST), "point long, label long, dim int, cell int")
    cells = scratch.keep(cells.select("point", F.xxhash64("label", "dim", "cell").alias("cell")))
    cells = scratch.keep(_refine(cells, points, scratch))
    counts = cells.groupBy("cell").agg(F.count("*").alias("size"))
    # What is still large becomes all pairs of its blocks.
    blocks = F.when(F.col("size") <= SHARD, F.lit(1)).otherwise(F.ceil(F.col("size") / (SHARD / 2)).cast("int"))
    b = cells.join(counts, "cell").withColumn("blocks", blocks)
    b = b.withColumn("block", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int"))
    b = b.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter((F.col("blocks") == 1) | (F.col("block") != F.col("other")))
    shard = F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other"))
    member = scratch.keep(b.select("point", shard.alias("shard")).distinct())
    body = points.select("point", "w", "unit")
    near = member.join(body.select("point", "unit"), "point").groupBy("shard").applyInPandas(_build(DEGREE, CANDIDATES, ALPHA), "point long, near array<bigint>")
    near = near.groupBy("point").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    lists = member.groupBy("point").agg(F.collect_set("shard").alias("shards"))
    full = scratch.keep(body.join(near, "point").join(lists, "point"))
    found = member.join(full, "point").groupBy("shard").applyInPandas(_search(least, BEAM), "point long, links long, low long")
    found = scratch.keep(found)
    cc = connected_components(found.select(F.col("point").alias("u"), F.col("low").alias("v")), scratch)
    per = points.select("key", "first", "point", "w").join(found.groupBy("point").agg(F.sum("links").alias("links")), "point", "left").join(cc, F.col("point") == F.col("node"), "left")
    per = scratch.keep(per.select("key", "first", "w", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "point").alias("component")))
    low = per.groupBy("component").agg(F.min("first").alias("low"))
    per = per.join(low, "component").select("key", "w", "links", "low", F.lit(True).alias("has"))
    ok = F.col("unit").isNotNull()
    out = rows.select("vec_id", F.when(ok, F.col("key")).alias("key")).join(per, "key", "left")
    comp = F.when(F.col("has"), F.col("low")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce(F.col("w") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.col("vec_id").eqNullSafe(comp).alias("kept"))


def audit(embeddings: DataFrame, result: DataFrame, least: float = COSINE, every: int = 20) -> DataFrame:
    """links, found and recall over the queries whose vec_id ``every`` divides, by brute force over all rows in blocks."""
    rows = _points(embeddings).filter("unit is not null")
    scratch = Scratch(embeddings.sparkSession)
    q = scratch.keep(rows.filter(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(16))))
    base = rows.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(16)))
    both = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("q", F.lit(True)).select("block", "part", "vec_id", "label", "unit", "q")
    base = base.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(15)))).select("block", "part", "vec_id", "label", "unit", F.lit(False).alias("q"))

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dim = pdf["unit"].map(len)
        out = []
        for _, g in pdf.groupby(dim):
            a, b = g[g["q"]], g[~g["q"]]
            if len(a) and len(b):
                sim = np.stack(a["unit"].to_list()) @ np.stack(b["unit"].to_list()).T
                hit = (sim >= least) & (a["label"].to_numpy()[:, None] == b["label"].to_numpy()[None, :])
                out.append(pd.DataFrame({"vec_id": a["vec_id"].to_numpy(), "links": hit.sum(1)}))
        return pd.concat(out) if out else pd.DataFrame({"vec_id": [], "links": []})

    true = both.union(base).groupBy("block", "part").applyInPandas(count, "vec_id long, links long").groupBy("vec_id").agg(F.sum("links").alias("links"))
    own = q.groupBy("vec_id").agg(F.count("*").alias("own"))  # each row meets itself once
    got = result.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))
    j = true.join(own, "vec_id").join(got, "vec_id").agg(F.coalesce(F.sum(F.col("links") - F.col("own")), F.lit(0)).alias("links"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("found"))
    return j.withColumn("recall", F.when(F.col("links") > 0, F.col("found") / F.col("links")).otherwise(1.0))


def op1_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_vector_graph": op1_vector_graph}
