"""Quality scores by Bradley-Terry pairwise ranking.

Each document gets some sixty features of its whole text (shares of byte classes, repetition
of words, lines and shingles, lengths). The model is a linear score; for a preference pair
(better, worse) the probability that the better one wins is the logistic function of the score
difference, and the weights minimise that loss on feature differences. The cut is a quantile of
the scores of all labelled documents that are not held out, at the share of worse labels among
them; the returned score is 0.5 there.

The weights are learnt from at most MAX_TRAIN documents of each label, those of smallest hash of
doc_id; the cut is taken from all. Neither uses held-out ones: crc32(doc_id as text) mod 3 = 1.

Defined results: null and empty texts have all-zero counts and a score like any other text;
repeated rows get equal scores; null labels are ignored, and a doc_id with both labels has none;
without labels of both kinds all scores are 0.5; an empty table gives an empty result. Only doc_id
and text, doc_id and quality are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import Scratch, shingle_hashes, slices, table, word_bounds, word_hashes

#: Labelled documents of each label that training reads at most, and preference pairs drawn from them.
MAX_TRAIN = 4000
PAIRS = 40_000
#: Parts that a range of scores is counted in to find a quantile.
BINS = 4096


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def trainable(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of all labelled documents that are not held out; a doc_id with both labels has none."""
    y = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    return y.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("__cl_other")).filter("y = __cl_other").select("doc_id", "y")


def training_rows(documents: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled documents of each label that are not held out.

    A repeated doc_id enters once, with its smallest text.
    """
    y = trainable(labels, label)
    some = [y.filter(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for v in (0, 1)]
    rows = documents.select("doc_id", "text").join(F.broadcast(some[0].union(some[1])), "doc_id")  # bounded by 2 * most rows
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


_PUNCT = np.array([b for b in range(33, 127) if not chr(b).isalnum()])


def _distinct_share(values: np.ndarray, owner: np.ndarray, n_docs: int, total: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.ones(n_docs)
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.where(total > 0, np.bincount(o[new], minlength=n_docs) / np.maximum(total, 1), 1.0)


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of features per document data[off[i]:off[i+1]]."""
    n = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    count = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    share = count / np.maximum(size, 1)[:, None]
    starts, ends = word_bounds(data, off)
    owner = np.searchsorted(off, starts, side="right") - 1
    words = np.bincount(owner, minlength=n)
    h = word_hashes(data, starts, ends)
    length = (ends - starts).astype(float)
    mean = np.bincount(owner, weights=length, minlength=n) / np.maximum(words, 1)
    dev = np.sqrt(np.maximum(np.bincount(owner, weights=length**2, minlength=n) / np.maximum(words, 1) - mean**2, 0))
    again = np.zeros((2, n))
    for k in (1, 2):
        same = (h[k:] == h[:-k]) & (owner[k:] == owner[:-k])
        again[k - 1] = np.bincount(owner[k:][same], minlength=n) / np.maximum(words, 1)
    capital = np.bincount(owner, weights=((data[starts] >= 65) & (data[starts] <= 90)).astype(float) if len(starts) else None, minlength=n) / np.maximum(words, 1)
    shingles, per = shingle_hashes(h, words, 5)
    possible = np.maximum(words - 4, 0)
    dup5 = np.where(possible > 0, 1 - per / np.maximum(possible, 1), 0)
    # Lines: a break ends one, and so does a document's end.
    brk = np.flatnonzero(data == 10)
    line_at = np.unique(np.concatenate([off[:-1][size > 0], brk + 1]))
    line_at = line_at[line_at < len(data)]
    line_doc = np.searchsorted(off, line_at, side="right") - 1
    line_end = np.append(line_at[1:], len(data))
    lines = np.bincount(line_doc, minlength=n)
    lh = word_hashes(data, line_at, line_end)
    f = [
        np.log1p(words),
        np.log1p(size),
        np.log1p(lines),
        np.log1p(size / np.maximum(lines, 1)),
        mean,
        dev,
        capital,
        _distinct_share(h, owner, n, words),
        again[0],
        again[1],
        dup5,
        _distinct_share(lh, line_doc, n, lines),
        np.sqrt(share[:, 65:91].sum(1)),
        np.sqrt(share[:, 97:123].sum(1)),
        np.sqrt(share[:, 48:58].sum(1)),
        np.sqrt(share[:, 128:].sum(1)),
        np.sqrt(share[:, :33].sum(1)),
        np.sqrt(share[:, 0:9].sum(1) + share[:, 127]),
        np.sqrt(share[:, _PUNCT].sum(1)),
        (words < 5).astype(float),
        (words == 0).astype(float),
    ]
    return np.column_stack([np.column_stack(f), np.sqrt(share[:, _PUNCT])])


def _expand(x: np.ndarray, mean: np.ndarray, dev: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / dev, -6, 6)
    return np.column_stack([z, np.abs(z)])


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> dict:
    """Weights, and the features' centre and scale, from features and labels."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return {"mean": np.zeros(x.shape[1]), "dev": np.ones(x.shape[1]), "w": np.zeros(2 * x.shape[1])}
    mean, dev = x.mean(0), x.std(0) + 1e-3
    z = _expand(x, mean, dev)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(z.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, 401):  # full-batch Adam on the pairwise logistic loss
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        g = -(d.T @ p) / pairs + 1e-3 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return {"mean": mean, "dev": dev, "w": w}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    return _expand(x, model["mean"], model["dev"]) @ model["w"]


def quantile(scores: DataFrame, name: str, share: float) -> float:
    """The quantile of a column without nulls, as numpy has it, by counting in ever smaller ranges; 0 without rows."""
    n, lo, hi = scores.agg(F.count("*"), F.min(name), F.max(name)).first()
    if not n:
        return 0.0
    at = share * (n - 1)
    k = int(at)
    x, below = F.col(name), 0  # below: rows under lo
    while lo < hi:
        part = F.least(F.floor((x - lo) / ((hi - lo) / BINS)), F.lit(BINS - 1))
        bins = scores.filter(x.between(lo, hi)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(name).alias("lo"), F.max(name).alias("hi")).orderBy("part").collect()  # at most BINS rows
        for i, b in enumerate(bins):
            if k < below + b["n"]:
                break
            below += b["n"]
        if k + 1 == below + b["n"]:  # the next rank stands in another part
            after = bins[i + 1]["lo"] if i + 1 < len(bins) else b["hi"]
            return b["hi"] + (at - k) * (after - b["hi"])
        lo, hi = b["lo"], b["hi"]
    return lo


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in slices(batch, "text"):
            x = features(data, off)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_TRAIN) -> dict:
    rows = training_rows(documents, labels, label, most).select("doc_id", "text", "y")
    got = rows.mapInArrow(_features_of, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]))
    return fit(x, got["y"].to_numpy())


def _score_all(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in (0, 1)), pa.array(score(model, features(data, off)))], names=["doc_id", "held_out", "score"])

    return run


def centre(labelled: DataFrame) -> tuple[float, float]:
    """The cut and the scale of the scores of all labelled documents: (score, y)."""
    bad, dev = labelled.agg(F.avg(1 - F.col("y")), F.stddev_pop("score")).first()
    if not bad or bad == 1:
        return 0.0, 1.0
    return quantile(labelled, "score", bad), max(1.0, dev / 2)


def rate(documents: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(documents, labels)
    d = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    scratch = Scratch(documents.sparkSession)
    out = scratch.keep(d.mapInArrow(_score_all(model), "doc_id long, held_out boolean, score double"))
    at, scale = centre(scratch.keep(out.join(trainable(labels, "quality"), "doc_id").select("score", "y")))
    s = (F.col("score") - at) / scale
    s = 1 / (1 + F.exp(-F.greatest(F.least(s, F.lit(30.0)), F.lit(-30.0))))
    return out.withColumn("score", s).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op10_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op10_pairwise_quality": op10_pairwise_quality}
