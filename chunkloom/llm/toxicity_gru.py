"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Every word enters as the sum of a word vector (words known from training) and the mean vector
of its character trigrams. Windows of WINDOW words that overlap by a quarter cover the whole text.
Two GRUs read a window from both ends, attention pools their states, and a logistic unit scores
the window; a document's score is that of its highest window. Training is by multiple instances:
each epoch picks every document's highest window under the present weights and takes Adam steps
on it. The first component of the vectors starts at the log-odds of the word, or their mean
over the words with a trigram.

The network learns from at most MAX_TRAIN documents and MAX_TRAIN_BYTES bytes of each label, in
the order of a hash of doc_id (a text that no longer fits is passed over); they are weighted by the
labels' counts over all labelled documents, so that the share of toxic ones is the same at every
size. Neither uses held-out ones: crc32(doc_id as text) mod 3 = 1. Words in MIN_COUNT of these
documents or more have a vector of their own, the MAX_VOCABULARY most frequent ones if they are
more; others enter by their trigrams. One executor task fits the network; the driver gets its
arrays alone, whose size the two bounds give.

Defined results: a null text, or one without words, gets the score of an empty window; repeated
rows get equal scores; null labels are ignored, and a doc_id with both labels has none; without
labels of both kinds all scores are 0; an empty table gives an empty result. Only doc_id, text and
toxic are read; ``keep_clean`` passes all columns through.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import _KIND, _LOWER, _powers, mix64, slices, table, word_bounds, word_hashes
from chunkloom.llm.pairwise_quality import held_out, trainable, training_rows

WINDOW = 48
STRIDE = 36
HIDDEN = 8
VECTOR = 12
TRIGRAMS = 4096
#: Labelled documents and text bytes of each label that training reads at most, and words that have a vector of their own.
MAX_TRAIN = 2000
MAX_TRAIN_BYTES = 12 << 20
MAX_VOCABULARY = 30_000
MIN_COUNT = 4
EPOCHS = 5
BATCH = 128
CUT = 0.7

F32 = np.float32


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (n[0] of them), first[1], ..."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + n, n)


#: Distinct words whose trigrams are worked on at once.
BLOCK = 1 << 14


def _trigrams(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers of the trigrams of each word's bytes with a mark at either end; as many as it has bytes."""
    flat = np.full(int((size + 2).sum()), 1, np.uint64)
    head = np.cumsum(size + 2) - (size + 2)
    flat[_ranges(head + 1, size)] = _LOWER[data[_ranges(first, size)]]
    pos = _ranges(head, size)
    return (mix64(flat[pos] << np.uint64(16) | flat[pos + 1] << np.uint64(8) | flat[pos + 2]) % np.uint64(TRIGRAMS)).astype(np.int32)


class Words:
    """The words of a slice of documents: distinct ones, trigrams of each, windows."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        starts, ends = word_bounds(data, off)
        owner = np.searchsorted(off, starts, side="right") - 1
        self.n_docs = len(off) - 1
        n = np.bincount(owner, minlength=self.n_docs)
        self.hashes, at, self.word = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        a, b = starts[at], ends[at]
        self.tri_n = b - a
        parts = [_trigrams(data, a[k : k + BLOCK], self.tri_n[k : k + BLOCK]) for k in range(0, len(a), BLOCK)]
        self.tri = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        # Windows.
        first = np.cumsum(n) - n
        per = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1, 0)
        self.doc = np.repeat(np.arange(self.n_docs), per)
        step = _ranges(np.zeros(self.n_docs, np.int64), per) * STRIDE
        self.start = first[self.doc] + step
        self.len = np.minimum(WINDOW, n[self.doc] - step)
        self.words_of_doc = n

    def batch(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and mask, by time and window; padding is number 0 with mask 0."""
        t = np.arange(WINDOW)[:, None]
        mask = t < self.len[which][None, :]
        at = np.where(mask, self.start[which][None, :] + t, 0)
        return self.word[at], mask.astype(F32)


def new_model(vocabulary: np.ndarray, word_odds: np.ndarray, tri_odds: np.ndarray, seed: int = 11) -> dict:
    r = np.random.default_rng(seed)
    g = lambda *s: (r.standard_normal(s) * 0.2).astype(F32)
    m = {"vocabulary": vocabulary, "Ew": g(len(vocabulary) + 1, VECTOR) * F32(0.2), "Ec": g(TRIGRAMS, VECTOR) * F32(0.2), "va": g(2 * HIDDEN), "u": g(2 * HIDDEN), "b": np.full(1, -3, F32)}
    m["Ew"][0] = 0
    m["Ew"][1:, 0] = word_odds
    m["Ec"][:, 0] = tri_odds
    for d in "fb":
        m["W" + d], m["U" + d], m["c" + d] = g(VECTOR, 3 * HIDDEN), g(HIDDEN, 3 * HIDDEN), np.zeros(3 * HIDDEN, F32)
        m["W" + d][0, 2 * HIDDEN] = 1  # the first unit starts by passing the log-odds on
        m["W" + d][0, 0] = 1
    for k in (0, HIDDEN):
        m["va"][k], m["u"][k] = 4, 4
    return m


def rows_of(m: dict, w: Words) -> np.ndarray:
    """The row of each distinct word in the word vectors; 0 for unknown ones."""
    at = np.searchsorted(m["vocabulary"], w.hashes)
    known = at < len(m["vocabulary"])
    known[known] = m["vocabulary"][at[known]] == w.hashes[known]
    return np.where(known, at + 1, 0)


def vectors(m: dict, w: Words, which: np.ndarray | None = None) -> np.ndarray:
    """The input vector of each distinct word, or of those numbered ``which``."""
    row, n = rows_of(m, w), w.tri_n
    tri = w.tri
    if which is not None:
        tri = tri[_ranges((np.cumsum(n) - n)[which], n[which])]
        row, n = row[which], n[which]
    out = m["Ew"].take(row, axis=0)
    ends = np.cumsum(n)
    for k in range(0, len(n), BLOCK):
        part = slice(k, k + BLOCK)
        at = ends[part] - n[part]
        out[part] += np.add.reduceat(m["Ec"].take(tri[at[0] : ends[part][-1]], axis=0), at - at[0]) / n[part, None].astype(F32)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return F32(0.5) * np.tanh(F32(0.5) * x) + F32(0.5)


def _gru(x: np.ndarray, ids: np.ndarray, mask: np.ndarray, rec: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
    """States of one direction by time; x[ids[t]] holds the input part of the three gates."""
    T, B = ids.shape
    out = np.zeros((T, B, HIDDEN), F32)
    h = np.zeros((B, HIDDEN), F32)
    for t in range(T - 1, -1, -1) if back else range(T):
        g, hu = x.take(ids[t], axis=0), h @ rec
        zr = _sigmoid(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN] * mask[t][:, None], zr[:, HIDDEN:]
        c = np.tanh(g[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        if keep is not None:
            keep.append((t, h, zr, z, c, hu))
        h = h + z * (c - h)
        out[t] = h
    return out


def _pool(m: dict, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    e = np.where(mask > 0, states @ m["va"], F32(-1e9))
    a = np.exp(e - e.max(0)) * mask
    a /= a.sum(0)
    ctx = np.einsum("tb,tbh->bh", a, states)
    return a, ctx, ctx @ m["u"] + m["b"][0]


def window_logits(m: dict, w: Words, step: int = 2048) -> np.ndarray:
    x = vectors(m, w)
    gates = {d: x @ m["W" + d] + m["c" + d] for d in "fb"}
    out = np.zeros(len(w.doc), F32)
    for k in range(0, len(w.doc), step):
        ids, mask = w.batch(np.arange(k, min(k + step, len(w.doc))))
        states = np.concatenate([_gru(gates[d], ids, mask, m["U" + d], d == "b") for d in "fb"], axis=2)
        out[k : k + step] = _pool(m, states, mask)[2]
    return out


def document_logits(m: dict, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(highest window logit, number of that window or -1) of each document."""
    best = np.full(w.n_docs, m["b"][0], F32)
    which = np.full(w.n_docs, -1)
    if len(w.doc):
        logit = window_logits(m, w)
        order = np.lexsort((logit, w.doc))
        last = np.append(np.flatnonzero(np.diff(w.doc[order])), len(order) - 1)
        best[w.doc[order[last]]] = logit[order[last]]
        which[w.doc[order[last]]] = order[last]
    return best, which


def gradients(m: dict, w: Words, which: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Loss and gradients of the windows' weighted logistic loss, by back-propagation through time."""
    ids, mask = w.batch(which)
    uniq, back = np.unique(ids, return_inverse=True)
    ids = back.reshape(ids.shape)
    xu = vectors(m, w, uniq)
    keep = {"f": [], "b": []}
    states = np.concatenate([_gru(xu @ m["W" + d] + m["c" + d], ids, mask, m["U" + d], d == "b", keep[d]) for d in "fb"], axis=2)
    a, ctx, logit = _pool(m, states, mask)
    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    loss = float(-(weight * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum())
    dl = ((p - y) * weight).astype(F32)
    g = {"u": ctx.T @ dl, "b": np.array([dl.sum()], F32)}
    dctx = dl[:, None] * m["u"]
    de = a * (np.einsum("tbh,bh->tb", states, dctx) - (ctx * dctx).sum(1))
    g["va"] = np.einsum("tb,tbh->h", de, states)
    ds = a[:, :, None] * dctx[None] + de[:, :, None] * m["va"]
    dx = np.zeros((len(uniq), VECTOR), F32)
    for d, lo in (("f", 0), ("b", HIDDEN)):
        rec = m["U" + d]
        dgate = np.zeros((*ids.shape, 3 * HIDDEN), F32)
        g["U" + d] = np.zeros_like(rec)
        dh = np.zeros((ids.shape[1], HIDDEN), F32)
        for t, h, zr, z, c, hu in reversed(keep[d]):
            dh = dh + ds[t][:, lo : lo + HIDDEN]
            dz, dc = dh * (c - h) * mask[t][:, None], dh * z
            r = zr[:, HIDDEN:]
            dpc = dc * (1 - c * c)
            dr = dpc * hu[:, 2 * HIDDEN :]
            dpz = dz * zr[:, :HIDDEN] * (1 - zr[:, :HIDDEN])
            dpr = dr * r * (1 - r)
            dhu = np.concatenate([dpz, dpr, dpc * r], axis=1)
            g["U" + d] += h.T @ dhu
            dgate[t] = np.concatenate([dpz, dpr, dpc], axis=1)
            dh = dh * (1 - z) + dhu @ rec.T
        flat = np.zeros((len(uniq), 3 * HIDDEN), F32)
        np.add.at(flat, ids.reshape(-1), dgate.reshape(-1, 3 * HIDDEN) * mask.reshape(-1, 1))
        g["W" + d], g["c" + d] = xu.T @ flat, flat.sum(0)
        dx += flat @ m["W" + d].T
    g["Ew"] = np.zeros_like(m["Ew"])
    np.add.at(g["Ew"], rows_of(m, w)[uniq], dx)
    g["Ew"][0] = 0
    g["Ec"] = np.zeros_like(m["Ec"])
    n = w.tri_n[uniq]
    tri = w.tri[_ranges((np.cumsum(w.tri_n) - w.tri_n)[uniq], n)]
    np.add.at(g["Ec"], tri, np.repeat(dx / n[:, None].astype(F32), n, axis=0))
    return loss, g


def _odds(numbers: np.ndarray, doc: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shrunk log-odds, documents) of each number 0..n-1 from its occurrences by document."""
    pair = np.unique(numbers.astype(np.int64) * len(y) + doc)
    num, d = pair // len(y), pair % len(y)
    pos = np.bincount(num, weights=y[d], minlength=n)
    df = np.bincount(num, minlength=n)
    n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    odds = np.log((pos + 0.5) / n1) - np.log((df - pos + 0.5) / n0)
    return np.clip(odds, -3, 3) * df / (df + 6), df


def fit(texts: list[bytes], y: np.ndarray, counts: dict[int, int] | None = None, epochs: int = EPOCHS, seed: int = 3) -> dict | None:
    """A trained model, or None without documents of both labels; ``counts`` has the documents of each label that the texts stand for."""
    if len(y) == 0 or y.min() == y.max():
        return None
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    w = Words(np.frombuffer(b"".join(texts), np.uint8), off)
    y = y.astype(np.float64)
    doc = np.repeat(np.arange(w.n_docs), w.words_of_doc)
    odds, df = _odds(w.word, doc, y, len(w.hashes))
    frequent = np.flatnonzero(df >= MIN_COUNT)
    frequent = np.sort(frequent[np.argsort(-df[frequent], kind="stable")[:MAX_VOCABULARY]])
    # A trigram starts at the mean of the words that hold it.
    held = np.bincount(w.tri, minlength=TRIGRAMS)
    tri_odds = np.bincount(w.tri, weights=np.repeat(odds * (df >= MIN_COUNT), w.tri_n), minlength=TRIGRAMS) / (held + 10)
    m = new_model(w.hashes[frequent], odds[frequent], tri_odds)
    rng = np.random.default_rng(seed)
    mom = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.items() if k != "vocabulary"}
    counts = counts or {0: int((1 - y).sum()), 1: int(y.sum())}
    share = counts[1] / (counts[0] + counts[1])
    stands = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))  # 1 in the mean
    balance = stands * np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    t = 0
    for epoch in range(epochs):
        _, which = document_logits(m, w)
        docs = rng.permutation(np.flatnonzero(which >= 0))
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for k in range(0, len(docs), BATCH):
            d = docs[k : k + BATCH]
            _, g = gradients(m, w, which[d], y[d], balance[d] / len(d))
            t += 1
            for name, (a, b) in mom.items():
                a += 0.1 * (g[name] - a)
                b += 0.01 * (g[name] ** 2 - b)
                m[name] -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-6)).astype(F32)
                if name in ("Ew", "Ec"):
                    m[name] *= F32(1 - 0.02 * rate)
    best, _ = document_logits(m, w)
    # One temperature and shift on the training documents' scores, at the share of all labels.
    s, c, b = best.astype(np.float64), 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(c * s + b, -30, 30)))
        r = stands * (p - y)
        c, b = max(0.2, c - 0.05 * (r * s).mean()), b - 0.2 * r.mean()
    m["calibration"] = (c, b)
    return m


def _fit_task(counts: dict[int, int], most: int, most_bytes: int):
    """Fit on the rows of one partition, taken in their order within the two bounds; one row with the model, or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[bytes, int] = {}
        rows, size = [0, 0], [0, 0]
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                if raw not in texts and rows[y] < most and size[y] + len(raw) <= most_bytes:
                    texts[raw] = y
                    rows[y] += 1
                    size[y] += len(raw)
        m = fit(list(texts), np.array(list(texts.values()), np.int64), counts)
        if m is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(m, 5)], pa.binary())], names=["model"])

    return run


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_TRAIN, most_bytes: int = MAX_TRAIN_BYTES) -> dict | None:
    counts = documents.select("doc_id").join(trainable(labels, label), "doc_id").groupBy("y").count().collect()  # two rows
    counts = {0: 1, 1: 1} | {r["y"]: r["count"] for r in counts}
    rows = training_rows(documents, labels, label, most).withColumn("__cl_order", F.xxhash64("doc_id"))
    rows = rows.repartition(1).sortWithinPartitions("__cl_order", "doc_id", "text").select("text", "y")  # at most 2 * most documents
    got = rows.mapInArrow(_fit_task(counts, most, most_bytes), "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else None


def probability(m: dict | None, w: Words) -> np.ndarray:
    if m is None:
        return np.zeros(w.n_docs)
    c, b = m["calibration"]
    return 1 / (1 + np.exp(-np.clip(c * document_logits(m, w)[0].astype(np.float64) + b, -30, 30)))


def _score_all(m: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text_at = batch.schema.get_field_index("text")
            others = [i for i in range(batch.num_columns) if i != text_at]
            for i, j, data, off in slices(batch, "text"):
                p = probability(m, Words(data, off))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in others), pa.array(p)], names=[*(batch.schema.field(c).name for c in others), "score"])

    return run


def rate(documents: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    m = train(documents, labels)
    d = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    out = d.mapInArrow(_score_all(m), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_clean(documents: DataFrame, labels: DataFrame, cut: float = CUT, learn_from: DataFrame | None = None) -> DataFrame:
    """The documents that score below ``cut``, with all columns."""
    m = train(learn_from if learn_from is not None else documents, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in slices(batch, "text"):
                ok = probability(m, Words(data, off)) < cut
                yield batch.slice(i, j - i).filter(pa.array(ok))

    return documents.mapInArrow(run, documents.schema)


def op8_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_toxicity_gru": op8_toxicity_gru}
