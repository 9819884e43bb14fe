"""Substring dedup by content-defined chunks.

Texts are read as their words (WORD_PATTERN, A-Z lower-cased) with one blank after each, so case,
punctuation and blanks do not matter. A gear rolling hash (16 bits, so the last 16 bytes count)
is taken at the end of each word; a chunk ends where the hash is smaller than at the two words
before and the two after, so chunks hold 3 words or more and 5 on average, and cuts depend on
nearby bytes alone: an insertion shifts no cut farther away. Chunks of more than 16 words are split.

Chunks are matched by digest over all documents, each together with the chunk after it: the
digest of a link is that of two neighbouring chunks, so a run of copied links is one passage and
is not put together from single chunks of different documents. A link is a copy in every document
but the one of smallest doc_id, and, if ``inside`` is set, where it repeats inside a document.
Runs of copied links that hold MIN_RUN_WORDS words or more are cut out, with what follows them up
to the next word; shorter ones (common lines, licence headers) stay.

A scan keeps one link a slice of texts as a candidate and marks the later ones at once, so that a
link that many documents hold does not gather in one task. Texts are shuffled only for documents
whose copied links hold MIN_RUN_WORDS words or more in all; the others pass by a bitmap of fixed
size, whose false positives cost a shuffle and nothing else.

Defined results: null texts and those without words have no chunks and stay as they are; rows of
the same doc_id are one document, so exactly repeated rows stay; rows without doc_id are told
apart by their text and stand before all others; an empty table gives an empty result. Further
columns pass through ``dedup_substrings`` and ``cut_copies``; names that begin with ``__cl_`` are
theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.llm.common import ANY_CASE_WORD, Scratch, _powers, bit_of, bitmap_of, has_bit, is_word, list_array, lowered, mix64, slices, table, word_bounds

NEIGHBOURS = 2
MAX_WORDS = 16
MIN_RUN_WORDS = 25
_WINDOW = 16

_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + G[b[i]] modulo 2**16 at every byte, by doubling."""
    h = _GEAR[data]
    for s in (1, 2, 4, 8):
        t = h.copy()
        t[s:] += h[:-s] << np.uint16(s)
        h = t
    return h


def chunks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first byte, end byte, words, digest) of each chunk of documents data[off[i]:off[i+1]]."""
    z = np.zeros(0, np.int64)
    start, end = word_bounds(data, off)
    n = len(start)
    if not n:
        return z, z, z, z, z.view(np.uint64)
    doc = np.searchsorted(off, start, side="right") - 1
    size = end - start
    head = np.cumsum(size + 1) - (size + 1)
    ink = np.ones(int(head[-1] + size[-1] + 1), bool)
    ink[head + size] = False
    stream = np.full(len(ink), 32, np.uint8)
    stream[ink] = lowered(data[is_word(data)])
    h = gear(stream)[head + size - 1].astype(np.int32)
    new_doc = np.ones(n, bool)
    new_doc[1:] = doc[1:] != doc[:-1]
    doc_head = head[np.maximum.accumulate(np.where(new_doc, np.arange(n), 0))]
    h[head + size - doc_head < _WINDOW] = 1 << 16  # the window would reach into the document before
    low = np.ones(n, bool)
    for k in range(1, NEIGHBOURS + 1):
        same = doc[k:] == doc[:-k]
        low[k:] &= ~same | (h[k:] < h[:-k])
        low[:-k] &= ~same | (h[:-k] < h[k:])
    last = np.append(new_doc[1:], True)
    cut = (low & (h < (1 << 16))) | last
    first = np.flatnonzero(np.concatenate([[True], cut[:-1]]))
    words = np.diff(np.append(first, n))
    if words.max() > MAX_WORDS:
        parts = -(-words // MAX_WORDS)
        base = np.repeat(first, parts)
        step = np.arange(len(base)) - np.repeat(np.cumsum(parts) - parts, parts)
        first = base + step * MAX_WORDS
        words = np.diff(np.append(first, n))
    final = first + words - 1
    return doc[first], start[first], end[final], words, digests(stream, head[first], head[final] + size[final])


def digests(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit digest of each byte range, from prefix sums of a polynomial."""
    p, q = _powers(len(data) + 1)
    acc = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=acc[1:])
    return mix64((acc[end] - acc[first]) * q[first] + (end - first).astype(np.uint64))


def links(doc: np.ndarray, d: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, digest, words) of each pair of neighbouring chunks."""
    at = np.flatnonzero(doc[1:] == doc[:-1])
    return doc[at], mix64(d[at] * np.uint64(0x100000001B3) + d[at + 1]), words[at] + words[at + 1]


#: Kinds of rows, in the last two bits of ``code`` behind the number of words: a link whose first document is sought, one that an earlier document of its slice has, words of links that repeat inside a document.
_OPEN, _COPY, _REPEAT = 0, 1, 2


def _rows(inside: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, data, off in slices(batch, "text"):
                doc, _, _, words, d = chunks(data, off)
                row, d, words = links(doc, d, words)
                if not len(row):
                    continue
                key = ids[i:j][row]
                order = np.lexsort((row, key, d))
                d, key, row, words = d[order], key[order], row[order], words[order]
                new = np.ones(len(d), bool)
                new[1:] = d[1:] != d[:-1]
                new_key = new.copy()
                new_key[1:] |= key[1:] != key[:-1]
                at = np.flatnonzero(new_key)
                cols = [d[at].view(np.int64), key[at], np.add.reduceat(words, at) << 2 | np.where(new[at], _OPEN, _COPY)]
                if inside:
                    again = ~new_key
                    again[1:] &= row[1:] == row[:-1]
                    within = np.bincount(row[again], weights=words[again], minlength=j - i).astype(np.int64)
                    rep = np.flatnonzero(within)
                    cols = [np.append(a, b) for a, b in zip(cols, (np.zeros(len(rep), np.int64), ids[i:j][rep], within[rep] << 2 | _REPEAT), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["digest", "doc", "code"])

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, sorted by digest and document, without each digest's first document."""
    last: tuple[int, int] | None = None  # digest and first document of the run that the batch before ended in
    for batch in batches:
        digest, doc, code = (batch.column(k).to_numpy() for k in range(3))
        keep = (code & 3) != _OPEN
        at = np.flatnonzero(~keep)
        if len(at):
            d, o = digest[at], doc[at]
            new = np.ones(len(at), bool)
            new[1:] = d[1:] != d[:-1]
            source = o[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            if last is not None and d[0] == last[0]:
                source[: np.append(np.flatnonzero(new[1:]) + 1, len(at))[0]] = last[1]
            last = int(d[-1]), int(source[-1])
            keep[at[o != source]] = True
        yield batch.filter(pa.array(keep))


def _listed(min_words: int):
    """(doc, copied links) of each document whose rows, sorted by doc, hold ``min_words`` words or more."""

    def pack(doc: np.ndarray, digest: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        many = np.add.reduceat(code >> 2, at) >= min_words
        n = np.diff(np.append(at, len(doc)))
        use = np.repeat(many, n) & ((code & 3) != _REPEAT)
        per = np.add.reduceat(use.astype(np.int64), at)[many]
        return pa.RecordBatch.from_arrays([pa.array(doc[at[many]]), list_array(digest[use], per, pa.int64())], names=["doc", "copied"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            cols = [np.concatenate([r, batch.column(c).to_numpy()]) for r, c in zip(rest, ("doc", "digest", "code"), strict=True)]
            if not len(cols[0]):
                continue
            end = int(np.searchsorted(cols[0], cols[0][-1]))  # the last document may go on in the next batch
            if end:
                yield pack(*(c[:end] for c in cols))
            rest = [c[end:] for c in cols]
        if len(rest[0]):
            yield pack(*rest)

    return run


def _key(documents: DataFrame):
    """doc_id, or a number below all others from the text."""
    unnamed = -(F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2))
    return F.coalesce(F.col("doc_id").cast("long"), unnamed)


def copied_links(documents: DataFrame, min_words: int = MIN_RUN_WORDS, inside: bool = False) -> DataFrame:
    """(doc, copied [digest]) of the documents whose links that an earlier one has, or that repeat, hold ``min_words`` words or more in all."""
    shape = "digest long, doc long, code long"
    rows = documents.select(_key(documents).alias("doc"), "text").mapInArrow(_rows(inside), shape)
    # Links that are known to be copies need no partner: they are dealt by their document.
    rows = rows.repartition(F.when(F.col("code").bitwiseAND(3) == _OPEN, F.col("digest")).otherwise(F.xxhash64("doc")))
    hit = rows.sortWithinPartitions("digest", "doc").mapInArrow(_later, shape)
    return hit.repartition("doc").sortWithinPartitions("doc").mapInArrow(_listed(min_words), "doc long, copied array<long>")


def _bad_runs(d: np.ndarray, words: np.ndarray, given: np.ndarray, min_words: int, inside: bool) -> list[tuple[int, int, int]]:
    """(first chunk, chunk after the last, words) of the runs to cut in one document of these links' digests and chunks' words."""
    bad = np.isin(d, given)
    if inside:
        again = np.ones(len(d), bool)
        again[np.unique(d, return_index=True)[1]] = False
        bad |= again
    edge = np.flatnonzero(np.diff(np.concatenate([[0], bad.astype(np.int8), [0]]))).reshape(-1, 2)
    runs = [(int(s), int(e) + 1, int(words[s : e + 1].sum())) for s, e in edge]
    return [r for r in runs if r[2] >= min_words]


def _cut(names: list[str], min_words: int, inside: bool):
    text_at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copied = batch.column(len(names))
            out_text, out_words, out_cut, out_spans = [], [], [], []
            for i, j, data, off in slices(batch, "text"):
                doc, first, end, words, d = chunks(data, off)
                bounds = np.searchsorted(doc, np.arange(j - i + 1))
                _, link, _ = links(doc, d, words)
                ink = is_word(data)
                at_link = bounds - np.concatenate([[0], np.cumsum(np.diff(bounds) > 0)])  # one link less than chunks in each document
                plain = batch.column(text_at)[i:j].to_pylist()
                for k in range(j - i):
                    a, b = bounds[k], bounds[k + 1]
                    w = words[a:b]
                    given = copied[i + k].values
                    runs = _bad_runs(link[at_link[k] : at_link[k + 1]], w, given.to_numpy().view(np.uint64), min_words, inside) if given is not None else []
                    spans = [(int(first[a + s] - off[k]), int(end[a + e - 1] - off[k])) for s, e, _ in runs]
                    if spans:
                        raw = data[off[k] : off[k + 1]].tobytes()
                        at, kept = 0, []
                        for s, e in spans:
                            kept.append(raw[at:s])
                            on = ink[off[k] + e : off[k + 1]]  # what parts the cut words from the next goes with them
                            at = e + (int(on.argmax()) if on.any() else len(on))
                        kept.append(raw[at:])
                        out_text.append(b"".join(kept).decode("utf-8", "replace"))
                    else:
                        out_text.append(plain[k])
                    out_words.append(int(w.sum()))
                    out_cut.append(sum(n for _, _, n in runs))
                    out_spans.append([{"start": s, "end": e} for s, e in spans])
            cols = [pa.array(out_text, pa.string()) if x == text_at else batch.column(x) for x in range(len(names))]
            cols += [pa.array(out_words, pa.int64()), pa.array(out_cut, pa.int64()), pa.array(out_spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            fields = [pa.field(n, c.type) for n, c in zip([*names, "__cl_n_words", "__cl_n_cut_words", "__cl_spans"], cols, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(fields))

    return run


_ADDED = "__cl_n_words long, __cl_n_cut_words long, __cl_spans array<struct<start: long, end: long>>"


def _parted(documents: DataFrame, min_words: int, inside: bool) -> tuple[DataFrame, DataFrame]:
    """Documents that stay as they are, and the others with their texts cut and the columns of _ADDED."""
    c = Scratch(documents.sparkSession).keep(copied_links(documents, min_words, inside)).select(F.col("doc").alias("__cl_doc"), F.col("copied").alias("__cl_copied"))
    named = bitmap_of(c, "__cl_doc")
    d = documents.withColumn("__cl_key", _key(documents))
    hit = has_bit(named)(bit_of(F.col("__cl_key")))
    some = d.filter(hit).join(c, F.col("__cl_key") == F.col("__cl_doc"), "left").select(*documents.columns, "__cl_copied")
    schema = T.StructType([*documents.schema.fields, *T.StructType.fromDDL(_ADDED).fields])
    return d.filter(~hit).drop("__cl_key"), some.mapInArrow(_cut(documents.columns, min_words, inside), schema)


def dedup_substrings(documents: DataFrame, min_words: int = MIN_RUN_WORDS, inside: bool = False) -> DataFrame:
    """All columns, with text less its copied runs, and __cl_n_words, __cl_n_cut_words, __cl_spans (bytes of the old text)."""
    whole, cut = _parted(documents, min_words, inside)
    n = F.coalesce(F.regexp_count("text", F.lit(ANY_CASE_WORD)), F.lit(0)).cast("long")
    spans = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return whole.select("*", n.alias("__cl_n_words"), F.lit(0).cast("long").alias("__cl_n_cut_words"), spans.alias("__cl_spans")).union(cut)


def cut_copies(documents: DataFrame, min_words: int = MIN_RUN_WORDS, inside: bool = False) -> DataFrame:
    """The documents less their copied runs; one of which nothing is left goes. ``n_chars``, if there, is counted anew."""
    whole, cut = _parted(documents, min_words, inside)
    touched = F.col("__cl_n_cut_words") > 0
    cut = cut.filter("__cl_n_cut_words < greatest(__cl_n_words, 1)")
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(touched, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return whole.union(cut.select(documents.columns))


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("__cl_n_words").alias("n_words"), F.col("__cl_n_cut_words").alias("n_cut_words"), F.col("__cl_spans").alias("spans"))


QUERIES = {"op5_chunk_dedup": op5_chunk_dedup}
