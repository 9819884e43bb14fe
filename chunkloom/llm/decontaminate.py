"""Benchmark decontamination with DataFrame functions only.

Benchmark items become a set of hashed windows of 8 words, broadcast if their counted number
is small. One generated row per document position probes the set inside whole-stage code; the
few hits are verified against the window's words, then gathered per document.

Defined results: a null text has no words; a repeated row gets the same answer each time it
occurs; an item without words has no window; items with the same id count once; an empty
table gives an empty result, an empty benchmark leaves all documents clean. Only doc_id, text,
item_id and text are read, so further columns of any name do not matter.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import WORD_PATTERN, table

WINDOW = 8
#: Above this many benchmark windows the set is joined by shuffling, not broadcast.
MAX_BROADCAST_WINDOWS = 2_000_000


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone; all-ASCII texts take the quick built-in."""
    slow = F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(slow)


def words(c: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(c), F.lit(WORD_PATTERN), F.lit(0)), F.array().cast("array<string>"))


def _hash_at(i: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(n)])


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(n, key, window, items): windows of n words with the items they occur in."""
    b = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    b = b.withColumn("n", F.least(F.size("words"), F.lit(WINDOW)))
    b = b.select("item", "n", F.explode(F.expr("transform(sequence(0, size(words) - n), i -> slice(words, i + 1, n))")).alias("w"))
    b = b.select("item", "n", "w", F.array_join("w", " ").alias("window")).groupBy("n", "window").agg(F.first("w").alias("words"), F.collect_set("item").alias("items"))
    key = F.coalesce(*[F.when(F.col("n") == k, _hash_at(F.lit(0), k)) for k in range(1, WINDOW + 1)])
    return b.select("n", key.alias("key"), "window", "items")


def hits(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per distinct (doc_id, text): n_words, copies, spans [(at, n)], items."""
    windows = item_windows(benchmark)
    sizes = {r["n"]: r["count"] for r in windows.groupBy("n").count().collect()} or {WINDOW: 0}
    base = documents.select("doc_id", F.xxhash64("text").alias("tkey"), F.octet_length("text").alias("tlen"), words(F.col("text")).alias("words"))
    parts = []
    for k, n in enumerate(sorted(sizes)):
        low = -1 if k == 0 else 0  # position -1 stands for the document itself, once
        last = F.size("words") - n
        at = F.explode(F.when(last >= low, F.sequence(F.lit(low), last)).when(F.lit(low == -1), F.array(F.lit(-1))))
        g = base.withColumn("n_words", F.size("words")).select("*", at.alias("at"))
        g = g.withColumn("probe", F.when(F.col("at") >= 0, _hash_at(F.col("at"), n)).otherwise(F.xxhash64("doc_id", "tkey")))
        w = windows.filter(F.col("n") == n).select("key", "window", "items")
        w = F.broadcast(w) if sum(sizes.values()) <= MAX_BROADCAST_WINDOWS else w
        j = g.join(w, F.col("probe") == F.col("key"), "left")
        ok = (F.col("at") >= 0) & F.col("window").isNotNull() & (F.array_join(F.slice("words", F.col("at") + 1, n), " ") == F.col("window"))
        j = j.filter((F.col("at") < 0) | ok)
        hit = F.col("at") >= 0
        parts.append(j.select("doc_id", "tkey", "tlen", "n_words", F.when(hit, F.struct("at", F.lit(n).alias("n"))).alias("span"), F.when(hit, F.col("items")).alias("items"), (~hit).cast("long").alias("self")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return rows.groupBy("doc_id", "tkey", "tlen").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sum("self").alias("copies"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


_COVERED = """aggregate(spans, named_struct('sum', 0L, 'end', 0),
  (a, s) -> named_struct('sum', a.sum + greatest(0, s.at + s.n - greatest(a.end, s.at)), 'end', greatest(a.end, s.at + s.n)),
  a -> a.sum)"""


def score(documents: DataFrame, benchmark: DataFrame, min_items: int = 2) -> DataFrame:
    """Per document row: n_words, n_hit, n_items, items_sha256, contaminated."""
    h = hits(documents, benchmark).withColumn("n_items", F.size("items").cast("long"))
    out = h.select(
        "doc_id",
        "n_words",
        F.expr(_COVERED).alias("n_hit"),
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_items") >= min_items).alias("contaminated"),
        F.explode(F.expr("sequence(1L, copies)")).alias("_copy"),
    )
    return out.drop("_copy")


def decontaminate(documents: DataFrame, benchmark: DataFrame, min_items: int = 2) -> DataFrame:
    """Drop documents with windows of ``min_items`` items or more; cut hit words out of the others.

    All columns are kept. A cut takes each hit word with what follows it up to the next word.
    A document of which nothing is left goes too. Untouched documents come out byte for byte.
    """
    h = hits(documents, benchmark).filter(F.size("spans") > 0)
    h = h.select(F.col("doc_id").alias("__cl_id"), F.col("tkey").alias("__cl_key"), F.col("tlen").alias("__cl_len"), F.col("spans").alias("__cl_spans"), (F.size("items") >= min_items).alias("__cl_drop"))
    text = F.col("text")
    on = F.col("doc_id").eqNullSafe(F.col("__cl_id")) & (F.xxhash64("text") == F.col("__cl_key")) & F.octet_length(text).eqNullSafe(F.col("__cl_len"))
    d = documents.join(h, on, "left").filter(~F.coalesce(F.col("__cl_drop"), F.lit(False)))
    any_case = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    pieces = F.regexp_extract_all(text, F.lit(rf"({any_case})([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)"), F.lit(0))
    head = F.regexp_extract(text, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    gone = F.array_distinct(F.flatten(F.transform("__cl_spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))
    # A one-element array binds the pieces: written out in the inner function they would be split anew for each word.
    left = F.transform(F.array(F.struct(pieces.alias("p"), gone.alias("g"))), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x["p"]) - 1), x["g"]), lambda i: F.get(x["p"], i)), ""))
    hit = F.col("__cl_spans").isNotNull()
    d = d.withColumn("__cl_text", F.when(hit, F.concat(head, F.get(left, F.lit(0)))))
    d = d.filter(~hit | (F.length(F.trim("__cl_text")) > 0)).withColumn("text", F.when(hit, F.col("__cl_text")).otherwise(text))
    if "n_chars" in documents.columns:
        d = d.withColumn("n_chars", F.when(hit, F.char_length("__cl_text").cast("long")).otherwise(F.col("n_chars")))
    return d.select(documents.columns)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op9_decontaminate": op9_decontaminate}

_WORDS_SQL = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
ORACLE_SQL = {
    "op9_decontaminate": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 8) AS n, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT dw.rid, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
p AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS q FROM h) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM h GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(t.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN t USING (rid)"""
}
