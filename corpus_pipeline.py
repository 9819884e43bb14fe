"""A corpus pipeline of five stages, each on all that the one before has kept.

toxicity drops documents that score 0.7 or more; near_duplicates keeps one document of each
group linked at Jaccard 0.8 or more on five-word shingles; substring_dedup cuts runs of chunks
that an earlier document has; decontamination drops documents with windows of two benchmark
items or more and cuts the hit words out of the others; packing lays the documents out in
sequences of 2048 tokens.

Null and empty texts pass all stages and are packed as one closing token each. Of repeated rows one
stays where they have words, all where they have none. Rows without a doc_id are told apart by
their text. An empty table gives an empty result. All stages but the last return the columns they
were given, whatever their names; names that begin with ``__cl_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkloom.llm import bestfit_packing, chosen_path, chunk_dedup, decontaminate, toxicity_gru
from chunkloom.llm.common import Scratch, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the cut; the network learns from the labelled ones that are not held out."""
    return toxicity_gru.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id in each group."""
    return chosen_path.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without copied runs; a document of which nothing is left goes."""
    return chunk_dedup.cut_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark text."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places."""
    return bestfit_packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A trained network scores the first stage, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs)
    return docs
