"""A corpus from raw documents to packed sequences. Each stage works on all rows that the one before it kept.

Defined results, of every stage: an empty table gives an empty result. Null ids, repeated ids and repeated rows are kept apart by
their texts; nulls in other columns and extra columns, whatever their names, are carried along by all stages but the last. A null
text has no language, so language_id drops it; a later stage that is given one keeps it (exact_dedup counts it as empty, jaccard_join
and decontamination find nothing in it, sequence_packing packs its end token). Of ties, jaccard_join keeps the smallest id and
exact_dedup the largest; of equal texts with equal ids one row stays. Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from copse.llm import decontam, dedup, jaccard, langid, packing
from copse.llm.common import discard, documents, stash
from copse.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language model rejects: no letter, or a calibrated probability under its threshold."""
    return langid.accepted(docs, langid.fit(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return dedup.drop_copies(docs, keep="largest")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near copies, the document with the smallest doc_id stays."""
    return jaccard.keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; a row per piece, with its ids."""
    return packing.pack(docs, packing.chunk_tokenizer(vocabulary()))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("sequence_packing", sequence_packing),
]

#: A learned model, a tokenizer and online packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            out = stash(out, name)
            if i:
                discard(spark, docs)  # written by this run and read for the last time
        docs = out
    return docs
