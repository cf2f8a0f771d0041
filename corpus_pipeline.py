"""A training-data pipeline over the table documents, in stages that each write a table.

Stages take (spark, docs, sf_dir) and return a DataFrame; each but the last
returns the columns of docs. run() writes what a stage returns as Parquet in
the shared folder and reads it back for the next one, so a lost executor costs
no more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relspan.llm import bpe_codec, decontam, langid, simhash, suffix_dedup
from relspan.llm._common import drop, prepare, stored, tables

# What holds for every stage: rows that repeat are rows of their own, ties go to the least doc_id (a null one is
# least), columns of docs come back as they are, whatever their names (text and doc_id are found by exact name,
# else without regard to case), and no documents give no documents. What a stage does with null and empty texts,
# repeated ids and very long texts, it says itself; no stage cuts a text.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10. Documents of no language learned from the table go: texts of langid.JUDGED n-grams whose cosine with the nearest one is below langid.FLOOR, null and empty texts and such without a letter. Rows with one id are judged each."""
    return langid.accepted(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7. Of each group of near duplicates, copies included, the least doc_id stays.

    Null and empty texts are one group. Rows that repeat an id and its text
    leave one; other texts under one id are documents of their own.
    """
    return simhash.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6. Bytes of 100-byte strings that also start earlier go; documents stay, even with nothing left.

    A null text stays null, shorter texts as they are. Different texts under one id are ordered by a hash; equal ones lose the same.
    """
    return suffix_dedup.dedup_rows(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8. Documents that hold half of a benchmark item or more, by alignment, go; with no benchmark items, none.

    Null, empty and wordless texts stay.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5. doc_id, ids, n_tokens of every document left; null and empty texts have no ids."""
    return bpe_codec.encode(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("decontaminate", decontaminate),
    ("bpe_encode", bpe_encode),
]

#: SQL cannot express alignment, BPE or learned languages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, one after another. What a stage wrote on its way is deleted once its rows are stored."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before = tables()
        own = [] if i == 0 else [before[-1]]  # the stage before
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
            drop(spark, own + [p for p in tables()[:-1] if p not in before])
    return docs
