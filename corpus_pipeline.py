"""A corpus pipeline of five operators: each stage reads what its predecessor has written.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of
documents. A stage decides over all rows that its predecessor kept.

Defined results for odd input: null text counts as empty, so the first stage drops it, as it drops
every text if no document is labelled; rows with null ids are kept and come after all others; rows
that repeat are documents of their own until one of them stays; null sources are one source; an
empty table stays empty through all stages; columns beside those of documents are carried along,
whatever their names, but not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwell.llm import byte_bpe, common, exact_dedup, language_id, mixing, simhash


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (all, if none is labelled); any other text counts as one of the labelled languages."""
    return language_id.drop_unknown(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the row with the largest doc_id."""
    return exact_dedup.drop_repeats(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the row with the smallest doc_id."""
    return simhash.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources meet their target weights."""
    return mixing.take_copies(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left; returns digests of the ids and of the bytes decoded from them."""
    return byte_bpe.round_trip_digests(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", near_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", encoding_stage),
]

#: SQL can't express trained models, SimHash or BPE; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    return run_on(spark, common.table(spark, f"{sf_dir}/documents.parquet"), sf_dir)


def run_on(spark: SparkSession, docs: DataFrame, sf_dir: str = "") -> DataFrame:
    """All stages over docs. Tables that a stage has written on its way go when its result is written."""
    mark = common.written()
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
        common.release(spark, mark, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
