"""The corpus pipeline: documents through five of the training-data operators.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor
kept, and its decisions take effect: toxic documents go, one document of each
group of near copies stays, documents that hold test passages go, secrets are
masked in the text, and what is left is encoded.

All stages but the last return the columns of their input, whatever their
names (temporary columns take unused names). Null and empty texts are judged
as the empty text and never dropped for being empty, save as near copies of
one another; rows with a null id take part; texts are read whole at any
length; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from botlog.llm import bpe, common, secrets, simhash, tiling, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the model learns from the labels
    of ``sf_dir``. Repeated rows are judged alike; without labels of both kinds
    every text has the prior's score, and all stay if that is below one half."""
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints at most 4 bits apart (4-word
    shingles): the smallest id, ties by text hash; of rows that repeat id and text, one."""
    return simhash.drop_near_duplicates(docs, shingle=4, max_distance=4)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no test passage; an empty test set drops nothing."""
    return tiling.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars set anew where a text changed."""
    return secrets.redact(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of every document."""
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("bpe_encoding", encode_stage),
]

#: SQL has no learnt lexicon and no byte-pair encoding; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; every stage's output is written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
