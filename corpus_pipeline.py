"""Corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewick.llm import bm25, bpe, secrets, toxicity
from tidewick.llm.common import cut, drop_cut, read, shared_path
from tidewick.llm.jaccard import one_of_each
from tidewick.llm.queries import RANK_FILE

#: No SQL expresses the learned lexicon, the near-duplicate components or the merges; tests hold run() against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the toxicity operator predicts toxic."""
    return toxicity.without_toxic(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of documents linked at 5-word shingle Jaccard of 0.8 or more."""
    return one_of_each(docs, k=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item."""
    return bm25.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts, by way of a blob ledger in the shared folder."""
    return secrets.redact(docs, shared_path(spark, "blob-ledger"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the texts that are left."""
    return bpe.round_trip(docs, RANK_FILE)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each returns is written to the shared folder and read by the next, then removed.

    Null ids and texts, empty texts and repeated rows go through as each stage defines; no documents give no rows.
    """
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            drop_cut(last)
        last = docs
    return docs
