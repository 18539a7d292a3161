"""Corpus pipeline: toxic documents go, one of each near-duplicate group stays, secrets are masked, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from framelake.llm import packing, queries, secret_scan, simhash_dedup, toxicity
from framelake.llm.common import stored, table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from ``labels``."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked SimHash fingerprints stays."""
    return simhash_dedup.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in place, copied examples with a mark of their own; every document stays."""
    return secret_scan.masked(docs, F.col("source"), F.concat_ws("/", "source", "lang"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens."""
    return packing.packed(docs, queries.vocabulary())


STAGES = [("toxicity", not_toxic), ("simhash_near_dedup", near_duplicates), ("secret_scans", without_secrets), ("best_fit_packing", packed)]
# The tokenizer and the trained classifier have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
