"""A corpus pipeline over documents: quality rules, exact dedup, near-copy removal, mixing, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and reread as the next one's docs.
Empty tables and nulls pass through every stage as its operator defines them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafline.llm import bpe, exact_dedup, mixing, ngram_join, quality_rules
from leafline.llm.queries import BYTE_BPE, vocabulary
from leafline.session import load, scratch


def pass_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a certified cutoff go."""
    return quality_rules.keep(docs, load(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id stays."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingle similarity, the one with the smallest doc_id stays."""
    return ngram_join.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix's order, repeated as often as their source's target asks."""
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256 and decoded_sha256 of each document of the mix."""
    return bpe.round_trip(docs.select("doc_id", "source", "text"), vocabulary(BYTE_BPE)).drop("text")


STAGES = [("quality rules", pass_rules), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("mixing", mix_sources), ("BPE", tokenise)]

#: Certified cutoffs and BPE are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # a stage's own tables go when its result is written
            docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
