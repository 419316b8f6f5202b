"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm import bpe, exact_dedup, license_scan, mixing, ngram_join, quality_gam, quality_rules, sstable, substring_dedup, token_counts
from leafline.session import load

#: Vocabulary files; their folder is a parameter of the operators.
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exact_dedup.groups(load(spark, sf_dir, "documents"))
    return got.select(F.col("key").alias("doc_id"), F.col("keep_key").alias("keep_id"), "group_size", "kept", F.col("sha256").alias("text_sha256"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, _ = ngram_join.joined(load(spark, sf_dir, "documents"))
    return got.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(docs, vocabulary(BYTE_BPE))))


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_gam.scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return got.withColumnRenamed("key", "doc_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(load(spark, sf_dir, "documents"))


def op6_sorted_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = load(spark, sf_dir, "documents"), sstable.fresh_dir(spark)
    manifest = sstable.write(docs, vocabulary(WORD_BPE), out, end_id=2)
    return sstable.read(spark, manifest, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, vocabulary(BYTE_BPE)).drop("text")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mixing.plan(load(spark, sf_dir, "documents"))
    return p.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As its SQL has it: lines, and short documents with a cue as whole licence files, against TEMPLATES; a licence holds for one source and language."""
    files = license_scan.corpus_paths(load(spark, sf_dir, "documents"))
    # slashes inside or between source and language open no directories
    flat = files.withColumn("path", F.regexp_replace("path", r"/(?!LICENSE\.-?\d+$|(-?\d+/)?-?\d+\.txt$)", "\x01"))
    got = license_scan.scan(flat, more=()).drop("text")
    return got.withColumns({c: F.translate(c, "\x01", "/") for c in ("path", "inherited_from")})


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.verdicts(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def queries() -> dict:
    return {f.__name__: f for f in (op1_exact_dedup, op2_ngram_join, op3_token_counts, op4_quality_gam, op5_substring_dedup, op6_sorted_shards, op7_mixing, op8_bpe, op9_license_scan, op10_quality_rules)}
