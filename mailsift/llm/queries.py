"""Queries of the training-data operators over the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm import oracles
from mailsift.session import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = dict(oracles.ORACLES)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mailsift.llm import decontaminate as op
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return op.digest(op.decontaminate(docs, read_table(spark, sf_dir, "benchmark")))


@query
def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mailsift.llm import warc
    return warc.round_trip(read_table(spark, sf_dir, "pages")).drop("url")


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mailsift.llm import secret_scan as op
    return op.find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mailsift.llm import quality_rules as op
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return op.quality(docs, name="q", with_text=False).select("doc_id", F.col("q.*"))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mailsift.llm import substring_words as op
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return op.dedup(docs).drop("removed", "kept")


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mailsift.llm import substring_bytes as op
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return op.dedup(docs).drop("removed", "kept")


@query
def op8_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mailsift.llm import near_dup as op
    return op.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mailsift.llm import sentencepiece_fst as op
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return op.encode(docs, name="p").select("doc_id", F.col("p.n_tokens"), F.col("p.ids"), F.col("p.same").alias("decodes_to_text"))


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mailsift.llm import licenses as op
    return op.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"), op.notices(spark))


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mailsift.llm import pii as op
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return op.find_pii(docs, name="p").select("doc_id", F.col("p.*"))


@query
def op11_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mailsift.llm import mixing as op
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return op.mix(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mailsift.llm import vector_codes as op
    return op.digest(read_table(spark, sf_dir, "embeddings"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mailsift.llm import spelling as op
    return op.variants(read_table(spark, sf_dir, "documents"))
