"""Corpus pipeline: quality rules, near-duplicates, decontamination, secrets, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet into the
shared folder and gives the reread rows to the next one. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm import decontaminate, near_dup, quality_rules, secret_scan, sentencepiece_fst
from mailsift.llm.common import fresh, prepare, written
from mailsift.session import read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; rejected documents go."""
    return quality_rules.clean(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (shingles of five words, similarity 0.8 or more)."""
    return near_dup.distinct_documents(docs, size=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    h = fresh(docs, "hits")
    out = decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), name=h)
    return out.where(f"size(`{h}`.words) = 0").drop(h)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secret_scan.redact(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, the number of tokens and whether these decode to the text."""
    p = fresh(docs, "pieces")
    out = sentencepiece_fst.encode(docs, name=p, remember=100_000)  # the workers also hold what earlier stages left
    return out.select("doc_id", "text", "lang", "source", f"`{p}`.n_tokens", f"`{p}`.ids", F.col(f"`{p}`.same").alias("decodes_to_text"))


STAGES = [("quality rules", quality_stage), ("MinHash near-duplicates", near_duplicate_stage),
          ("benchmark decontamination", decontamination_stage), ("secret scans", secret_stage),
          ("SentencePiece encoding", token_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
