"""Registered queries: group-safe splits (SPL-1..3, JON-9, AGG-11, FLT-2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from mailsift.operators.split import (assign_split, filter_language, groups_per_split, overlapping_groups,
                                      split_tables, two_way_split, two_way_split_exact)
from mailsift.plans.registry import register
from mailsift.session import read_table

_FRAC = "(CAST(('0x' || substr(md5('42:' || CAST({g} AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0)"


def _split_sql(g):
    f = _FRAC.format(g=g)
    return f"CASE WHEN {f} < 0.1 THEN 'test' WHEN {f} < 0.2 THEN 'validation' ELSE 'train' END"


@register("spl_documents_by_source", f"SELECT doc_id, source, {_split_sql('source')} AS split FROM documents")
def spl_documents_by_source(spark, sf_dir):
    """SPL-2: documents grouped by source -> train/validation/test."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return assign_split(docs, "source")


@register("spl_conversations_by_id", f"SELECT conv_id, turn, {_split_sql('conv_id')} AS split FROM conversations")
def spl_conversations_by_id(spark, sf_dir):
    """SPL-2 on labelled blocks grouped by conversation (= e-mail) id."""
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return assign_split(conv, "conv_id")


@register("spl_two_way_test_side", f"""
SELECT doc_id FROM documents WHERE {_FRAC.format(g='doc_id')} < 0.2""")
def spl_two_way_test_side(spark, sf_dir):
    """SPL-1: row-level two-way split (group = row id); the test side."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    return two_way_split(docs, "doc_id", 0.2)[1]


_EXACT = """g AS (SELECT *, row_number() OVER (ORDER BY f, grp) AS no, count(*) OVER () AS n FROM (
  SELECT DISTINCT {g} AS grp, {f} AS f FROM {t}))"""


@register("spl_exact_groups", f"""
WITH {_EXACT.format(g='source', t='documents', f=_FRAC.format(g='source'))}
SELECT doc_id, source, CASE WHEN no <= ceil(0.3 * n) THEN 'test' ELSE 'train' END AS side FROM documents JOIN g ON grp = source""")
def spl_exact_groups(spark, sf_dir):
    """SPL-1 with exact counts: ceil(0.3 x sources) whole sources on the test side."""
    train, test = two_way_split_exact(read_table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 0.3)
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@register("spl_exact_rows", f"""
WITH {_EXACT.format(g='CAST(event_id AS VARCHAR)', t='events', f=_FRAC.format(g='event_id'))}
SELECT CAST(grp AS BIGINT) AS event_id FROM g WHERE no <= ceil(0.15 * n)""")
def spl_exact_rows(spark, sf_dir):
    """SPL-1 by rows with exact counts: the test side has ceil(0.15 x rows) events."""
    return two_way_split_exact(read_table(spark, sf_dir, "events").select("event_id"), "event_id", 0.15)[1]


@register("spl_group_overlap", f"""
SELECT conv_id, count(DISTINCT split) AS n_splits FROM (
  SELECT conv_id, {_split_sql("(CASE WHEN turn = 1 THEN conv_id || 'x' ELSE CAST(conv_id AS VARCHAR) END)")} AS split FROM conversations)
GROUP BY conv_id HAVING count(DISTINCT split) > 1""")
def spl_group_overlap(spark, sf_dir):
    """JON-9: groups in more than one split, on a split that was wrongly made by another key (second turns apart)."""
    key = F.when(F.col("turn") == 1, F.concat(F.col("conv_id").cast("string"), F.lit("x"))).otherwise(F.col("conv_id").cast("string"))
    conv = assign_split(read_table(spark, sf_dir, "conversations").select("conv_id", key.alias("key")), "key")
    return overlapping_groups(conv, "conv_id")


@register("spl_groups_per_split", f"SELECT DISTINCT {_split_sql('source')} AS split, source FROM documents")
def spl_groups_per_split(spark, sf_dir):
    """AGG-11: distinct group ids per split."""
    return groups_per_split(assign_split(read_table(spark, sf_dir, "documents").select("source"), "source"), "source")


@register("spl_filter_language", f"""
SELECT doc_id, lang, split FROM (SELECT doc_id, lang, {_split_sql('source')} AS split FROM documents)
WHERE split <> 'test' OR lang = 'en'""")
def spl_filter_language(spark, sf_dir):
    """FLT-2: keep only English rows inside the test split."""
    docs = assign_split(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "source")
    return filter_language(docs, "en", "test").select("doc_id", "lang", "split")


@register("spl_split_sizes", f"""
SELECT split, count(*) AS n_rows, count(DISTINCT conv_id) AS n_groups
FROM (SELECT conv_id, {_split_sql('conv_id')} AS split FROM conversations) GROUP BY split""")
def spl_split_sizes(spark, sf_dir):
    """SPL-3: the three tables' sizes (rows and groups)."""
    conv = assign_split(read_table(spark, sf_dir, "conversations").select("conv_id"), "conv_id")
    parts = [t.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("conv_id").alias("n_groups")).select(F.lit(name).alias("split"), "*")
             for name, t in split_tables(conv).items()]
    return reduce(lambda a, b: a.unionByName(b), parts).where("n_rows > 0")
