"""The pipeline's stages against plain statements on the smallest table."""

import brute
import corpus_pipeline
from llm_rows import SF001
from mailsift.llm import decontaminate, quality_rules


def test_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    out = corpus_pipeline.run(spark, SF001).collect()
    clean = {r.doc_id: quality_rules.judge(r.text) for r in docs.collect()}
    rows = [(d, j[8]) for d, j in clean.items() if j[6]]
    assert all(r.decodes_to_text and r.doc_id in dict(rows) for r in out)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute.op1(rows, items) if r[5]}
    assert bad and not bad & {r.doc_id for r in out}
    stages = dict(corpus_pipeline.STAGES)
    near = stages["MinHash near-duplicates"](spark, spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x")], "doc_id long, text string"), SF001)
    assert sorted(r.doc_id for r in near.collect()) == [1, 3] and decontaminate.WINDOW == 10
