"""Registered queries: streaming forms (STR-1..3) and the prompt builder (FN-3, FN-4)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from mailsift.functions.prompts import build_prompt, prompt_keys
from mailsift.operators.response import response_to_long
from mailsift.plans import sqlkit as K
from mailsift.plans.q_extract import _entities_sql
from mailsift.plans.q_gazetteer import gazetteer_df
from mailsift.plans.q_signature import _BODIES, _page_mails, _resp_long_sql
from mailsift.plans.registry import register
from mailsift.session import read_table
from mailsift.sources.writers import scratch_path
from mailsift.streaming.jobs import capture_errors, parse_rows, read_parsed, start_parse_stream, start_windowed_counts


@register("str_window_counts", """
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n
FROM events GROUP BY 1, 2""")
def str_window_counts(spark, sf_dir):
    """STR-2: events read as a stream (availableNow), hourly counts per type in append mode. A last event far ahead moves the
    watermark past every window; its own window stays open."""
    events = read_table(spark, sf_dir, "events")
    base = scratch_path(spark, "str2")
    path = {k: os.path.join(base, k) for k in ("in", "out", "checkpoint")}
    last = events.limit(1).withColumn("ts", F.expr("make_timestamp_ntz(9999, 1, 1, 0, 0, 0)")).withColumn("event_type", F.lit("end"))
    for df in (events, last):
        df.write.mode("append").parquet(path["in"])
        stream = spark.readStream.schema(events.schema).parquet(path["in"])
        start_windowed_counts(stream, path["out"], path["checkpoint"]).awaitTermination()
    return spark.read.parquet(path["out"]).where("event_type <> 'end'")


@register("str_parse_bodies", _resp_long_sql(_BODIES, ents="fin", docs="sigs"))
def str_parse_bodies(spark, sf_dir):
    """STR-1: mails arriving as files in several micro-batches, parsed by the whole body pipeline; the output equals the batch
    query's (``rsp_parse_bodies_long``)."""
    base = scratch_path(spark, "str1")
    mails = _page_mails(spark, sf_dir)
    mails.repartition(3, "doc_id").write.parquet(os.path.join(base, "in"))
    stream = spark.readStream.schema(mails.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(base, "in"))
    start_parse_stream(stream, gazetteer_df(spark), os.path.join(base, "out"), os.path.join(base, "checkpoint"), meta_col="meta").awaitTermination()
    return response_to_long(read_parsed(spark, os.path.join(base, "out")))


@register("str_parse_rows", f"""
WITH ents AS ({_entities_sql('documents', 'doc_id', 'text')})
SELECT d.doc_id, count(e.doc_id) AS n_entities FROM documents d LEFT JOIN ents e ON d.doc_id = e.doc_id GROUP BY d.doc_id""")
def str_parse_rows(spark, sf_dir):
    """STR-1 body on the batch table: per-row cleaned block + in-row response (documents have no
    markup, so cleaning leaves the entities unchanged); entity count per document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    parsed = parse_rows(docs)
    long = response_to_long(parsed)
    per = long.where((F.col("name") != "") & F.col("entity").isin("EMAIL", "URL")).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"))
    return parsed.select("doc_id").join(per, "doc_id", "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_entities"))


@register("str_error_capture", """
SELECT event_id, CASE WHEN try_cast(json_extract_string(props, '$.k') AS INTEGER) IS NULL THEN 'props.k missing'
                      WHEN value < 0 THEN 'negative value' END AS error
FROM events""")
def str_error_capture(spark, sf_dir):
    """STR-3: per-row error capture (invalid JSON field, negative value) instead of failing."""
    ev = read_table(spark, sf_dir, "events")
    checks = [("props.k missing", F.get_json_object("props", "$.k").try_cast("int").isNotNull()),
              ("negative value", F.col("value") >= 0)]
    return capture_errors(ev, checks).select("event_id", "error")


# ------------------------------------------------------------------------------ prompts (FN-3/4)
# Fixture prompt set (our own values): two examples for one field.
PROMPT_TASK = "Extract the sender e-mail address."
PROMPT_FIELDS = ["email"]
PROMPT_EXAMPLES = [("Best regards, Ann (ann@example.org)", {"email": "ann@example.org"}),
                   ("Thanks! Bo", {})]


def _examples_col():
    return F.array(*[F.struct(F.lit(t).alias("TEXT"),
                              F.create_map(*[F.lit(x) for kv in v.items() for x in kv]).cast("map<string,string>")
                              .alias("VALUES")) for t, v in PROMPT_EXAMPLES])


def _prompt_sql() -> str:
    head = f"'{{task}}: ' || {K.q(PROMPT_TASK)} || ' ' || chr(10) || chr(10) || '{{ex}}: ' || chr(10) || chr(10)"
    parts = []
    for t, v in PROMPT_EXAMPLES:
        lines = " || ".join(f"'[{f}]: ' || {K.q(v.get(f, ''))} || chr(10)" for f in PROMPT_FIELDS)
        parts.append(f"'{{text}}: ' || {K.q(t)} || ' ' || chr(10) || chr(10) || {lines}")
    body = head + " || " + " || ".join(parts) + " || '{text}: ' || text"
    en = body.replace("{task}", "TASK").replace("{ex}", "EXAMPLES").replace("{text}", "TEXT")
    zh = body.replace("{task}", "任务").replace("{ex}", "例子").replace("{text}", "文本")
    return f"SELECT doc_id, CASE WHEN lang = 'zhs' THEN {zh} ELSE {en} END AS prompt FROM documents"


@register("fn_prompts", _prompt_sql())
def fn_prompts(spark, sf_dir):
    """FN-3/FN-4: a few-shot prompt for every document (fixed prompt set, per-language labels)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    fields = F.array(*[F.lit(f) for f in PROMPT_FIELDS])
    return docs.select("doc_id", build_prompt(F.lit(PROMPT_TASK), fields, _examples_col(), F.col("text"),
                                              prompt_keys(F.col("lang"))).alias("prompt"))
