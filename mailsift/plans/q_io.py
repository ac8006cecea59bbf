"""Registered queries: readers and writers (SRC-1..4, SRC-9, SRC-10, SNK-1..3).

Round trips write into fresh folders under the shared checkpoint location
(``spark.checkpoint.dir``), never into a machine-local temporary folder.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from mailsift.operators.split import assign_split, write_splits
from mailsift.plans.registry import register
from mailsift.session import read_table
from mailsift.sources.readers import flatten_struct, parse_articles, read_dataframe, read_parquet_dataset
from mailsift.sources.writers import (dataset_to_table, message_bodies, read_prompt_library, reconstruct, save_results, scratch_path,
                                      write_dataframe)

ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
ORDER_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
               "o_totalprice": "double", "o_orderpriority": "string"}


def _typed(df):
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in ORDER_TYPES.items()])


def _orders_roundtrip(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select(*ORDER_COLS)
    done = F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))
    # The second file of a format has its columns in another order, and one more.
    halves = [orders.where(done), orders.where(~done).select(F.lit("x").alias("extra"), *reversed(ORDER_COLS))]
    base = scratch_path(spark, "src1")
    for df in halves:
        write_dataframe(df, os.path.join(base, "o.csv"), mode="append")
        df.write.mode("append").option("header", "true").option("sep", "\t").csv(os.path.join(base, "o_tsv"))
        df.write.mode("append").json(os.path.join(base, "o_json"))
        write_dataframe(df, os.path.join(base, "o.parquet"), mode="append")
    reads = {
        "csv": read_dataframe(spark, os.path.join(base, "o.csv", "*.csv")),
        "tsv": read_dataframe(spark, os.path.join(base, "o_tsv", "*.csv"), fmt="tsv"),
        "json": read_dataframe(spark, os.path.join(base, "o_json", "*.json")),
        "parquet": read_dataframe(spark, os.path.join(base, "o.parquet", "*.parquet")),
    }
    return base, reads


@register("src_multiformat_roundtrip", f"""
SELECT {', '.join(ORDER_COLS)}, fmt FROM orders, (SELECT unnest(['csv', 'tsv', 'json', 'parquet']) AS fmt) f""")
def src_multiformat_roundtrip(spark, sf_dir):
    """SRC-1 + SNK-1: orders written as csv/tsv/json/parquet (files whose columns differ in order and
    number), read back by extension/format and unioned by column name."""
    _, reads = _orders_roundtrip(spark, sf_dir)
    out = None
    for fmt, df in reads.items():
        part = _typed(df).withColumn("fmt", F.lit(fmt))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


CAP = 500


@register("src_per_file_cap", f"""
SELECT {', '.join(ORDER_COLS)} FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS no FROM orders) WHERE no <= {CAP}""")
def src_per_file_cap(spark, sf_dir):
    """SRC-1/LIM-1/FLT-7: the first 500 rows of every csv file; each priority has a file of its own, sorted by key."""
    path = scratch_path(spark, "src-cap")
    orders = read_table(spark, sf_dir, "orders").select(*ORDER_COLS, F.col("o_orderpriority").alias("f"))
    orders.repartition("f").sortWithinPartitions("f", "o_orderkey").write.partitionBy("f").option("header", "true").csv(path)
    return _typed(read_dataframe(spark, os.path.join(path, "*", "*.csv"), max_records_per_file=CAP))


@register("src_json_flatten", """
SELECT event_id, user_id AS "meta.user_id", event_type AS "meta.event_type", value AS "meta.value" FROM events""")
def src_json_flatten(spark, sf_dir):
    """SRC-2: nested JSON records read back as one flat table with dotted column names."""
    ev = read_table(spark, sf_dir, "events")
    path = scratch_path(spark, "src2")
    ev.select("event_id", F.struct("user_id", "event_type", "value").alias("meta")).write.json(path)
    return flatten_struct(spark.read.schema("event_id long, meta struct<user_id:long,event_type:string,value:double>")
                          .json(path))


@register("src_parquet_dataset", "SELECT doc_id, lang, source FROM documents")
def src_parquet_dataset(spark, sf_dir):
    """SRC-3: strict parquet folder read (a non-parquet data file would raise; nothing is deleted)."""
    path = scratch_path(spark, "src3")
    read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source").write.parquet(path)
    return read_parquet_dataset(spark, path, strict=True)


_WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x):
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


@register("src_text_articles", f"""
WITH a AS (SELECT doc_id,
   CASE WHEN lang = 'es' THEN source || '.txt' ELSE CAST(doc_id AS VARCHAR) || '_' || source || '.txt' END AS file_name,
   CASE WHEN lang = 'de' THEN text ELSE 'Title ' || CAST(doc_id AS VARCHAR) || chr(10) || chr(10) || 'By ' || source ||
        CASE WHEN lang = 'fr' THEN '' ELSE ' (' || lang || ')' END || ' -- ' || text END AS content FROM documents),
b AS (SELECT *, strpos(content, '--') AS sep, regexp_replace(file_name, '\\.[^.]*$', '') AS stem FROM a),
c AS (SELECT *, CASE WHEN sep > 0 THEN substr(content, 1, sep - 1) ELSE content END AS head,
             CASE WHEN sep > 0 THEN substr(content, sep + 2) ELSE '' END AS body FROM b),
d AS (SELECT *, string_split(head, chr(10) || chr(10) || 'By') AS byp FROM c)
SELECT doc_id, CASE WHEN len(string_split(stem, '_')) > 1 THEN string_split(stem, '_')[2] ELSE stem END AS file_title,
       {_strip('body')} AS text, {_strip('byp[1]')} AS title,
       CASE WHEN len(byp) > 1 THEN {_strip("split_part(byp[2], '(', 1)")} END AS author,
       CASE WHEN len(byp) > 1 AND strpos(byp[2], '(') > 0
            THEN {_strip("split_part(substr(byp[2], strpos(byp[2], '(') + 1), ')', 1)")} END AS published_date
FROM d""")
def src_text_articles(spark, sf_dir):
    """SRC-4: article parsing (title / author / date / text; file title from the name) on articles
    built from documents, including rows without '--', without '(' and without '_'."""
    docs = read_table(spark, sf_dir, "documents")
    file_name = F.when(F.col("lang") == "es", F.concat("source", F.lit(".txt"))).otherwise(
        F.concat(F.col("doc_id").cast("string"), F.lit("_"), "source", F.lit(".txt")))
    content = F.when(F.col("lang") == "de", F.col("text")).otherwise(F.concat(
        F.lit("Title "), F.col("doc_id").cast("string"), F.lit("\n\nBy "), F.col("source"),
        F.when(F.col("lang") == "fr", F.lit("")).otherwise(F.concat(F.lit(" ("), F.col("lang"), F.lit(")"))),
        F.lit(" -- "), F.col("text")))
    raw = docs.select("doc_id", content.alias("content"), file_name.alias("file_name"))
    return parse_articles(raw).select("doc_id", "file_title", "text", "title", "author", "published_date")


@register("src_eml_bodies", """
SELECT conv_id, turn, text AS body FROM conversations""")
def src_eml_bodies(spark, sf_dir):
    """SRC-9: raw messages built from conversations (plain, base64, quoted-printable and multipart by turn) -> bodies."""
    conv = read_table(spark, sf_dir, "conversations")
    packed = F.base64(F.encode("text", "UTF-8"))
    kinds = [F.concat(F.lit("\r\n"), "text"),
             F.concat(F.lit("Content-Transfer-Encoding: base64\r\n\r\n"), packed),
             F.concat(F.lit("Content-Transfer-Encoding: quoted-printable\r\n\r\n"), F.replace(F.col("text"), F.lit("="), F.lit("=3D"))),
             F.concat(F.lit("Content-Type: multipart/mixed; boundary=\"=b=\"\r\n\r\n--=b=\r\nContent-Transfer-Encoding: base64\r\n\r\n"),
                      packed, F.lit("\r\n--=b=\r\n\r\nnext part\r\n--=b=--\r\n"))]
    raw = F.concat(F.lit("From: "), F.coalesce("role", F.lit("")), F.lit("@example.org\r\nSubject: turn\r\n"),
                   F.get(F.array(*kinds), F.coalesce(F.pmod("turn", F.lit(4)), F.lit(0)).cast("int")))
    return message_bodies(conv.select("conv_id", "turn", raw.alias("raw"))).drop("raw")


@register("src_split_table", "SELECT text AS tokens, role AS ner_tags FROM conversations")
def src_split_table(spark, sf_dir):
    """SRC-10: split rows (Text, Labels) renamed to (tokens, ner_tags)."""
    conv = read_table(spark, sf_dir, "conversations")
    return dataset_to_table(conv.select(F.col("text").alias("Text"), F.col("role").alias("Labels")))


_SPLIT = "CASE WHEN f < 0.1 THEN 'test' WHEN f < 0.2 THEN 'validation' ELSE 'train' END"


@register("snk_split_folders", f"""
SELECT split, count(*) AS n_rows FROM (
  SELECT {_SPLIT} AS split FROM (SELECT CAST(('0x' || substr(md5('42:' || CAST(conv_id AS VARCHAR)), 1, 8)) AS BIGINT)
                                        / 4294967296.0 AS f FROM conversations)) GROUP BY split""")
def snk_split_folders(spark, sf_dir):
    """SNK-2: conversations written as one parquet folder per split and read back."""
    conv = assign_split(read_table(spark, sf_dir, "conversations"), "conv_id")
    path = scratch_path(spark, "snk2")
    write_splits(conv, path)
    back = spark.read.parquet(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


@register("src_prompt_library", """
SELECT r_name AS name, 'Find ' || r_name AS task, count(n_name) AS n_fields, string_agg(n_name, ',' ORDER BY n_name) AS fields
FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""")
def src_prompt_library(spark, sf_dir):
    """SRC-11: one prompt file for each region (its nations are the fields), written and read as a library."""
    t = read_table(spark, sf_dir, "region").join(read_table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    prompts = t.groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("FIELDS"))
    folder = scratch_path(spark, "prompts")
    for name in [r.r_name for r in read_table(spark, sf_dir, "region").select("r_name").collect()]:  # the regions
        one = prompts.where(F.col("r_name") == name).select(F.concat(F.lit("Find "), "r_name").alias("TASK"), "FIELDS")
        one.coalesce(1).write.json(os.path.join(folder, f"{name}_prompt.json"))
    lib = read_prompt_library(spark, folder)
    return lib.select("name", F.col("prompt.TASK").alias("task"), F.size("prompt.FIELDS").cast("long").alias("n_fields"), F.array_join("prompt.FIELDS", ",").alias("fields"))


@register("udf_reconstruct_lines", """
SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS line_no, lines[i] AS line FROM (
  SELECT conv_id, turn, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS lines FROM conversations))""")
def udf_reconstruct_lines(spark, sf_dir):
    """UDF-5: a per-row callback that takes each turn apart into lines."""
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return reconstruct(conv, _lines, "conv_id long, turn long, line_no int, line string")


def _lines(row: dict):
    return [(row["conv_id"], row["turn"], k, x) for k, x in enumerate((row["text"] or "").split("\n"))] if row["text"] is not None else []


STAMP = "2024_01_01_00_00"


@register("snk_results_files", f"""
SELECT 'predictions_signature_en_{STAMP}.csv' AS file, count(*) AS n_rows, CAST(sum(event_id) AS BIGINT) AS total FROM events WHERE event_type <> 'error'
UNION ALL SELECT 'errors_predictions_signature_en_{STAMP}.csv', count(*), CAST(sum(event_id) AS BIGINT) FROM events WHERE event_type = 'error'
UNION ALL SELECT 'performances_signature_en_{STAMP}.csv', count(*), CAST(sum(n) AS BIGINT) FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""")
def snk_results_files(spark, sf_dir):
    """SNK-3: predictions / errors / performances csv files stamped with endpoint, language and minute (a fixed one here),
    read back and summed up."""
    ev = read_table(spark, sf_dir, "events")
    preds = ev.where(F.col("event_type") != "error").select("event_id", "event_type")
    errs = ev.where(F.col("event_type") == "error").select("event_id", "props")
    perf = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    folder = scratch_path(spark, "snk3")
    paths = save_results(preds, errs, perf, "signature", folder, "en", STAMP)
    out = None
    for kind, p in paths.items():
        value = F.col("n" if kind == "performances" else "event_id").cast("long")
        part = spark.read.option("header", "true").csv(p).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(value).alias("total")) \
            .withColumn("file", F.lit(os.path.basename(p)))
        out = part if out is None else out.unionByName(part)
    return out
