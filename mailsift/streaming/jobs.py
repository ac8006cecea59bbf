"""Structured Streaming forms (STR-1..3).

* ``start_parse_stream`` runs the body pipeline for every micro-batch of mails,
  with an output folder for each batch, so a repeated batch replaces itself.
* ``parse_rows`` is a per-row (stateless) plan without models: clean, extract
  pattern entities and build the nested response inside each row.
* ``windowed_counts`` are the service counters per tumbling window with a
  watermark for late data, written in append mode.
* ``capture_errors`` replaces per-request HTTP errors with an ``error``
  column; failing rows are routed to an errors table.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.functions.text import clean_mail_text, map_language
from mailsift.operators.extract import regex_entity_array
from mailsift.operators.parse import parse_bodies
from mailsift.operators.response import signature_fields
from mailsift.sources.readers import spread


def parse_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """STR-1 body: ``(id, language, block, parseStatusType, signatureFields)`` per row."""
    cleaned = clean_mail_text(F.col(text_col))
    x = df.select(id_col, *([map_language(lang_col).alias("language")] if lang_col else []),
                  cleaned.alias("block"))
    ents = F.transform(regex_entity_array(F.col("block")), lambda e, i: F.struct(
        i.alias("seq"), e["entity"].alias("entity"), e["name"].alias("name")))
    # materialise the entity array once: every response field filters it
    x = x.withColumn("_ents", ents)
    empty = F.length("block") == 0
    return x.select(*[c for c in x.columns if c != "_ents"],
                    F.when(empty, F.lit("NO_SIGNATURE_BLOCK")).otherwise(F.lit("SUCCESS")).alias("parseStatusType"),
                    F.when(~empty, signature_fields(F.col("_ents"))).alias("signatureFields"))


def start_parse_stream(mails: DataFrame, gazetteer: DataFrame, output_path: str, checkpoint_path: str, available_now: bool = True,
                       id_col: str = "doc_id", **options):
    """STR-1: the whole body pipeline (``parse.parse_bodies``) on a stream of mails, the gazetteer as its static side.

    Every micro-batch overwrites its own folder ``batch=<id>``: a batch that is run again after a failure replaces what it
    had written, so the output holds each mail once. ``read_parsed`` reads it. ``options`` go to ``parse_bodies``. A batch of
    few files is spread over the cores."""
    def write(batch: DataFrame, number: int) -> None:
        parse_bodies(spread(batch, id_col), gazetteer, id_col, **options).write.mode("overwrite").parquet(os.path.join(output_path, f"batch={number}"))

    w = mails.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_path).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()


def read_parsed(spark: SparkSession, output_path: str) -> DataFrame:
    """The responses that a parse stream has written so far."""
    return spark.read.option("basePath", output_path).parquet(os.path.join(output_path, "batch=*")).drop("batch")


def windowed_counts(events: DataFrame, ts_col: str, key_col: str, window: str = "1 hour",
                    watermark: str = "2 hours") -> DataFrame:
    """STR-2: counts (and value sums) per tumbling window and key with a watermark."""
    # Watermarks need TIMESTAMP. A TIMESTAMP_NTZ event time is read as a UTC instant through its
    # epoch microseconds, and the window start is printed back through NTZ, so neither step
    # depends on the session time zone.
    ts = F.col(ts_col)
    if events.schema[ts_col].dataType.typeName() == "timestamp_ntz":
        ts = F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts_col}`)"))
    e = events.withColumn("_ts", ts).withWatermark("_ts", watermark)
    g = e.groupBy(F.window("_ts", window).alias("w"), F.col(key_col)).agg(F.count(F.lit(1)).alias("n"))
    start = F.expr("timestampadd(SECOND, unix_seconds(w.start), TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return g.select(F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("window_start"), key_col, "n")


def start_windowed_counts(events_stream: DataFrame, output_path: str, checkpoint_path: str, ts_col: str = "ts",
                          key_col: str = "event_type", available_now: bool = True, **options):
    """STR-2 to files in append mode: a window is written once, when the watermark has passed its end; its state is then
    dropped, and rows that come later than that are left out."""
    w = (windowed_counts(events_stream, ts_col, key_col, **options).writeStream.format("parquet").option("path", output_path)
         .outputMode("append").option("checkpointLocation", checkpoint_path))
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()


def capture_errors(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """STR-3: ``error`` = message of the first failing check (NULL when the row is fine)."""
    err = F.lit(None).cast("string")
    for msg, ok in reversed(checks):
        err = F.when(~F.coalesce(ok, F.lit(False)), F.lit(msg)).otherwise(err)
    return df.withColumn("error", err)


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("error").isNull()).drop("error"), df.where(F.col("error").isNotNull())
