"""Writers (SNK-1..3) and raw-message ingest (SRC-9, SRC-10, SRC-11)."""

from __future__ import annotations

import os
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mailsift.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint location."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def write_dataframe(df: DataFrame, output_path: str, mode: str = "overwrite") -> tuple[str, str]:
    """SNK-1: csv (with header) or parquet chosen by extension; anything else is an error.
    Returns the path and its media type (no index column is written)."""
    ext = output_path.rsplit(".", 1)[-1].lower()
    if ext == "csv":
        df.write.mode(mode).option("header", "true").csv(output_path)
        return output_path, "text/csv"
    if ext == "parquet":
        df.write.mode(mode).parquet(output_path)
        return output_path, "application/octet-stream"
    raise ValueError("output_file_name must be csv or parquet")


def save_results(predictions: DataFrame, errors: DataFrame, performances: DataFrame, api_name: str,
                 output_folder: str, language: str, stamp: str) -> dict[str, str]:
    """SNK-3: three csv outputs stamped with endpoint, language and one minute stamp."""
    out = {}
    for kind, df in [("predictions", predictions), ("errors_predictions", errors), ("performances", performances)]:
        path = os.path.join(output_folder, f"{kind}_{api_name}_{language}_{stamp}.csv")
        df.write.mode("overwrite").option("header", "true").csv(path)
        out[kind] = path
    return out


# ------------------------------------------------------------------------------ SRC-9
def _decoded_body(raw: pd.Series) -> pd.Series:
    """First part that is no container, decoded (stdlib parser, Arrow batches)."""
    import email

    def first_text(s):
        for part in email.message_from_bytes(s.encode()).walk():
            if not part.is_multipart():
                return (part.get_payload(decode=True) or b"").decode("utf-8", "ignore")
        return ""
    return raw.map(first_text)


def message_bodies(df: DataFrame, raw_col: str = "raw", name: str = "body") -> DataFrame:
    """SRC-9: ``df`` with the body of its raw RFC-822 messages as the last column. Plain messages are cut at the first blank line
    in the JVM; only multipart and encoded messages are filtered out to the Python parser. Null messages have a null body."""
    raw = F.col(raw_col)
    head = F.regexp_extract(raw, r"\A(?:\r?\n|((?s:.*?))(?:\r?\n\r?\n|\z))", 1)
    encoded = F.coalesce(head.rlike(r"(?im)^content-type:\s*multipart/|^content-transfer-encoding:\s*(base64|quoted-printable|(x-)?uue)"),
                         F.lit(False))
    plain = df.where(~encoded).withColumn(name, F.regexp_extract(raw, r"\A(?:\r?\n|(?s:.*?)\r?\n\r?\n)((?s:.*))\z", 1))
    parsed = df.where(encoded).withColumn(name, F.pandas_udf(_decoded_body, "string")(raw))
    return plain.unionByName(parsed)


# ------------------------------------------------------------------------------ SRC-10 / SRC-11
def dataset_to_table(df: DataFrame) -> DataFrame:
    """SRC-10: split rows with ``Text``/``Labels`` become ``tokens``/``ner_tags``."""
    return df.withColumnRenamed("Text", "tokens").withColumnRenamed("Labels", "ner_tags").select("tokens", "ner_tags")


def read_prompt_library(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-11: ``*_prompt.json`` files (or folders of part files) -> ``(name, prompt)`` with name = what stands before ``_prompt``."""
    df = spark.read.option("multiLine", "true").json(os.path.join(folder, "*_prompt.json"))
    name = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), r"([^/]*?)_prompt[^/]*\.json(?:/[^/]*)?$", 1)
    return df.select(name.alias("name"), F.struct(*[F.col(c) for c in df.columns]).alias("prompt"))


def reconstruct(df: DataFrame, fn, schema: str) -> DataFrame:
    """UDF-5: a per-row reconstruction callback ``fn(row as dict) -> iterable of tuples``; the tuples of all rows are the
    result's rows, in one Arrow pass of small batches."""
    fields = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, 200):
                rows = [tuple(x) for row in whole.slice(low, 200).to_pylist() for x in fn(row)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
    return df.mapInArrow(run, fields)
