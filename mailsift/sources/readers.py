"""Readers (SRC-1..11) and the text-table loader used by every plan."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailsift.session import table_path

FORMATS = {"json": "json", "parquet": "parquet", "csv": "csv", "tsv": "csv"}


def spread(df: DataFrame, key: str, min_factor: int = 2) -> DataFrame:
    """Hash-distribute rows on ``key`` when the scan gives fewer partitions than cores.

    Text extraction is CPU-bound per row; a single large row group would
    otherwise run in one task. At cluster scale the scan already yields many
    splits and this is a no-op (no shuffle is added)."""
    want = df.sparkSession.sparkContext.defaultParallelism * min_factor
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, key)


def read_text_table(spark: SparkSession, sf_dir: str, name: str, key: str,
                    columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns:
        df = df.select(*columns)
    return spread(df, key)


def _files_by(spark: SparkSession, path: str, mark) -> list[tuple[object, list[str]]]:
    """Files grouped by ``mark`` of their first line that is not blank. Empty files are left out.

    One aggregation over the lines; the driver gets the file names, which it lists for any read anyway."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value",
                                         F.col("_metadata.file_block_start").alias("block"))
    lines = lines.where("block = 0 and trim(value) <> ''").withColumn("line", F.monotonically_increasing_id())
    first = lines.groupBy("file").agg(F.min_by("value", "line").alias("first"))
    rows = first.groupBy(mark(F.col("first")).alias("mark")).agg(F.array_sort(F.collect_list("file")).alias("files"))
    return [(r["mark"], [unquote(f) for f in r["files"]]) for r in sorted(rows.collect(), key=lambda r: str(r["mark"]))]


def read_dataframe(spark: SparkSession, input_path: str, header_names: list[str] | None = None,
                   max_records_per_file: int = -1, header: bool = True, fmt: str | None = None) -> DataFrame:
    """SRC-1/FLT-7/LIM-1: glob read where the extension (or ``fmt``) picks the format; files are
    unioned by column name (a column that a file lacks is NULL for its rows); csv/tsv malformed rows dropped; json
    files hold lines, an array or one record, flattened to dotted columns; optional per-file cap."""
    ext = (fmt or input_path.rsplit(".", 1)[-1]).lower()
    if ext not in FORMATS:
        raise TypeError(f"File extension not supported: {ext}")

    def load(files, **options):
        df = spark.read.format(FORMATS[ext]).options(**options).load(files)
        return cap_per_file(df, max_records_per_file) if max_records_per_file and max_records_per_file > 0 else df

    if ext == "parquet":
        return load(input_path, mergeSchema="true")
    if ext == "json":
        # A first line that is a whole value: a file of lines (or a file of one line).
        groups = _files_by(spark, input_path, lambda line: F.try_parse_json(line).isNull())
        parts = [flatten_struct(load(files, multiLine=str(whole).lower())) for whole, files in groups]
    else:
        # without column pruning, so that a row is malformed or not whatever columns are asked for
        options = {"header": str(header).lower(), "mode": "DROPMALFORMED", "columnPruning": "false", **({"sep": "\t"} if ext == "tsv" else {})}
        if header_names:
            reader = spark.read.format("csv").options(**options).schema(", ".join(f"`{h}` STRING" for h in header_names))
            df = reader.load(input_path)
            return cap_per_file(df, max_records_per_file) if max_records_per_file and max_records_per_file > 0 else df
        if not header:
            return load(input_path, **options)
        parts = [load(files, **options) for _, files in _files_by(spark, input_path, lambda line: line)]
    if not parts:
        return spark.createDataFrame([], "struct<>")
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def cap_per_file(df: DataFrame, n: int) -> DataFrame:
    """Keep the first ``n`` rows of every input file, by quotas of its splits.

    The rows of a split have consecutive row ids. A count by split and prefix sums over a file's splits (a row for each
    split, at most the file size over the split size) say which splits lie within the first ``n`` rows and up to which id;
    rows are then only compared with their split's last id, so no task holds a file. ``df`` must be a plain scan."""
    rows = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
                     F.monotonically_increasing_id().alias("_r"))
    splits = rows.groupBy(F.col("_f").alias("_sf"), F.col("_b").alias("_sb")).agg(F.count(F.lit(1)).alias("_k"), F.min("_r").alias("_first"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy("_sf").orderBy("_sb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quotas = splits.withColumn("_before", before).where(F.col("_before") < n)
    quotas = quotas.select("_sf", "_sb", (F.col("_first") + n - F.col("_before")).alias("_stop"))
    kept = rows.join(quotas, (F.col("_f") == F.col("_sf")) & (F.col("_b") == F.col("_sb"))).where("_r < _stop")
    return kept.select(*df.columns)


def read_parquet_dataset(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """SRC-3: parquet directory; in strict mode any other file raises. Files are never deleted."""
    if strict:
        # Only the names are read; names that start with "_" or "." are not data.
        other = spark.read.format("binaryFile").load(path).where("path not like '%.parquet'").select("path").first()
        if other:
            raise TypeError(f"not a parquet file: {other.path}")
    return spark.read.option("pathGlobFilter", "*.parquet").parquet(path)


def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """SRC-2: nested struct fields become dotted top-level columns; arrays untouched."""
    def walk(schema, prefix):
        cols = []
        for f in schema.fields:
            name = f"{prefix}{f.name}"
            if f.dataType.typeName() == "struct":
                cols += walk(f.dataType, name + ".")
            else:
                path = ".".join(f"`{p}`" for p in name.split("."))
                cols.append(F.col(path).alias(name.replace(".", sep)))
        return cols
    return df.select(*walk(df.schema, ""))


def read_json_flat(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2: multi-line JSON file to one flat table."""
    return flatten_struct(spark.read.option("multiLine", "true").json(path))


def read_text_articles(spark: SparkSession, glob_path: str) -> DataFrame:
    """SRC-4: ``<number>_<title>.txt`` articles -> title/author/date/text; failures leave NULL."""
    # text() takes wholetext as its own argument (an .option() would be overridden)
    raw = spark.read.text(glob_path, wholetext=True).select(
        F.col("value").alias("content"), F.url_decode(F.col("_metadata.file_name")).alias("file_name"))
    return parse_articles(raw)


def parse_articles(raw: DataFrame, content: str = "content", file_name: str = "file_name") -> DataFrame:
    """Article parsing as Column expressions (shared by the file reader and table stand-ins)."""
    stem = F.regexp_replace(F.col(file_name), r"\.[^.]*$", "")
    stem_parts = F.split(stem, "_", -1)
    title_from_name = F.when(F.size(stem_parts) > 1, F.element_at(stem_parts, 2)).otherwise(stem)
    c = F.col(content)

    def strip(x):
        return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")

    sep_at = F.instr(c, "--")
    body = F.when(sep_at > 0, F.expr(f"substring({content}, instr({content}, '--') + 2)")).otherwise(F.lit(""))
    head = F.substring_index(c, "--", 1)
    by_parts = F.split(head, "\n\nBy", -1)
    byline = F.try_element_at(by_parts, F.lit(2))
    paren = F.instr(byline, "(")
    after_paren = F.expr("substring(_byline, instr(_byline, '(') + 1)")
    out = raw.withColumn("_byline", byline)
    return out.select(
        *raw.columns,
        title_from_name.alias("file_title"),
        strip(body).alias("text"),
        strip(F.element_at(by_parts, 1)).alias("title"),
        strip(F.substring_index(F.col("_byline"), "(", 1)).alias("author"),
        F.when(paren > 0, strip(F.substring_index(after_paren, ")", 1))).alias("published_date"),
    )
