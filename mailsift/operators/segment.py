"""Sentences, tokens and packing (SEG-1..9, FLT-4, FLT-8, RSH-7).

Sentence and token boundaries come from two portable patterns (settings):
a token is a word run or a single symbol; a sentence starts at a non-blank
character and runs to the next terminator run or line break. Inference windows are cut
in one Arrow pass, linear in the text; the training packer is a left fold
(``aggregate``) over per-sentence *lengths*, and token text is sliced out
afterwards. Everything runs inside the row: no shuffle for per-document
segmentation; one shuffle on the mail id for labelled blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift import settings as S
from mailsift.operators.quality import drop_then_dropna

UNITS = "array<struct<n:int,start:int,end:int>>"
RANGE_STATE = "array<struct<a:int,b:int>>"
_TOKENS = regex.compile(S.TOKEN_PATTERN).findall
_TOKEN_AT = regex.compile(S.TOKEN_PATTERN).finditer
# Kind of every character: 1 in a word run, 2 a symbol, 0 between tokens
_KIND = np.full(0x110000, 2, np.uint8)
for _run in regex.compile(S.WORD_PATTERN).finditer("".join(map(chr, range(0x110000)))):
    _KIND[_run.start():_run.end()] = 1
_KIND[[ord(c) for c in " \t\n\r\f"]] = 0
_SENTENCES = re.compile(S.SENTENCE_PATTERN).finditer
ROWS_KEPT = 20_000


def tokens(text: Column, pattern: str = S.TOKEN_PATTERN) -> Column:
    """UDF-2/UDF-3 default: word runs and single symbols (JVM-side). A sub-word tokenizer can be
    plugged with :func:`tokenizer_hook`."""
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def tokenizer_hook(fn) -> "Column-function":
    """UDF-3 hook: wrap ``fn(list[str]) -> list[list[str]]`` (e.g. a sub-word tokenizer loaded once
    per worker) as an Arrow-batched pandas UDF returning ``array<string>``."""
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(fn(s.fillna("").tolist()))
    udf = F.pandas_udf(run, "array<string>")
    return lambda col: udf(col)


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def sentence_hook(fn) -> "Column-function":
    """UDF-2 hook: ``fn(list[str]) -> list[list[str]]`` sentence splitter per language model,
    run Arrow-batched; the native default is :data:`settings.SENTENCE_PATTERN`."""
    return tokenizer_hook(fn)


def chunk_list(arr: Column, limit) -> Column:
    """SEG-1: fixed-size chunks of a list (last chunk may be short); ``limit`` int or Column."""
    lim = _lit(limit)
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(arr) - 1, F.lit(0)), lim),
                       lambda i: F.slice(arr, i + 1, lim))


def _kinds(text: str) -> np.ndarray:
    return _KIND[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _runs(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return edge[::2].tolist(), edge[1::2].tolist()


def word_runs(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of the word runs of a text."""
    return _runs(_kinds(text) == 1)


def blank_separated(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs ``[^ \\t\\n\\r\\f]+`` of a text."""
    return _runs(_kinds(text) != 0)


def text_units(text: str, limit: int) -> Iterator[tuple[int, int, int]]:
    """SEG-2: ``(n, start, end)`` of each sentence: its tokens and offsets; a sentence over ``limit`` tokens is cut into
    chunks of ``limit`` tokens, each with its own offsets (first token start .. last token end)."""
    places = [m.span() for m in _SENTENCES(text)]
    if not places:
        return
    kind = _kinds(text)
    begins = kind != 0
    begins[1:] &= (kind[1:] == 2) | (kind[:-1] != 1)
    before = np.concatenate(([0], np.cumsum(begins)))   # tokens that begin before an offset; no sentence begins or ends inside a word run
    at = before[np.array(places)]
    for (start, end), n in zip(places, (at[:, 1] - at[:, 0]).tolist()):
        if n <= limit:
            yield n, start, start + len(text[start:end].rstrip(" \t\f")) if text[end - 1] in " \t\f" else end
            continue
        tokens_at = [t.span() for t in _TOKEN_AT(text[start:end])]
        for low in range(0, n, limit):
            chunk = tokens_at[low:low + limit]
            yield len(chunk), start + chunk[0][0], start + chunk[-1][1]


def packed(units, limit: int) -> list[tuple[int, int, int]]:
    """SEG-3: greedy packing of ``(n, start, end)`` without overlap; the first segment starts at 0; no sentence -> one empty
    segment."""
    out, cn, cs, ce = [], 0, 0, 0
    for n, start, end in units:
        if cn + n > limit:
            out.append((cn, cs, ce))
            cn, cs = 0, start
        cn, ce = cn + n, end
    out.append((cn, cs, ce))
    return out


def _unit_lists(rows: list[list[tuple[int, int, int]]]) -> pa.Array:
    return pa.array([[{"n": n, "start": s, "end": e} for n, s, e in r] for r in rows],
                    pa.list_(pa.struct([("n", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])))


def sentence_units(text: Column, limit: int) -> Column:
    """:func:`text_units` as a column ``array<struct<n,start,end>>``; a null text has none."""
    def run(texts: pa.Array) -> pa.Array:
        return _unit_lists([list(text_units(t or "", limit)) for t in texts.to_pylist()])
    return F.arrow_udf(run, UNITS)(text)


def pack_greedy(units: Column, limit: int) -> Column:
    """:func:`packed` as a column ``array<struct<n,start,end>>``."""
    def run(rows: pa.Array) -> pa.Array:
        return _unit_lists([packed([(u["n"], u["start"], u["end"]) for u in r or ()], limit) for r in rows.to_pylist()])
    return F.arrow_udf(run, UNITS)(units)


def inference_segments(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       limit: int = S.INFERENCE_TOKEN_LIMIT) -> DataFrame:
    """SEG-3 as a table: ``(id, segment_no, n_tokens, start, end, text)``; text = text[start:end]. A null text has one empty
    segment whose text is null."""
    names = [id_col, "segment_no", "n_tokens", "start", "end", "text"]
    x = df.select(id_col, text_col)
    schema = T.StructType([x.schema[0], *T.StructType.fromDDL("segment_no int, n_tokens int, start int, end int, text string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []

            def close():
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] * 4 + [pa.string()])]
                out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *columns], names=names)
                at.clear()
                rows.clear()
                return out

            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                for no, (n, start, end) in enumerate(packed(text_units(text or "", limit), limit)):
                    at.append(i)
                    rows.append((no, n, start, end, None if text is None else text[start:end]))
                    if len(rows) >= ROWS_KEPT:
                        yield close()
            if rows:
                yield close()

    return x.mapInArrow(run, schema)


# --------------------------------------------------------------------------- labelled blocks
def sentence_tokens(text: Column, limit) -> Column:
    """SEG-4 core: ``array<array<string>>`` sentence token lists, long sentences chunked."""
    sents = F.regexp_extract_all(text, F.lit(S.SENTENCE_PATTERN), 0)
    return F.flatten(F.transform(sents, lambda s: chunk_list(tokens(s), limit)))


def hooked_tokens(splitter=None, tokenizer=None):
    """UDF-2/UDF-3: a column function ``text -> array<array<string>>`` of the sentences' tokens. ``splitter`` and ``tokenizer`` map
    a list of texts to a list of lists of strings (the patterns by default); one Arrow pass calls them on batches, the
    tokenizer on all sentences of a batch at once. Null texts have no sentences."""
    def run(texts: pd.Series) -> pd.Series:
        given = texts.fillna("").tolist()
        sents = splitter(given) if splitter else [re.findall(S.SENTENCE_PATTERN, t) for t in given]
        flat = [s for ss in sents for s in ss]
        toks = iter(tokenizer(flat) if tokenizer else [_TOKENS(s) for s in flat])
        return pd.Series([[list(next(toks)) for _ in ss] for ss in sents])
    udf = F.pandas_udf(run, "array<array<string>>")
    return lambda text: udf(text)


def pack_overlapping(lengths: Column, limit: int, overlapped_limit: int | None = None) -> Column:
    """SEG-5 fold over sentence lengths -> ``array<struct<a,b>>`` inclusive sentence ranges.

    On overflow the open segment is closed; the next one starts with the previous and the
    current sentence unless their sum exceeds ``overlapped_limit`` (default 1.5·limit)."""
    lim = _lit(limit)
    if overlapped_limit is not None:
        ol = _lit(overlapped_limit)
    elif isinstance(limit, Column):
        ol = F.floor(limit * 1.5).cast("int")
    else:
        ol = F.lit(int(limit * 1.5))
    init = F.struct(F.lit(0).alias("cn"), F.lit(0).alias("a"), F.lit(-1).alias("b"), F.lit(0).alias("pn"),
                    F.lit(0).alias("i"), F.expr(f"cast(array() as {RANGE_STATE})").alias("out"))

    def step(acc, n):
        i = acc["i"]
        closed = F.when(i > 0, F.concat(acc["out"], F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b"))))) \
                  .otherwise(acc["out"])
        alone = (i > 0) & (acc["pn"] + n > ol)
        start = F.when(alone | (i == 0), i).otherwise(i - 1)
        cn_over = F.when(alone | (i == 0), n).otherwise(acc["pn"] + n)
        over = F.struct(cn_over.alias("cn"), start.alias("a"), i.alias("b"), n.alias("pn"), (i + 1).alias("i"),
                        closed.alias("out"))
        grow = F.struct((acc["cn"] + n).alias("cn"), acc["a"].alias("a"), i.alias("b"), n.alias("pn"),
                        (i + 1).alias("i"), acc["out"].alias("out"))
        return F.when(acc["cn"] + n > lim, over).otherwise(grow)

    return F.aggregate(lengths, init, step,
                       lambda acc: F.concat(acc["out"], F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b")))))


def training_segments(blocks: DataFrame, group_cols: list[str], order_col: str, text_col: str, label_col: str,
                      max_tokens: int = S.TRAINING_TOKEN_LIMIT, limits: list[int] | None = None,
                      remove_columns: list[str] | None = None, sentences=None) -> DataFrame:
    """SEG-4..7: labelled blocks of one mail (and language) -> multi-scale overlapping
    token/label segments ``(group..., limit, segment_no, tokens, labels)``.

    Blocks with a null in any column (after ``remove_columns``, FLT-6) are left out. ``sentences`` is a hook of
    :func:`hooked_tokens`. One shuffle on the group keys collects the (bounded) blocks of each mail in
    order; limits are exploded after the shuffle, so text is moved once."""
    if limits is None:
        lo, hi, st = (int(f * max_tokens / 10) for f in S.TRAINING_LIMIT_FRACTIONS)
        limits = list(range(lo, hi, st))
    clean = drop_then_dropna(blocks, remove_columns)
    if sentences:
        clean = clean.withColumn("_sents", sentences(F.col(text_col)))
    g = clean.groupBy(*group_cols).agg(F.array_sort(F.collect_list(
        F.struct(F.col(order_col).alias("o"), F.col(label_col).alias("l"), F.xxhash64(text_col).alias("h"),
                 F.col("_sents" if sentences else text_col).alias("t")))).alias("_b"))   # ties in the order: by label, then by text
    g = g.select(*group_cols, "_b", F.explode(F.array(*[F.lit(x) for x in limits])).alias("limit"))
    lim = F.col("limit")
    def cut(t):
        return F.flatten(F.transform(t, lambda s: chunk_list(s, lim))) if sentences else sentence_tokens(t, lim)

    sents = F.flatten(F.transform("_b", lambda b: F.transform(
        cut(b["t"]), lambda s: F.struct(s.alias("tok"), F.array_repeat(b["l"], F.size(s)).alias("lab")))))
    one = g.select(*group_cols, "limit", sents.alias("_s"))
    ranges = pack_overlapping(F.transform("_s", lambda x: F.size(x["tok"]).cast("int")), lim)
    one = one.select(*group_cols, "limit", "_s", F.posexplode_outer(ranges).alias("segment_no", "r"))  # never empty
    piece = F.slice("_s", F.col("r.a") + 1, F.greatest(F.col("r.b") - F.col("r.a") + 1, F.lit(0)))
    return one.select(*group_cols, "limit", F.col("segment_no").cast("int").alias("segment_no"),
                      F.flatten(F.transform(piece, lambda x: x["tok"])).alias("tokens"),
                      F.flatten(F.transform(piece, lambda x: x["lab"])).alias("labels"))


def _lean(toks: Column, label: Column) -> tuple[Column, Column]:
    """A sentence's tokens and labels as they are shuffled and written: one string each, in an array that the packer joins.
    Tokens hold no blanks; a label is written once with the number of tokens."""
    some = F.size(toks) > 0
    none = F.array().cast("array<string>")
    return (F.when(some, F.array(F.array_join(toks, " "))).otherwise(none).alias("tokens"),
            F.when(some, F.array(F.concat(F.size(toks).cast("string"), F.lit(":"), label.cast("string")))).otherwise(none).alias("labels"))


def _unfolded(toks: Column, labels: Column) -> tuple[Column, Column]:
    """The tokens and labels of :func:`_lean`, one for each token again."""
    return (F.flatten(F.transform(toks, lambda t: F.split(t, " ", -1))).alias("tokens"),
            F.flatten(F.transform(labels, lambda x: F.array_repeat(F.call_function("substr", x, F.instr(x, ":") + 1),
                                                                   F.substring_index(x, ":", 1).cast("int")))).alias("labels"))


def training_segments_skewsafe(blocks: DataFrame, group_cols: list[str], order_col: str, text_col: str,
                               label_col: str, max_tokens: int = S.TRAINING_TOKEN_LIMIT,
                               limits: list[int] | None = None, num_partitions: int | None = None,
                               remove_columns: list[str] | None = None) -> DataFrame:
    """SEG-4..7 without grouping a mail: sentence rows are packed by the range-partitioned packer
    (:mod:`mailsift.operators.packing`); same rows as :func:`training_segments`."""
    from mailsift.operators.packing import pack_overlapping_skewsafe
    if limits is None:
        lo, hi, st = (int(f * max_tokens / 10) for f in S.TRAINING_LIMIT_FRACTIONS)
        limits = list(range(lo, hi, st))
    clean = drop_then_dropna(blocks, remove_columns)
    x = clean.select(*group_cols, order_col, label_col, text_col,
                     F.explode(F.array(*[F.lit(v) for v in limits])).alias("limit"))
    x = x.select(*group_cols, "limit", order_col, label_col, F.xxhash64(text_col).alias("_h"),
                 F.posexplode_outer(sentence_tokens(F.col(text_col), F.col("limit"))).alias("_k", "tokens"))
    rows = x.where(F.col("tokens").isNotNull()).select(
        *group_cols, "limit", F.col(order_col).alias("_pos"), F.col(label_col).alias("_label"), "_h", "_k",
        F.size("tokens").alias("_n"), *_lean(F.col("tokens"), F.col(label_col)))
    segments = pack_overlapping_skewsafe(rows, group_cols, ["_pos", "_label", "_h", "_k"], "_n", "limit", ["tokens", "labels"], num_partitions)
    segments = segments.select(*group_cols, "limit", "segment_no", *_unfolded(F.col("tokens"), F.col("labels")))
    # A mail without any sentence is one empty segment.
    blank = x.groupBy(*group_cols, "limit").agg(F.count("tokens").alias("_c")).where("_c = 0")
    types = {f.name: f.dataType.simpleString() for f in segments.schema.fields}
    return segments.unionByName(blank.select(*group_cols, "limit", F.lit(0).alias("segment_no"),
                                           *[F.expr(f"cast(array() as {types[c]})").alias(c) for c in ("tokens", "labels")]))


def token_rows_to_sequences(rows: DataFrame, group_cols: list[str], order_col: str, token_col: str = "token",
                            label_col: str = "label", tags: list[str] | None = None) -> DataFrame:
    """FLT-8 + FLT-4 + RSH-7: drop literal line-break tokens, optionally keep only listed
    tags, collect ordered ``(tokens, tags)`` per group."""
    r = rows.where(F.col(token_col) != S.NEWLINE_TOKEN)
    if tags is not None:
        r = r.where(F.col(label_col).isin(tags))
    g = r.groupBy(*group_cols).agg(F.array_sort(F.collect_list(
        F.struct(F.col(order_col).alias("o"), F.col(token_col).alias("t"), F.col(label_col).alias("l")))).alias("_v"))
    return g.select(*group_cols, F.transform("_v", lambda x: x["t"]).alias("tokens"),
                    F.transform("_v", lambda x: x["l"]).alias("ner_tags"))


def limit_tags(tokens_col: Column, tags_col: Column, allowed: list[str]) -> Column:
    """FLT-4 on array columns: keep (token, tag) pairs whose tag is allowed."""
    z = F.arrays_zip(tokens_col.alias("t"), tags_col.alias("g"))
    return F.filter(z, lambda x: x["g"].isin(allowed))


# --------------------------------------------------------------------------- LM blocks, windows
def lm_blocks(df: DataFrame, id_col: str, text_col: str, block_size: int = S.DIRECT_EXTRACTOR_MAX_TOKENS,
              batch_size: int = 1000) -> DataFrame:
    """SEG-8: within batches of ``batch_size`` consecutive ids, concatenate token lists and cut
    them into blocks of ``block_size`` (last short block kept); labels = copy of the ids.

    Token positions come from a running sum over at most ``batch_size`` rows per batch; a
    block gathers at most ``block_size`` tokens, so no group is unbounded."""
    from pyspark.sql import Window
    t = df.select(id_col, F.floor(F.col(id_col) / batch_size).alias("batch_id"),
                  tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"))
    w = Window.partitionBy("batch_id").orderBy(id_col).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_off", F.coalesce(F.sum(F.size("_t")).over(w), F.lit(0)))
    first_b = F.floor(F.col("_off") / block_size)
    last_b = F.floor((F.col("_off") + F.size("_t") - 1) / block_size)
    t = t.where(F.size("_t") > 0).select(
        "batch_id", id_col, "_t", "_off", F.explode(F.sequence(first_b, last_b)).alias("block_no"))
    lo = F.greatest(F.col("block_no") * block_size - F.col("_off"), F.lit(0))
    hi = F.least((F.col("block_no") + 1) * block_size - F.col("_off"), F.size("_t"))
    t = t.select("batch_id", "block_no", id_col, F.slice("_t", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))
    b = t.groupBy("batch_id", "block_no").agg(
        F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("o"), F.col("piece").alias("p")))).alias("_v"))
    ids = F.flatten(F.transform("_v", lambda x: x["p"]))
    return b.select(F.col("batch_id").cast("long").alias("batch_id"), F.col("block_no").cast("long").alias("block_no"),
                    ids.alias("input_ids"), ids.alias("labels"))


def char_windows(df: DataFrame, id_col: str, text_col: str, width: int = 300, step: int = 150) -> DataFrame:
    """SEG-9: overlapping character windows ``(id, window_start, text)``."""
    n = F.length(text_col)
    x = df.where(n > 0).select(id_col, text_col, F.explode(F.sequence(F.lit(0), n - 1, F.lit(step))).alias("window_start"))
    return x.select(id_col, "window_start", F.expr(f"substring({text_col}, window_start + 1, {width})").alias("text"))
