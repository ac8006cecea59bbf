"""Registered queries: sentences, packing, labelled training segments, LM blocks (SEG-1..9,
FLT-4, FLT-8, RSH-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift import settings as S
from mailsift.operators.segment import (char_windows, chunk_list, inference_segments, lm_blocks,
                                        token_rows_to_sequences, tokens, training_segments,
                                        training_segments_skewsafe)
from mailsift.plans import sqlkit as K
from mailsift.plans.registry import register
from mailsift.session import read_table
from mailsift.sources.readers import read_text_table

L_INF = S.INFERENCE_TOKEN_LIMIT
TOK = K.q(S.TOKEN_PATTERN)
TRAIN_LIMITS = list(range(25, 175, 25))


def _inference_sql(limit: int, src: str = "documents") -> str:
    """Windows of the texts of ``src`` (doc_id of any type, text)."""
    sents = K.spans(src, "doc_id", "text", S.SENTENCE_PATTERN)
    su = f"""su AS (SELECT doc_id, i, "start", name, len(regexp_extract_all(name, {TOK})) AS n,
        "start" + length(regexp_replace(name, '[ \\t\\f]+\\z', '')) AS e FROM s)"""
    lt = K.spans(f"(SELECT {{'d': doc_id, 'i': i}} AS sid, name FROM su WHERE n > {limit})", "sid", "name", S.TOKEN_PATTERN)
    return f"""
WITH s AS {sents},
{su},
lt AS {lt},
ch AS (SELECT sid.d AS doc_id, sid.i AS i, (i - 1) // {limit} AS k, count(*) AS n,
              min("start") AS ts, max("end") AS te FROM lt GROUP BY sid, (i - 1) // {limit}),
units AS (SELECT doc_id, i, 0 AS k, n, "start" AS s, e FROM su WHERE n <= {limit}
          UNION ALL SELECT ch.doc_id, ch.i, ch.k, ch.n, su."start" + ch.ts, su."start" + ch.te
          FROM ch JOIN su ON su.doc_id = ch.doc_id AND su.i = ch.i),
ul AS (SELECT doc_id, list({{'n': CAST(n AS INTEGER), 's': CAST(s AS INTEGER), 'e': CAST(e AS INTEGER)}} ORDER BY i, k) AS u
       FROM units GROUP BY doc_id),
packed AS (SELECT d.doc_id, d.text, list_reduce(coalesce(ul.u, []), lambda acc, x:
    CASE WHEN acc.cn + x.n > {limit}
         THEN {{'cn': x.n, 'cs': x.s, 'ce': x.e, 'out': list_append(acc.out, {{'n': acc.cn, 's': acc.cs, 'e': acc.ce}})}}
         ELSE {{'cn': acc.cn + x.n, 'cs': acc.cs, 'ce': x.e, 'out': acc.out}} END,
    {{'cn': 0, 'cs': 0, 'ce': 0, 'out': []::STRUCT(n INTEGER, s INTEGER, e INTEGER)[]}}) AS st
  FROM {src} d LEFT JOIN ul ON d.doc_id = ul.doc_id),
segs AS (SELECT doc_id, text, list_append(st.out, {{'n': st.cn, 's': st.cs, 'e': st.ce}}) AS out FROM packed)
SELECT doc_id, CAST(generate_subscripts(out, 1) - 1 AS INTEGER) AS segment_no, unnest(out).n AS n_tokens,
       unnest(out).s AS "start", unnest(out).e AS "end",
       substr(text, unnest(out).s + 1, unnest(out).e - unnest(out).s) AS text
FROM segs"""


@register("seg_inference_segments", _inference_sql(L_INF))
def seg_inference_segments(spark, sf_dir):
    """SEG-2/SEG-3: ≤ 400-token greedy segments of whole documents, with offsets and text."""
    docs = read_text_table(spark, sf_dir, "documents", "doc_id", ["doc_id", "text"])
    return inference_segments(docs, "doc_id", "text", L_INF)


@register("seg_inference_segments_small", _inference_sql(12))
def seg_inference_segments_small(spark, sf_dir):
    """SEG-2/SEG-3 with a 12-token limit: exercises long-sentence chunk offsets."""
    docs = read_text_table(spark, sf_dir, "documents", "doc_id", ["doc_id", "text"])
    return inference_segments(docs, "doc_id", "text", 12)


_TRAIN_SQL = f"""
WITH b AS (SELECT {{'c': conv_id, 't': turn}} AS bid, conv_id, turn, role, text, CASE WHEN turn % 3 = 2 THEN 'fr' ELSE 'en' END AS lang FROM conversations
           WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL),
s AS {K.spans('b', 'bid', 'text', S.SENTENCE_PATTERN)},
st AS (SELECT s.bid, s.i, regexp_extract_all(s.name, {TOK}) AS toks FROM s),
lims AS (SELECT unnest({TRAIN_LIMITS}) AS L),
ch AS (SELECT bid, i, L, k, list_slice(toks, k * L + 1, (k + 1) * L) AS tok FROM (
         SELECT st.bid, st.i, lims.L, st.toks, unnest(generate_series(0, greatest(len(st.toks) - 1, 0) // lims.L)) AS k
         FROM st CROSS JOIN lims) z),
sl AS (SELECT b.conv_id, b.lang, ch.L, list({{'tok': ch.tok, 'lab': list_transform(ch.tok, lambda t: b.role)}}
                                    ORDER BY b.turn, ch.i, ch.k) AS sents
       FROM ch JOIN b ON b.bid = ch.bid GROUP BY b.conv_id, b.lang, ch.L),
rg AS (SELECT conv_id, lang, L, sents, list_reduce(list_transform(sents, lambda x, j: {{'n': CAST(len(x.tok) AS INTEGER), 'j': CAST(j - 1 AS INTEGER)}}),
    lambda acc, x: CASE WHEN acc.cn + x.n > L THEN
        {{'cn': CASE WHEN x.j = 0 OR acc.pn + x.n > CAST(floor(L * 1.5) AS INTEGER) THEN x.n ELSE acc.pn + x.n END,
         'a': CASE WHEN x.j = 0 OR acc.pn + x.n > CAST(floor(L * 1.5) AS INTEGER) THEN x.j ELSE x.j - 1 END,
         'b': x.j, 'pn': x.n,
         'out': CASE WHEN x.j > 0 THEN list_append(acc.out, {{'a': acc.a, 'b': acc.b}}) ELSE acc.out END}}
      ELSE {{'cn': acc.cn + x.n, 'a': acc.a, 'b': x.j, 'pn': x.n, 'out': acc.out}} END,
    {{'cn': 0, 'a': 0, 'b': -1, 'pn': 0, 'out': []::STRUCT(a INTEGER, b INTEGER)[]}}) AS st FROM sl),
r2 AS (SELECT conv_id, lang, L, sents, list_append(st.out, {{'a': st.a, 'b': st.b}}) AS rr FROM rg),
r3 AS (SELECT conv_id, lang, L, sents, unnest(rr) AS r, generate_subscripts(rr, 1) - 1 AS segment_no FROM r2),
r4 AS (SELECT conv_id, lang, L, segment_no, list_slice(sents, r.a + 1, r.b + 1) AS piece FROM r3)
SELECT conv_id, lang, CAST(L AS INTEGER) AS "limit", CAST(segment_no AS INTEGER) AS segment_no,
       CAST(len(flatten(list_transform(piece, lambda x: x.tok))) AS INTEGER) AS n_tokens,
       array_to_string(flatten(list_transform(piece, lambda x: x.tok)), ' ') AS tokens,
       array_to_string(flatten(list_transform(piece, lambda x: x.lab)), ' ') AS labels
FROM r4"""


def _blocks(spark, sf_dir):
    """Conversation turns as labelled blocks of two languages (every third turn is French)."""
    return read_table(spark, sf_dir, "conversations").withColumn("lang", F.when(F.col("turn") % 3 == 2, "fr").otherwise("en"))


@register("seg_training_segments", _TRAIN_SQL)
def seg_training_segments(spark, sf_dir):
    """SEG-4..7: conversations as labelled blocks (role = label) -> multi-scale overlapping segments."""
    seg = training_segments(_blocks(spark, sf_dir), ["conv_id", "lang"], "turn", "text", "role", limits=TRAIN_LIMITS)
    return seg.select("conv_id", "lang", "limit", "segment_no", F.size("tokens").cast("int").alias("n_tokens"),
                      F.array_join("tokens", " ").alias("tokens"), F.array_join("labels", " ").alias("labels"))


@register("seg_training_segments_skewsafe", _TRAIN_SQL)
def seg_training_segments_skewsafe(spark, sf_dir):
    """SEG-4..7 in the skew-safe physical form (no per-mail group; range-partitioned packer)."""
    seg = training_segments_skewsafe(_blocks(spark, sf_dir), ["conv_id", "lang"], "turn", "text", "role", limits=TRAIN_LIMITS)
    return seg.select("conv_id", "lang", "limit", "segment_no", F.size("tokens").cast("int").alias("n_tokens"),
                      F.array_join("tokens", " ").alias("tokens"), F.array_join("labels", " ").alias("labels"))


@register("seg_lm_blocks", f"""
WITH t AS (SELECT doc_id, doc_id // 1000 AS batch_id, regexp_extract_all(coalesce(text, ''), {TOK}) AS toks FROM documents),
o AS (SELECT *, coalesce(sum(len(toks)) OVER (PARTITION BY batch_id ORDER BY doc_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM t),
u AS (SELECT batch_id, off + generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS tok FROM o)
SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(pos // {S.DIRECT_EXTRACTOR_MAX_TOKENS} AS BIGINT) AS block_no,
       CAST(count(*) AS INTEGER) AS n_tokens, string_agg(tok, ' ' ORDER BY pos) AS text,
       string_agg(tok, ' ' ORDER BY pos) AS labels
FROM u GROUP BY batch_id, pos // {S.DIRECT_EXTRACTOR_MAX_TOKENS}""")
def seg_lm_blocks(spark, sf_dir):
    """SEG-8: batches of 1000 ids, token lists concatenated and cut into 512-token blocks."""
    docs = read_text_table(spark, sf_dir, "documents", "doc_id", ["doc_id", "text"])
    b = lm_blocks(docs, "doc_id", "text")
    return b.select("batch_id", "block_no", F.size("input_ids").cast("int").alias("n_tokens"),
                    F.array_join("input_ids", " ").alias("text"), F.array_join("labels", " ").alias("labels"))


@register("seg_char_windows", """
SELECT doc_id, CAST(w AS INTEGER) AS window_start, substr(text, w + 1, 300) AS text
FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 150)) AS w FROM documents WHERE length(text) > 0)""")
def seg_char_windows(spark, sf_dir):
    """SEG-9: overlapping 300-character windows with step 150."""
    docs = read_text_table(spark, sf_dir, "documents", "doc_id", ["doc_id", "text"])
    return char_windows(docs, "doc_id", "text")


@register("seg_token_chunks", f"""
SELECT doc_id, CAST(k AS INTEGER) AS chunk_no, CAST(len(c) AS INTEGER) AS n_tokens, c[1] AS first_token, c[-1] AS last_token
FROM (SELECT doc_id, k, list_slice(toks, k * 400 + 1, (k + 1) * 400) AS c FROM (
        SELECT doc_id, toks, unnest(generate_series(0, greatest(len(toks) - 1, 0) // 400)) AS k
        FROM (SELECT doc_id, regexp_extract_all(text, {TOK}) AS toks FROM documents)))""")
def seg_token_chunks(spark, sf_dir):
    """SEG-1: fixed-size 400-token chunks of each document's token list."""
    docs = read_text_table(spark, sf_dir, "documents", "doc_id", ["doc_id", "text"])
    x = docs.select("doc_id", F.posexplode(chunk_list(tokens(F.col("text")), 400)).alias("chunk_no", "c"))
    return x.select("doc_id", F.col("chunk_no").cast("int").alias("chunk_no"), F.size("c").cast("int").alias("n_tokens"),
                    F.get("c", 0).alias("first_token"), F.get("c", F.size("c") - 1).alias("last_token"))


@register("rsh_token_sequences", r"""
WITH t AS (SELECT conv_id, turn, role, string_split(replace(text, chr(10), ' [\n] '), ' ') AS ws FROM conversations),
u AS (SELECT conv_id, {'t': turn, 'p': generate_subscripts(ws, 1)} AS pos, unnest(ws) AS token, role AS label FROM t)
SELECT conv_id, array_to_string(list(token ORDER BY pos), ' ') AS tokens, array_to_string(list(label ORDER BY pos), ' ') AS ner_tags,
       CAST(count(*) AS INTEGER) AS n
FROM u WHERE token <> '' AND token <> '[\n]' AND label IN ('user', 'assistant') GROUP BY conv_id""")
def rsh_token_sequences(spark, sf_dir):
    """RSH-7 + FLT-8 + FLT-4: token rows (line breaks as literal tokens) -> ordered (tokens, tags)."""
    conv = read_table(spark, sf_dir, "conversations")
    ws = F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" [\\n] ")), " ", -1)
    rows = conv.select("conv_id", "turn", "role", F.posexplode(ws).alias("p", "token"))
    rows = rows.where(F.col("token") != "").select(
        "conv_id", F.struct("turn", "p").alias("pos"), "token", F.col("role").alias("label"))
    seq = token_rows_to_sequences(rows, ["conv_id"], "pos", tags=["user", "assistant"])
    return seq.select("conv_id", F.array_join("tokens", " ").alias("tokens"), F.array_join("ner_tags", " ").alias("ner_tags"),
                      F.size("tokens").cast("int").alias("n"))
