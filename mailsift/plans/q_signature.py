"""Registered queries: fusion, post-filter, responses, envelopes, token scoring, signature location and the parse pipelines
(FUS-1..3, RSP-1..9, RSH-1, SPN-3..6, UDF-1, UDF-4, SRC-5..7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift import settings as S
from mailsift.operators import parse as P
from mailsift.operators.extract import phone_entity_array, regex_entity_array
from mailsift.operators.fuse import ner_map, numbered_entities, post_filtered
from mailsift.operators.response import (EVALUATED_TAGS, RESPONSE_TAGS, body_request, parse_body_requests, response_to_long, responses,
                                         sender_data, sender_to_long, signature_of_request, signature_request)
from mailsift.operators.score import SEGMENTATION, TOKENS, detect_language, fit_language_profile, predicted_tokens, score_windows
from mailsift.operators.split import hash_fraction
from mailsift.plans import sqlkit as K
from mailsift.plans.q_clean import sql_clean
from mailsift.plans.q_extract import _entities_sql, _phone_sql
from mailsift.plans.q_gazetteer import gazetteer_df
from mailsift.plans.q_segment import _inference_sql
from mailsift.plans.registry import register
from mailsift.session import read_table
from mailsift.sources.readers import read_text_table

WSQ = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


# ------------------------------------------------------------------------------ entities
def filtered_rows(spark, sf_dir):
    """Documents with their pattern entities and us phone numbers (as office phones), filtered in the row."""
    docs = read_text_table(spark, sf_dir, "documents", "doc_id", ["doc_id", "text", "lang"])
    ents = numbered_entities(F.concat(regex_entity_array(F.col("text")), phone_entity_array(F.col("text"), "us", "PHONE_OFFICE")))
    x = docs.withColumn("_all", ents)
    return x.withColumn("entities", post_filtered(F.col("_all"), F.col("text"), F.col("lang"))).drop("_all")


def _exploded(rows):
    return rows.select("doc_id", F.explode_outer("entities").alias("e"), "lang").where("e is not null").select("doc_id", "e.*", "lang")


def _post_sql(name: str, out: str) -> str:
    """FUS-2 over the rows of ``name`` (doc_id, seq, start, end, entity, name, score, lang, text)."""
    return f"""{out}0 AS (SELECT *, regexp_matches(name, '[,.;:]$') AS tr FROM {name}),
{out}1 AS (SELECT doc_id, seq, "start", entity, score, lang, text,
               CAST(CASE WHEN tr THEN "end" - 1 ELSE "end" END AS INTEGER) AS "end",
               CASE WHEN tr THEN substr(name, 1, length(name) - 1) ELSE name END AS name FROM {out}0),
{out}2 AS (SELECT *, regexp_replace(name, '^ +| +$', '', 'g') AS bs FROM {out}1),
{out} AS (SELECT doc_id, seq, "start", "end", entity, name, score, lang FROM {out}2
       WHERE (length(bs) < 2 OR strpos(substr(bs, 2, length(bs) - 2), chr(10)) = 0)
         AND (NOT {K.in_list('entity', S.PHONE_TAGS)} OR length(regexp_replace(name, '[^0-9]', '', 'g')) > 8)
         AND (lang <> 'en' OR len(list_filter(string_split_regex(name, '[ \n:]'),
                  lambda p: NOT list_contains(string_split_regex(text, '[ \n,:;]'), p))) = 0))"""


_ENTS_SQL = f"""
rx AS ({_entities_sql('documents', 'doc_id', 'text')}),
ph AS (SELECT doc_id, seq, "start", "end", 'PHONE_OFFICE' AS entity, name,
              CAST(1.0 AS DOUBLE) AS score FROM ({_phone_sql('documents', 'doc_id', 'text', ['us'])}) p),
ents AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY src, seq) - 1 AS INTEGER) AS seq, "start", "end", entity, name, score
         FROM (SELECT *, 0 AS src FROM rx UNION ALL BY NAME SELECT *, 1 AS src FROM ph)),
pre AS (SELECT e.*, d.lang, d.text FROM ents e JOIN documents d ON e.doc_id = d.doc_id),
{_post_sql('pre', 'pf')}"""


@register("fus_post_filter", f"WITH {_ENTS_SQL} SELECT doc_id, seq, \"start\", \"end\", entity, name, score, lang FROM pf")
def fus_post_filter(spark, sf_dir):
    """FUS-2: trailing separator strip, inner-newline and phone-digit rules, English whole tokens."""
    return _exploded(filtered_rows(spark, sf_dir))


def _resp_long_sql(prefix: str | None = None, ents: str = "pf", docs: str = "documents") -> str:
    """Flattened responses for every row of ``docs`` from entity rows ``ents`` (id, seq, entity, name)."""
    from mailsift.operators.response import RESPONSE_TAGS
    parts = []
    for i, (tag, lst, val, ptype) in enumerate(RESPONSE_TAGS):
        src = {"names": None, "phoneNumbers": f"PHONE_{ptype}" if ptype else None}.get(lst, tag)
        if lst == "names":
            parts.append(f"""SELECT d.doc_id, {i} AS tag_no, 0 AS pos, {K.q(tag)} AS entity,
                coalesce((SELECT arg_min(name, seq) FROM {ents} pf WHERE pf.doc_id = d.doc_id AND pf.entity = {K.q(tag)}), '') AS name
                FROM {docs} d""")
        else:
            ent = src if lst != "phoneNumbers" else f"PHONE_{ptype}"
            parts.append(f"""SELECT doc_id, {i}, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS INTEGER),
                {K.q(tag)}, name FROM {ents} WHERE entity = {K.q(ent)}
                UNION ALL SELECT d.doc_id, {i}, 0, {K.q(tag)}, ''
                FROM {docs} d WHERE NOT EXISTS (SELECT 1 FROM {ents} pf WHERE pf.doc_id = d.doc_id AND pf.entity = {K.q(ent)})""")
    return f"WITH {prefix or _ENTS_SQL}\n" + "\nUNION ALL\n".join(parts)


@register("rsp_response_long", _resp_long_sql())
def rsp_response_long(spark, sf_dir):
    """RSP-1/2/3 + RSH-1: nested responses from filtered entities, flattened back to (tag, value)."""
    return response_to_long(responses(filtered_rows(spark, sf_dir), "doc_id", "text"))


@register("rsp_ner_map", f"""WITH {_ENTS_SQL}
SELECT doc_id, 'SIGNATURE.' || entity AS key, arg_max(name, seq) AS value FROM pf GROUP BY doc_id, entity""")
def rsp_ner_map(spark, sf_dir):
    """RSP-5: flattened SIGNATURE.<tag> -> name map, last duplicate wins."""
    return ner_map(_exploded(filtered_rows(spark, sf_dir)))


# ------------------------------------------------------------------------------ envelopes
def _meta(conv_id, role):
    addr = "struct<address:string,displayName:string>"
    dom = F.concat(F.lit("@"), conv_id.cast("string"), F.lit(".example.com"))
    return F.struct(
        F.struct(F.concat(role, dom).alias("address"), F.lit("").alias("displayName")).alias("senderEmailAddress"),
        F.array(F.struct(F.concat(F.lit("user"), dom).alias("address"),
                         F.concat(F.lit("User "), conv_id.cast("string")).alias("displayName"))).alias("fromEmailAddresses"),
        F.array(F.struct(F.concat(F.lit("assistant"), dom).alias("address"), F.lit("Assistant").alias("displayName")))
        .alias("replyToEmailAddresses"),
        F.array().cast(f"array<{addr}>").alias("toEmailAddresses"), F.array().cast(f"array<{addr}>").alias("ccEmailAddresses"),
        F.array().cast(f"array<{addr}>").alias("bccEmailAddresses"), F.lit("subject").alias("subject"),
        conv_id.cast("string").alias("messageId"), F.lit(1538123341000).cast("long").alias("sentDate"),
        F.lit("inbox@example.com").alias("receivedByEmailAddress"), F.array().cast("array<string>").alias("inReplyToMessageIds"),
        F.array().cast("array<string>").alias("referenceMessageIds"))


@register("rsp_sender_metadata", """
WITH c AS (SELECT conv_id, turn, role, '@' || CAST(conv_id AS VARCHAR) || '.example.com' AS dom FROM conversations),
allv AS (SELECT conv_id, turn, 1 AS o, role || dom AS address, '' AS name, 'SENDER' AS t FROM c
         UNION ALL SELECT conv_id, turn, 2, 'user' || dom, 'User ' || CAST(conv_id AS VARCHAR), 'FROM' FROM c
         UNION ALL SELECT conv_id, turn, 3, 'assistant' || dom, 'Assistant', 'REPLY_TO' FROM c
         UNION ALL SELECT conv_id, turn, 4, 'system' || dom, '', 'SIGNATURE_EMAIL_ADDRESS' FROM c),
g AS (SELECT conv_id, turn, address, min(o) AS first_o, string_agg(t, ',' ORDER BY o) AS source_types,
             coalesce(arg_min(name, o) FILTER (WHERE name <> ''), '') AS name
      FROM allv GROUP BY conv_id, turn, address)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY first_o) - 1 AS INTEGER) AS pos,
       address, name, 5 AS confidenceScore, source_types
FROM g WHERE contains(source_types, 'SENDER') OR contains(source_types, 'FROM')""")
def rsp_sender_metadata(spark, sf_dir):
    """RSP-4: sender reconciliation from envelopes built per conversation turn (role = sender)."""
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    dom = F.concat(F.lit("@"), F.col("conv_id").cast("string"), F.lit(".example.com"))
    ents = F.array(F.struct(F.lit(0).alias("seq"), F.lit("EMAIL").alias("entity"), F.concat(F.lit("system"), dom).alias("name")))
    x = conv.select("conv_id", "turn", F.posexplode(sender_data(_meta(F.col("conv_id"), F.col("role")), ents)).alias("pos", "s"))
    return x.select("conv_id", "turn", F.col("pos").cast("int").alias("pos"), "s.address", "s.name", "s.confidenceScore",
                    F.array_join("s.sourceTypes", ",").alias("source_types"))


@register("rsp_request_roundtrip", """
SELECT conv_id, turn, text AS body, text AS block, role || '@' || CAST(conv_id AS VARCHAR) || '.example.com' AS sender
FROM conversations""")
def rsp_request_roundtrip(spark, sf_dir):
    """RSP-9 + SRC-5/6/7: body and signature envelopes written as JSON and read back."""
    conv = read_table(spark, sf_dir, "conversations")
    meta = _meta(F.col("conv_id"), F.col("role"))
    js = conv.select("conv_id", "turn", body_request(F.col("text"), meta).alias("bj"),
                     signature_request(F.col("text"), meta).alias("sj"))
    parsed = js.select("conv_id", "turn", F.explode(parse_body_requests(F.col("bj"))).alias("r"),
                       signature_of_request(F.col("sj")).alias("block"))
    return parsed.select("conv_id", "turn", F.col("r.textBody").alias("body"), "block",
                         F.col("r.emailMetadata.senderEmailAddress.address").alias("sender"))


# ------------------------------------------------------------------------------ signature stage
def _docs(spark, sf_dir):
    return read_text_table(spark, sf_dir, "documents", "doc_id", ["doc_id", "text", "lang"])


def _lines_of(text: str) -> str:
    return f"length({text}) - length(replace({text}, chr(10), ''))"


def _windows_sql(src: str, out: str) -> str:
    """CTE ``out`` (sid, doc_id, segment_no, seg_start, text, lang) of the windows of ``src`` (doc_id, text, lang)."""
    return f"""{out}_segs AS ({_inference_sql(S.INFERENCE_TOKEN_LIMIT, src)}),
{out} AS (SELECT {{'d': g.doc_id, 's': g.segment_no}} AS sid, g.doc_id, g.segment_no, g."start" AS seg_start, g.text, d.lang
       FROM {out}_segs g JOIN {src} d ON d.doc_id = g.doc_id WHERE length(g.text) > 0)"""


def _label_sql(src: str) -> str:
    """CTEs up to ``agg``: the default segmentation scorers' signature tokens in each window (the last 3 lines for English, 2 for
    other languages)."""
    return f"""{_windows_sql(src, 'sg')},
tk AS {K.spans('sg', 'sid', 'text', r'[^ \t\n\r\f]+')},
lab AS (SELECT tk.sid, tk.i, tk."start", tk."end",
               CASE WHEN {_lines_of('substr(sg.text, 1, tk."start")')} >= {_lines_of('sg.text')} + 1 - CASE WHEN sg.lang = 'en' THEN 3 ELSE 2 END
                    THEN 'SIGNATURE' ELSE 'BODY' END AS entity FROM tk JOIN sg ON tk.sid = sg.sid),
agg AS (SELECT sid, count(*) AS n, arg_min("start", i) AS s, arg_max("end", i) AS e FROM lab WHERE entity = 'SIGNATURE' GROUP BY sid)"""


@register("sig_token_predictions", f"""WITH {_label_sql('documents')}
SELECT sg.doc_id, sg.segment_no, CAST(lab.i - 1 AS INTEGER) AS token_no,
       CAST(lab."start" + sg.seg_start AS INTEGER) AS "start", CAST(lab."end" + sg.seg_start AS INTEGER) AS "end",
       lab.entity, CAST(1.0 AS DOUBLE) AS score
FROM lab JOIN sg ON lab.sid = sg.sid""")
def sig_token_predictions(spark, sf_dir):
    """UDF-1/SPN-4: the scorer of each document's language over its ≤400-token windows; offsets in the whole text."""
    x = score_windows(_docs(spark, sf_dir), SEGMENTATION, TOKENS, predicted_tokens, name="p")
    return x.select("doc_id", F.explode("p").alias("p")).select("doc_id", F.col("p.window").alias("segment_no"), "p.token_no", "p.start", "p.end",
                                                                 "p.entity", "p.score")


_FIND_SQL = """SELECT sg.doc_id, sg.segment_no,
       CASE WHEN coalesce(n, 0) = 0 THEN sg.text ELSE substr(sg.text, 1, s) END AS body,
       CASE WHEN coalesce(n, 0) = 0 THEN '' ELSE substr(sg.text, s + 1, e - s) END AS signature,
       CASE WHEN coalesce(n, 0) = 0 THEN 'no_match' WHEN n = 1 THEN 'perfect_match' ELSE 'imperfect_match' END AS tag,
       CASE WHEN n = 1 THEN CAST(s + sg.seg_start AS INTEGER) END AS start_signature,
       CASE WHEN n = 1 THEN CAST(e + sg.seg_start AS INTEGER) END AS end_signature
FROM sg LEFT JOIN agg ON sg.sid = agg.sid"""


@register("sig_find_signature", f"WITH {_label_sql('documents')}\n{_FIND_SQL}")
def sig_find_signature(spark, sf_dir):
    """SPN-3: per window body/signature, match flag and offsets, decided in the scoring pass."""
    return P.window_signatures(_docs(spark, sf_dir), ["doc_id"])


def _strip_sql(x):
    return f"regexp_replace({x}, '^{WSQ}+|{WSQ}+$', '', 'g')"


_ALIGN_SQL = f"""a0 AS (SELECT doc_id, text, raw, {_strip_sql("coalesce(raw, '')")} AS resp FROM j),
a1 AS (SELECT *, list_filter(string_split({_strip_sql("substr(resp, 2, greatest(length(resp) - 2, 0))")}, ' '),
                             lambda x: x <> '') AS parts FROM a0),
a2 AS (SELECT *, list_filter(list_transform(parts, lambda p: {{'p': p, 'k': len(string_split(text, p)) - 1,
                 'first': length(string_split(text, p)[1]),
                 'last': length(text) - length(string_split(text, p)[-1]) - length(p)}}), lambda x: x.k > 0) AS v FROM a1),
a3 AS (SELECT *, len(v) AS n, list_min(list_transform(v, lambda x: x.k)) AS min_n FROM a2),
a4 AS (SELECT *, list_transform(v, lambda x: {{'p': x.p, 'single': x.k = 1 OR (min_n > 1 AND x.k = min_n),
                 'val': CASE WHEN x.k = 1 THEN x.first ELSE x.last END}}) AS marked FROM a3),
a5 AS (SELECT *, list_position(list_transform(marked, lambda x: x.single), true) AS si FROM a4),
a6 AS (SELECT *, marked[si].val AS anchor, list_reverse(list_slice(marked, 1, si - 1)) AS lft,
              list_slice(marked, si + 1, n) AS rgt FROM a5 WHERE n > 0 AND length(resp) >= 10),
a7 AS (SELECT *,
   list_reduce(lft, lambda m, x: coalesce(CASE WHEN x.single THEN (CASE WHEN x.val < greatest(0, m - 1) THEN x.val END)
     ELSE (CASE WHEN len(string_split(substr(text, 1, greatest(greatest(0, m - 1) - 1 + length(x.p), 0)), x.p)) > 1
                THEN length(substr(text, 1, greatest(greatest(0, m - 1) - 1 + length(x.p), 0)))
                     - length(string_split(substr(text, 1, greatest(greatest(0, m - 1) - 1 + length(x.p), 0)), x.p)[-1])
                     - length(x.p) END) END, m), anchor) AS lo,
   list_reduce(rgt, lambda m, x: coalesce(CASE WHEN x.single THEN (CASE WHEN x.val > least(length(text), m + 1) THEN x.val END)
     ELSE (CASE WHEN strpos(substr(text, (CASE WHEN len(string_split(substr(text, 1, least(length(text), m + 1) + length(x.p)), x.p)) > 1
                 THEN length(substr(text, 1, least(length(text), m + 1) + length(x.p)))
                      - length(string_split(substr(text, 1, least(length(text), m + 1) + length(x.p)), x.p)[-1]) ELSE 0 END) + 1), x.p) > 0
           THEN (CASE WHEN len(string_split(substr(text, 1, least(length(text), m + 1) + length(x.p)), x.p)) > 1
                 THEN length(substr(text, 1, least(length(text), m + 1) + length(x.p)))
                      - length(string_split(substr(text, 1, least(length(text), m + 1) + length(x.p)), x.p)[-1]) ELSE 0 END)
                + strpos(substr(text, (CASE WHEN len(string_split(substr(text, 1, least(length(text), m + 1) + length(x.p)), x.p)) > 1
                 THEN length(substr(text, 1, least(length(text), m + 1) + length(x.p)))
                      - length(string_split(substr(text, 1, least(length(text), m + 1) + length(x.p)), x.p)[-1]) ELSE 0 END) + 1), x.p) - 1
           END) END, m), anchor) AS hi0
   FROM a6),
a8 AS (SELECT doc_id, text, raw, CAST(lo AS INTEGER) AS lo,
              CAST(least(hi0 + length(v[-1].p), length(text)) AS INTEGER) AS hi FROM a7),
a9 AS (SELECT *, substr(text, 1, lo) AS bef, substr(text, hi + 1) AS aft FROM a8),
cut AS (SELECT doc_id, text, raw,
          CASE WHEN strpos(bef, chr(10)) > 0 THEN substr(bef, 1, length(bef) - length(string_split(bef, chr(10))[-1]) - 1) ELSE '' END AS body,
          string_split(bef, chr(10))[-1] || substr(text, lo + 1, hi - lo) || string_split(aft, chr(10))[1] AS sig,
          CASE WHEN strpos(aft, chr(10)) > 0 THEN substr(aft, length(string_split(aft, chr(10))[1]) + 2) ELSE '' END AS tail,
          lo, hi FROM a9),
allr AS (SELECT j.doc_id, j.text, j.raw, coalesce(c.body, j.text) AS body, coalesce(c.sig, '') AS sig,
                coalesce(c.tail, '') AS tail, coalesce(c.lo, -1) AS lo, coalesce(c.hi, -1) AS hi
         FROM j LEFT JOIN cut c ON j.doc_id = c.doc_id)
"""


def _locate_ctes(src: str) -> str:
    """CTEs up to ``loc`` (doc_id, body, signature, tail, signature_start_index, signature_end_index) of the texts of ``src``."""
    return f"""{_label_sql(src)},
sig AS ({_FIND_SQL}),
j AS (SELECT d.doc_id, d.text, r.signature AS raw FROM {src} d
      LEFT JOIN (SELECT doc_id, arg_max(signature, segment_no) AS signature FROM sig WHERE tag <> 'no_match' GROUP BY doc_id) r ON d.doc_id = r.doc_id),
{_ALIGN_SQL.rstrip()},
loc AS (SELECT doc_id, body,
       CASE WHEN length(text) - length(replace(text, chr(10), '')) < 3 THEN coalesce(raw, '') ELSE sig END AS signature,
       tail, CAST(lo AS INTEGER) AS signature_start_index, CAST(hi AS INTEGER) AS signature_end_index
FROM allr)"""


def _located(x):
    a = x.select("doc_id", "located.*")
    return a.select("doc_id", "body", "signature", "tail", F.col("start").alias("signature_start_index"), F.col("end").alias("signature_end_index"))


@register("sig_locate_signatures", f"WITH {_locate_ctes('documents')} SELECT * FROM loc")
def sig_locate_signatures(spark, sf_dir):
    """SPN-5/SPN-6: the signature of the last window that has one, re-aligned onto the text (also checked against a Python
    statement of the algorithm in tests; ``parse.locate_signatures(all_windows=False)`` looks at the first window only)."""
    return _located(P.locate_signatures(_docs(spark, sf_dir)))


def _extract_ctes(src: str = "sigs") -> str:
    """CTEs up to ``fin``: fused and filtered entities of the blocks of ``src`` (doc_id, text, lang)."""
    from mailsift.operators.score import _ORG_WORDS
    from mailsift.plans.q_gazetteer import locs_sql
    gord = "CASE g.entity WHEN 'ADDRESS_COUNTRY' THEN 1 WHEN 'ADDRESS_COUNTRY_DIVISION' THEN 2 ELSE 3 END"
    return f"""{_windows_sql(src, 'nw')},
mtk AS {K.spans('nw', 'sid', 'text', r'[^ \t\n\r\f]+')},
mf AS (SELECT t.sid, s.doc_id, s.seg_start, s.lang, t.i, t.name, t."start", t."end", {_lines_of('substr(s.text, 1, t."start")')} AS line,
              length(regexp_replace(t.name, '[^0-9]', '', 'g')) AS digits,
              {K.in_list('t.name', sorted(_ORG_WORDS))} AS org,
              regexp_matches(t.name, '^\\p{{Lu}}') AND regexp_full_match(t.name, '\\p{{L}}+') AS ua
       FROM mtk t JOIN nw s ON t.sid = s.sid),
mg AS (SELECT *, line <> coalesce(lag(line) OVER (PARTITION BY sid ORDER BY i), -1) AS fil,
              coalesce(regexp_matches(lag(name) OVER (PARTITION BY sid ORDER BY i), '[,.]$'), false) AS listed FROM mf),
mh AS (SELECT *, CASE WHEN digits >= 9 THEN 'PHONE_OFFICE' WHEN org THEN 'ORGANIZATION'
                      WHEN ua AND fil THEN 'NAME_GIVEN' END AS l0 FROM mg),
mlab AS (SELECT *, coalesce(l0, CASE WHEN ua AND lag(l0) OVER (PARTITION BY sid ORDER BY i) = 'NAME_GIVEN' THEN 'NAME_SURNAME'
                                     WHEN ua AND lang <> 'en' AND listed THEN 'ADDRESS_CITY' END) AS entity FROM mh),
mi AS (SELECT *, sum(CASE WHEN pe IS NULL OR "start" - pe >= 4 THEN 1 ELSE 0 END)
                 OVER (PARTITION BY sid, entity ORDER BY i ROWS UNBOUNDED PRECEDING) AS isl
       FROM (SELECT *, lag("end") OVER (PARTITION BY sid, entity ORDER BY i) AS pe FROM mlab WHERE entity IS NOT NULL) z),
ml AS (SELECT m.doc_id, m.s + m.o AS "start", m.e + m.o AS "end", m.entity, substr(n.text, m.s + 1, m.e - m.s) AS name, CAST(1.0 AS DOUBLE) AS score
       FROM (SELECT sid, doc_id, seg_start AS o, entity, isl, arg_min("start", i) AS s, arg_max("end", i) AS e FROM mi GROUP BY sid, doc_id, seg_start, entity, isl) m
       JOIN nw n ON m.sid = n.sid),
rx AS ({_entities_sql(src, 'doc_id', 'text')}),
gl AS (WITH {locs_sql(src)} SELECT * FROM out),
gfirst AS (SELECT doc_id, country_pos, "start", "end",
                  CASE kind WHEN 'city' THEN 'ADDRESS_CITY' WHEN 'state' THEN 'ADDRESS_COUNTRY_DIVISION' ELSE 'ADDRESS_COUNTRY' END AS entity,
                  surface AS name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, country_pos, kind ORDER BY rank, surface) AS r FROM gl) q
           WHERE r = 1 AND NOT {K.in_list('surface', S.LOCATION_BLACKLIST)}),
names_orgs AS (SELECT DISTINCT doc_id, name FROM ml WHERE {K.in_list('entity', S.NAME_OR_ORG_TAGS)}),
fused0 AS (
  SELECT ml.doc_id, l.lang, 0 AS src, ml."start" AS o, 0 AS o2, ml."start", ml."end", ml.entity, ml.name, ml.score
  FROM ml JOIN {src} l ON ml.doc_id = l.doc_id WHERE {K.in_list('ml.entity', S.FUSION_ML_TAGS)}
  UNION ALL
  SELECT rx.doc_id, l.lang, 1, rx.seq, 0, rx."start", rx."end", rx.entity, rx.name, rx.score
  FROM rx JOIN {src} l ON rx.doc_id = l.doc_id WHERE {K.in_list('rx.entity', S.FUSION_REGEX_TAGS)}
  UNION ALL
  SELECT ml.doc_id, l.lang, 2, ml."start", 0, ml."start", ml."end", ml.entity, ml.name, ml.score
  FROM ml JOIN {src} l ON ml.doc_id = l.doc_id WHERE l.lang <> 'en' AND {K.in_list('ml.entity', list(S.GAZETTEER_TAG.values()))}
  UNION ALL
  SELECT g.doc_id, l.lang, 2, {gord}, g.country_pos, g."start", g."end", g.entity, g.name, CAST(1.0 AS DOUBLE)
  FROM gfirst g JOIN {src} l ON g.doc_id = l.doc_id
  WHERE l.lang = 'en' AND NOT EXISTS (SELECT 1 FROM names_orgs n WHERE n.doc_id = g.doc_id AND n.name = g.name)),
fused AS (SELECT f.doc_id, f.lang, f."start", f."end", f.entity, f.name, f.score, s.text,
                 CAST(row_number() OVER (PARTITION BY f.doc_id ORDER BY src, o, o2, f."start", f.entity) - 1 AS INTEGER) AS seq
          FROM fused0 f JOIN {src} s ON s.doc_id = f.doc_id),
{_post_sql('fused', 'fin')}"""


def _alias_sql(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {K.q(k)} THEN {K.q(v)}" for k, v in S.LANGUAGE_MAP.items()) + f" ELSE {x} END"


# HTML bodies: pages, every fifth with the language alias zh, envelopes from the host.
def _page_mails(spark, sf_dir):
    pages = read_text_table(spark, sf_dir, "pages", "page_id", ["page_id", "url", "html"])
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    lang = F.when(F.col("page_id") % 5 == 0, "zh").otherwise(F.regexp_extract("html", r'lang="(\w+)"', 1))
    address = lambda who, name: F.struct(F.concat(F.lit(f"{who}@"), host).alias("address"), name.alias("displayName"))
    meta = F.struct(address("info", F.lit("")).alias("senderEmailAddress"),
                    F.array(address("info", host), address("news", F.lit("News"))).alias("fromEmailAddresses"),
                    F.array(address("help", F.lit("Help")), address("news", F.lit("N"))).alias("replyToEmailAddresses"))
    return pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), lang.alias("lang"), meta.alias("meta"))


_PAGES = f"""mails AS (SELECT page_id AS doc_id, url, html AS text, {_alias_sql("l")} AS lang FROM (
  SELECT *, CASE WHEN page_id % 5 = 0 THEN 'zh' ELSE regexp_extract(html, 'lang="(\\w+)"', 1) END AS l FROM pages))"""
_PAGES_CLEAN = f"{_PAGES},\nclean AS (SELECT doc_id, {sql_clean('text')} AS text, lang FROM mails)"
# RSP-6 states the reference's order: located in the body as it came, then cleaned, then entities.
_BODIES = f"""{_PAGES},
{_locate_ctes('mails')},
sigs AS (SELECT * FROM (SELECT loc.doc_id, {sql_clean('loc.signature')} AS text, m.lang FROM loc JOIN mails m ON m.doc_id = loc.doc_id)
         WHERE length(text) > 0),
{_extract_ctes()}"""


@register("rsp_signature_blocks", f"WITH {_PAGES_CLEAN},\n{_locate_ctes('clean')} SELECT * FROM loc")
def rsp_signature_blocks(spark, sf_dir):
    """RSP-8 (signature form): HTML bodies cleaned, then their signatures located with the model of the mapped language."""
    return _located(P.clean_and_locate(_page_mails(spark, sf_dir).drop("meta")))


@register("rsp_signature_ner", f"""WITH {_PAGES_CLEAN}, sigs AS (SELECT * FROM clean WHERE length(text) > 0),\n{_extract_ctes()}
SELECT doc_id, seq, "start", "end", entity, name, score, lang FROM fin""")
def rsp_signature_ner(spark, sf_dir):
    """RSP-8 (entity form): cleaned bodies taken as signatures, the raw entity list; models over 400-token windows."""
    return _exploded(P.clean_and_extract(_page_mails(spark, sf_dir), gazetteer_df(spark)))


@register("agg_texts_without_signature", f"""WITH {_locate_ctes('documents')}
SELECT d.lang, count(*) AS n_texts, count(*) FILTER (WHERE loc.signature = '') AS n_without_signature FROM loc JOIN documents d ON d.doc_id = loc.doc_id GROUP BY 1""")
def agg_texts_without_signature(spark, sf_dir):
    """AGG-10: texts per language, and those without a signature."""
    x = P.locate_signatures(_docs(spark, sf_dir))
    return x.groupBy("lang").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(F.col("located.signature") == "").alias("n_without_signature"))


@register("fus_extract_entities", f"""WITH {_locate_ctes('documents')},
sigs AS (SELECT loc.doc_id, loc.signature AS text, d.lang FROM loc JOIN documents d ON d.doc_id = loc.doc_id WHERE length(loc.signature) > 0),
{_extract_ctes()}
SELECT doc_id, lang, "start", "end", entity, name, score, seq FROM fin""")
def fus_extract_entities(spark, sf_dir):
    """FUS-1/FUS-3: model, pattern and gazetteer entities (model places for languages other than English) of every
    located signature, fused and post-filtered."""
    from mailsift.session import written
    x = P.locate_signatures(_docs(spark, sf_dir))
    x = written(x.select("doc_id", F.col("located.signature").alias("text"), "lang"), "signatures")
    return _exploded(P.block_entities(x, gazetteer_df(spark)))


def body_responses(spark, sf_dir):
    return P.parse_bodies(_page_mails(spark, sf_dir), gazetteer_df(spark), meta_col="meta")


_SENDERS = """snd AS (SELECT doc_id, 1 AS a, 0 AS b, 'info@' || host AS address, '' AS name, 'SENDER' AS t FROM host
  UNION ALL SELECT doc_id, 2, 0, 'info@' || host, host, 'FROM' FROM host
  UNION ALL SELECT doc_id, 2, 1, 'news@' || host, 'News', 'FROM' FROM host
  UNION ALL SELECT doc_id, 3, 0, 'help@' || host, 'Help', 'REPLY_TO' FROM host
  UNION ALL SELECT doc_id, 3, 1, 'news@' || host, 'N', 'REPLY_TO' FROM host
  UNION ALL SELECT doc_id, 4, seq, name, '', 'SIGNATURE_EMAIL_ADDRESS' FROM fin WHERE entity = 'EMAIL'),
sgrp AS (SELECT doc_id, address, min({'a': a, 'b': b}) AS o, coalesce(arg_min(name, {'a': a, 'b': b}) FILTER (WHERE name <> ''), '') AS name,
                string_agg(t, ',' ORDER BY a, b) AS source_types, bool_or(t IN ('SENDER', 'FROM')) AS ok FROM snd WHERE address <> '' GROUP BY 1, 2),
sout AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INTEGER) AS pos, address, name, 5 AS confidenceScore,
                source_types FROM sgrp WHERE ok)"""
_HOSTS = "host AS (SELECT m.doc_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM mails m JOIN sigs s ON s.doc_id = m.doc_id)"


@register("rsp_parse_bodies", f"""WITH {_BODIES}, {_HOSTS}, {_SENDERS},
vals AS (SELECT doc_id, {", ".join(f"coalesce(string_agg(name, '|' ORDER BY seq) FILTER (WHERE entity = '{t}'), '') AS {c}" for t, c in
        (("EMAIL", "emails"), ("URL", "web_sites"), ("ORGANIZATION", "organizations"), ("ADDRESS_CITY", "cities"), ("PHONE_OFFICE", "office_phones")))},
        coalesce(arg_min(name, seq) FILTER (WHERE entity = 'NAME_GIVEN'), '') AS given, coalesce(arg_min(name, seq) FILTER (WHERE entity = 'NAME_SURNAME'), '') AS surname
        FROM (SELECT s.doc_id, f.* EXCLUDE (doc_id) FROM sigs s LEFT JOIN fin f ON f.doc_id = s.doc_id) GROUP BY doc_id),
who AS (SELECT doc_id, string_agg(address || ' ' || name || ' ' || confidenceScore || ' ' || source_types, '|' ORDER BY pos) AS senders FROM sout GROUP BY 1)
SELECT m.doc_id, CASE WHEN s.text IS NULL THEN 'NO_SIGNATURE_BLOCK' ELSE 'SUCCESS' END AS parse_status, s.text AS block, given, surname, emails, web_sites,
       organizations, cities, office_phones, senders
FROM mails m LEFT JOIN sigs s ON s.doc_id = m.doc_id LEFT JOIN vals ON vals.doc_id = m.doc_id LEFT JOIN who ON who.doc_id = m.doc_id""")
def rsp_parse_bodies(spark, sf_dir):
    """RSP-6/7/8 with UDF-1 per language: the nested response of each HTML body, read back field by field."""
    r = body_responses(spark, sf_dir)
    f = F.col("signatureFields")
    joined = lambda field, value: F.when(f.isNotNull(), F.array_join(F.transform(F.coalesce(f[field], F.expr("array()")), lambda e: e[value]), "|"))
    offices = F.filter(f["phoneNumbers"], lambda p: p["phoneType"] == "OFFICE")
    sender = F.transform("senderEmailData", lambda s: F.concat_ws(" ", s["address"], s["name"], s["confidenceScore"].cast("string"),
                                                                   F.array_join(s["sourceTypes"], ",")))
    return r.select("doc_id", F.col("parseStatusType").alias("parse_status"), "signatureBlock.block",
                    f["names"][0]["given"].alias("given"), f["names"][0]["surname"].alias("surname"),
                    *[joined(a, b).alias(c) for a, b, c in (("emails", "address", "emails"), ("webSites", "url", "web_sites"),
                                                             ("organizations", "name", "organizations"), ("cities", "name", "cities"))],
                    F.when(f.isNotNull(), F.coalesce(F.array_join(F.transform(offices, lambda p: p["number"]), "|"), F.lit(""))).alias("office_phones"),
                    F.array_join(sender, "|").alias("senders"))


@register("rsp_parse_bodies_long", f"""{_resp_long_sql(_BODIES, ents="fin", docs="sigs")}""")
def rsp_parse_bodies_long(spark, sf_dir):
    """RSP-6 + RSH-1: the body pipeline's nested responses flattened to (tag, value) rows, all tags (mails without a
    signature block have no rows)."""
    return response_to_long(body_responses(spark, sf_dir))


@register("rsp_parse_bodies_senders", f"WITH {_BODIES}, {_HOSTS}, {_SENDERS} SELECT * FROM sout")
def rsp_parse_bodies_senders(spark, sf_dir):
    """RSP-4/RSP-6: sender data of the parsed HTML bodies, signature addresses among them."""
    return sender_to_long(body_responses(spark, sf_dir))


# ------------------------------------------------------------------------------ signature-only pipeline
def signature_responses(spark, sf_dir):
    """Each conversation turn as a signature block; user turns in English, others under the alias cn."""
    conv = read_table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    blocks = conv.select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "text",
                         F.when(F.col("role") == "user", "en").otherwise("cn").alias("lang"), _meta(F.col("conv_id"), F.col("role")).alias("meta"))
    return P.parse_signatures(blocks, gazetteer_df(spark), meta_col="meta")


_TURNS = f"""turns AS (SELECT concat(conv_id, ':', turn) AS doc_id, conv_id, role, {sql_clean('text')} AS text, CASE WHEN role = 'user' THEN 'en' ELSE 'zh-hans' END AS lang
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
sigs AS (SELECT doc_id, text, lang FROM turns WHERE length(text) > 0),
{_extract_ctes()}"""


@register("rsp_parse_signatures", f"""WITH {_TURNS}
SELECT t.doc_id, CASE WHEN length(text) > 0 THEN 'SUCCESS' ELSE 'NO_SIGNATURE_BLOCK' END AS parse_status, CASE WHEN length(text) > 0 THEN text END AS block,
       CAST(CASE WHEN length(text) > 0 THEN coalesce(n, 0) END AS BIGINT) AS n_values
FROM turns t LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE entity NOT LIKE 'NAME%' AND entity <> 'LINKEDIN') AS n FROM fin GROUP BY 1) f ON f.doc_id = t.doc_id""")
def rsp_parse_signatures(spark, sf_dir):
    """RSP-7: signature-only pipeline, the response of each block: status, cleaned block and the number of its listed values."""
    r = signature_responses(spark, sf_dir)
    lists = [f.name for f in r.schema["signatureFields"].dataType.fields if f.name != "names"]
    n = sum((F.coalesce(F.size(F.filter(F.col(f"signatureFields.{c}"), lambda x: x.isNotNull())), F.lit(0)) for c in lists), F.lit(0))
    return r.select("doc_id", F.col("parseStatusType").alias("parse_status"), "signatureBlock.block",
                    F.when(F.col("signatureFields").isNotNull(), n).cast("long").alias("n_values"))


@register("rsp_parse_signatures_long", _resp_long_sql(_TURNS, ents="fin", docs="sigs"))
def rsp_parse_signatures_long(spark, sf_dir):
    """RSP-7 + RSH-1: signature-only pipeline (each conversation turn as a signature block),
    nested responses flattened to (tag, value) rows."""
    return response_to_long(signature_responses(spark, sf_dir))


# ------------------------------------------------------------------------------ language detection
_HANS, _HANT = "我们的学校在这个国家，我们说中文。", "我們的學校在這個國家，我們說中文。"
_SHARE = "(CAST(('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0)"


@register("udf_detect_language", f"""
WITH d AS (SELECT doc_id, lang, CASE WHEN doc_id % 40 = 0 THEN {K.q(_HANS)} WHEN doc_id % 40 = 1 THEN {K.q(_HANT)} ELSE text END AS text,
                  {_SHARE} >= 0.5 AS fit FROM documents),
g AS (SELECT DISTINCT doc_id, lang, fit, gram FROM (
  SELECT doc_id, lang, fit, unnest(list_transform(range(1, length(t) - 1), lambda i: t[i:i + 2])) AS gram FROM (SELECT *, lower(text) AS t FROM d))
  WHERE regexp_full_match(gram, '\\p{{L}}{{3}}')),
n AS (SELECT lang, count(*) AS n FROM d WHERE fit AND doc_id % 40 > 1 GROUP BY 1),
prof AS (SELECT c.lang, gram, length(bin(c * 1000 // n + 1)) AS weight FROM (
           SELECT lang, gram, count(*) AS c FROM g WHERE fit AND doc_id % 40 > 1 GROUP BY 1, 2) c JOIN n ON n.lang = c.lang WHERE c * 1000 >= n),
zh AS (SELECT doc_id, CASE WHEN han > 0 AND 2 * han > letters THEN CASE WHEN f > s THEN 'zh-hant' ELSE 'zh-hans' END END AS zh FROM (
  SELECT doc_id, length(regexp_replace(text, '[^\\x{{4E00}}-\\x{{9FFF}}]', '', 'g')) AS han, length(regexp_replace(text, '\\P{{L}}', '', 'g')) AS letters,
         length(regexp_replace(text, '[^{S.SIMPLIFIED_ONLY}]', '', 'g')) AS s, length(regexp_replace(text, '[^{S.TRADITIONAL_ONLY}]', '', 'g')) AS f FROM d)),
sc AS (SELECT g.doc_id, p.lang, sum(weight) AS score FROM g JOIN prof p ON p.gram = g.gram WHERE NOT fit GROUP BY 1, 2),
best AS (SELECT doc_id, max({{'s': score, 'l': lang}}).l AS best FROM sc GROUP BY 1)
SELECT d.doc_id, d.lang, coalesce(zh, best, 'en') AS detected_lang FROM d JOIN zh USING (doc_id) LEFT JOIN best USING (doc_id) WHERE NOT fit""")
def udf_detect_language(spark, sf_dir):
    """UDF-4: letter-trigram profiles fitted on one half of the documents (by hash), languages of the other half; every
    fortieth document is a Chinese text in either script."""
    docs = read_text_table(spark, sf_dir, "documents", "doc_id", ["doc_id", "text", "lang"])
    no = F.col("doc_id") % 40
    docs = docs.withColumn("text", F.when(no == 0, _HANS).when(no == 1, _HANT).otherwise(F.col("text")))
    fit = hash_fraction("doc_id") >= 0.5
    profile = fit_language_profile(docs.where(fit & (no > 1)))
    held_out = docs.where(~fit)
    return detect_language(held_out, profile).join(held_out.select("doc_id", "lang"), "doc_id")
