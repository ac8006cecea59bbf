"""Registered queries: pattern extraction and service counters (EXT-1..5, AGG-10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift import settings as S
from mailsift.functions.text import clean_mail_text
from mailsift.operators.extract import (entity_counts, phone_entity_array, phone_spans, regex_entities,
                                        regex_entity_array, service_counters)
from mailsift.plans import sqlkit as K
from mailsift.plans.registry import register
from mailsift.session import read_table
from mailsift.sources.readers import read_text_table

# Fixed synthetic suffix: no driver table has a surviving LinkedIn hit or a
# "[http...]" link, so both engines append the same literal text.
LINKEDIN_SUFFIX = (" Profile: https://www.linkedin.com/in/jane-doe-42> or linkedin.com"
                   " and www.linkedin.com/company/acme, mail jane@acme.io w:www.acme.io.")


def _entities_sql(src: str, id_col: str, text_expr: str) -> str:
    em = K.spans(src, id_col, text_expr, S.EMAIL_PATTERN)
    lk0 = K.spans(src, id_col, text_expr, S.LINKEDIN_PATTERN)
    wb0 = K.spans(src, id_col, text_expr, S.WEB_PATTERN)
    url_name = K.replace_chain("regexp_replace(w.name, '\\.$', '')", S.URL_PREFIX_REPLACEMENTS)
    return f"""
WITH em AS {em},
lk0 AS {lk0},
lk AS (SELECT {id_col}, i, "start",
              CAST(CASE WHEN ends_with(name, '>') THEN "end" - 1 ELSE "end" END AS INTEGER) AS "end",
              regexp_replace(name, '>$', '') AS name
       FROM lk0 WHERE contains(name, 'linkedin') AND name <> 'linkedin.com'
             AND NOT contains(name, '@') AND NOT contains(name, 'malito')),
wb0 AS {wb0},
wb1 AS (SELECT w.{id_col}, w.i, w."start" AS s0,
              CAST(CASE WHEN ends_with(w.name, '.') THEN w."end" - 1 ELSE w."end" END AS INTEGER) AS "end",
              regexp_replace(w.name, '\\.$', '') AS whole, {url_name} AS name
       FROM wb0 w
       WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.{id_col} = w.{id_col} AND lk.name = w.name)
         AND NOT EXISTS (SELECT 1 FROM em WHERE em.{id_col} = w.{id_col} AND em.name = w.name)
         AND NOT contains(w.name, '@') AND NOT contains(w.name, 'malito')),
wb AS (SELECT {id_col}, i, CAST(CASE WHEN ends_with(whole, name) THEN "end" - length(name) ELSE s0 END AS INTEGER) AS "start",
              "end", name FROM wb1),
allents AS (
  SELECT {id_col}, 0 AS r, i, "start", "end", 'EMAIL' AS entity, name FROM em
  UNION ALL SELECT {id_col}, 1, i, "start", "end", 'LINKEDIN', name FROM lk
  UNION ALL SELECT {id_col}, 2, i, "start", "end", 'URL', name FROM wb)
SELECT {id_col}, CAST(row_number() OVER (PARTITION BY {id_col} ORDER BY r, i) - 1 AS INTEGER) AS seq,
       "start", "end", entity, name, CAST(1.0 AS DOUBLE) AS score
FROM allents"""


def _phone_sql(src: str, id_col: str, text_expr: str, regions: list[str]) -> str:
    parts = []
    for r in regions:
        sp = K.spans(src, id_col, text_expr, S.PHONE_PATTERNS[r])
        parts.append(f"""SELECT {id_col}, {K.q(r)} AS region, CAST(i - 1 AS INTEGER) AS seq, "start", "end", name FROM {sp}""")
    return "\nUNION ALL\n".join(parts)


@register("ext_email_spans", f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS seq, "start", "end", name
FROM {K.spans('documents', 'doc_id', 'text', S.EMAIL_PATTERN)}""")
def ext_email_spans(spark, sf_dir):
    """EXT-1: e-mail spans with offsets over whole documents."""
    ents = regex_entities(read_table(spark, sf_dir, "documents"))
    ents = ents.where(F.col("entity") == "EMAIL")
    return ents.select("doc_id", "seq", "start", "end", "name")


@register("ext_regex_entities_documents", _entities_sql("documents", "doc_id", "text"))
def ext_regex_entities_documents(spark, sf_dir):
    """EXT-4: all pattern entities of documents with offsets and score."""
    return regex_entities(read_table(spark, sf_dir, "documents"))


@register("ext_regex_entities_pages", _entities_sql("pages", "page_id", "html"))
def ext_regex_entities_pages(spark, sf_dir):
    """EXT-2/EXT-4 on raw HTML pages."""
    return regex_entities(read_table(spark, sf_dir, "pages"), id_col="page_id", text_col="html")


@register("ext_url_spans_page_url", _entities_sql("pages", "page_id", "url"))
def ext_url_spans_page_url(spark, sf_dir):
    """EXT-2 on endpoint URLs."""
    return regex_entities(read_table(spark, sf_dir, "pages"), id_col="page_id", text_col="url")


@register("ext_linkedin_spans", _entities_sql("documents", "doc_id", f"(text || {K.q(LINKEDIN_SUFFIX)})"))
def ext_linkedin_spans(spark, sf_dir):
    """EXT-3: LinkedIn/URL/e-mail precedence on documents with a fixed profile suffix."""
    docs = read_table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", F.concat("text", F.lit(LINKEDIN_SUFFIX)).alias("text"))
    return regex_entities(docs)


@register("ext_phone_us_ca", _phone_sql("documents", "doc_id", "text", ["us", "ca"]))
def ext_phone_us_ca(spark, sf_dir):
    """EXT-5: us/ca phone spans per region over documents."""
    return phone_spans(read_table(spark, sf_dir, "documents"), ["us", "ca"])


# The uk pattern is anchored at both ends and '.' stops at line breaks, so its look-ahead only
# asks for at least ten digits on the (single) matched line; RE2 form for the oracle. Java's '$'
# may also stop before one final line terminator.
def _uk_sql(src: str) -> str:
    return rf"""
SELECT doc_id, 'uk' AS region, 0 AS seq, 0 AS "start", CAST(length(body) AS INTEGER) AS "end", body AS name
FROM (SELECT doc_id, regexp_replace(text, '(\r\n|[\n\r\x{{85}}\x{{2028}}\x{{2029}}])$', '') AS body FROM {src}) d
WHERE regexp_full_match(body, '(\+?44)?( ?\(\d+\))?[ \d]+(#\d+)?')
  AND length(regexp_replace(body, '[^0-9]', '', 'g')) >= 10"""


_UK_SQL = _uk_sql("documents")
# Phone lines made of order keys: with and without prefix, brackets and extension, too few digits, and other text around.
_UK_LINES = """(SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN '+44 (20) 7946' || lpad(o_orderkey::VARCHAR, 8, '0')
  WHEN 1 THEN '44 1632 ' || lpad(o_orderkey::VARCHAR, 8, '0') || '#12' WHEN 2 THEN '020 ' || o_orderkey WHEN 3 THEN 'call +44 20 7946 0' || o_orderkey
  ELSE lpad(o_orderkey::VARCHAR, 12, '1') || chr(10) END AS text FROM orders)"""


@register("ext_phone_uk", _uk_sql(_UK_LINES))
def ext_phone_uk(spark, sf_dir):
    """EXT-5: the uk pattern (anchored, with a look-ahead) over phone lines made of order keys."""
    key, no = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 5
    line = (F.when(no == 0, F.concat(F.lit("+44 (20) 7946"), F.lpad(key, 8, "0"))).when(no == 1, F.concat(F.lit("44 1632 "), F.lpad(key, 8, "0"), F.lit("#12")))
            .when(no == 2, F.concat(F.lit("020 "), key)).when(no == 3, F.concat(F.lit("call +44 20 7946 0"), key))
            .otherwise(F.concat(F.lpad(key, 12, "1"), F.lit("\n"))))
    return phone_spans(read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), line.alias("text")), ["uk"])


@register("ext_phone_chn_fax", _phone_sql("documents", "doc_id", "text", ["chn"]) + f"""
UNION ALL
SELECT doc_id, 'us_fax' AS region, CAST(i - 1 AS INTEGER) AS seq, "start", "end", name
FROM {K.spans('documents', 'doc_id', 'text', S.FAX_PATTERNS['us'])}""")
def ext_phone_chn_fax(spark, sf_dir):
    """EXT-5: chn mobile pattern and the us fax pattern over documents."""
    docs = read_table(spark, sf_dir, "documents")
    phones = phone_spans(docs, ["chn"])
    fax = phone_spans(docs, ["us"], fax=True).withColumn("region", F.lit("us_fax"))
    return phones.unionByName(fax)


_COUNT_SQL = f"""
WITH ents AS ({_entities_sql('documents', 'doc_id', 'text')}),
ph AS (SELECT doc_id, "start", "end", 'PHONE' AS entity, name FROM ({_phone_sql('documents', 'doc_id', 'text', ['us'])}) p),
allents AS (SELECT doc_id, entity FROM ents UNION ALL SELECT doc_id, entity FROM ph)
SELECT d.lang, a.entity, count(*) AS n_entities, count(DISTINCT a.doc_id) AS n_docs
FROM allents a JOIN documents d ON a.doc_id = d.doc_id
GROUP BY d.lang, a.entity"""


def entity_counts_plan(spark, sf_dir):
    """One scan, one projection: pattern and phone entities in one per-row array, exploded and
    counted (partial aggregation before the shuffle)."""
    docs = read_text_table(spark, sf_dir, "documents", "doc_id", ["doc_id", "lang", "text"])
    ents = F.concat(regex_entity_array(F.col("text")), phone_entity_array(F.col("text"), "us"))
    rows = docs.select("doc_id", "lang", F.explode_outer(F.transform(ents, lambda e: e["entity"])).alias("entity"))
    return entity_counts(rows.where(F.col("entity").isNotNull()), ["lang", "entity"])


@register("agg_entity_counts_by_lang", _COUNT_SQL)
def agg_entity_counts_by_lang(spark, sf_dir):
    """Flagship (EXT-1,2,5 + AGG-10): entities per language and tag over all documents."""
    return entity_counts_plan(spark, sf_dir)


def _clean_pages_sql():
    from mailsift.plans.q_clean import sql_clean
    src = f"(SELECT page_id, {sql_clean('html')} AS text FROM pages)"
    return f"""WITH e AS ({_entities_sql(src, 'page_id', 'text')})
SELECT entity, count(*) AS n_entities, count(DISTINCT page_id) AS n_docs FROM e GROUP BY entity"""


@register("agg_entity_counts_clean_pages", _clean_pages_sql())
def agg_entity_counts_clean_pages(spark, sf_dir):
    """AGG-10 over cleaned pages: entities per tag after the mail cleaning chain."""
    pages = read_table(spark, sf_dir, "pages")
    cleaned = pages.select("page_id", clean_mail_text("html").alias("text"))
    ents = regex_entities(cleaned, id_col="page_id")
    return ents.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entities"),
                                      F.countDistinct("page_id").alias("n_docs"))


@register("agg_service_counters", """
SELECT event_type, count(*) AS n_processed, count(*) FILTER (WHERE value > 45) AS n_errors,
       arg_max(value, (ts, event_id)) AS latest_score
FROM events GROUP BY event_type""")
def agg_service_counters(spark, sf_dir):
    """AGG-10: processed / exception counters and the latest score per tag (events as the stream of
    scored predictions; a value above 45 stands for a failed request)."""
    ev = read_table(spark, sf_dir, "events").withColumn("is_error", F.col("value") > 45)
    return service_counters(ev, "event_type", "ts", "value", "is_error", "event_id")


@register("agg_texts_per_language", """
SELECT lang, count(*) AS n_texts, count(*) FILTER (WHERE length(text) - length(replace(text, chr(10), '')) < 3)
       AS n_short_texts FROM documents GROUP BY lang""")
def agg_texts_per_language(spark, sf_dir):
    """AGG-10: texts per language and texts with fewer than three line breaks (raw-signature path)."""
    from mailsift.functions.text import newline_count
    docs = read_table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_texts"),
                                    F.count_if(newline_count("text") < 3).alias("n_short_texts"))


@register("ext_phone_uk_chn_fax", _UK_SQL + "\nUNION ALL\n" + _phone_sql("documents", "doc_id", "text", ["chn"]) + f"""
UNION ALL
SELECT doc_id, 'us_fax' AS region, CAST(i - 1 AS INTEGER) AS seq, "start", "end", name
FROM {K.spans('documents', 'doc_id', 'text', S.FAX_PATTERNS['us'])}""")
def ext_phone_uk_chn_fax(spark, sf_dir):
    """EXT-5: uk (look-ahead, anchored) and chn phone patterns, plus us fax, in one table."""
    docs = read_table(spark, sf_dir, "documents")
    phones = phone_spans(docs, ["uk", "chn"])
    fax = phone_spans(docs, ["us"], fax=True).withColumn("region", F.lit("us_fax"))
    return phones.unionByName(fax)
