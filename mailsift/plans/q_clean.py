"""Registered queries: mail cleaning and scalar functions (CLN-1..8, FN-1..9, FLT-1..3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift import settings as S
from mailsift.functions import text as T
from mailsift.plans import sqlkit as K
from mailsift.plans.registry import register
from mailsift.session import read_table
from mailsift.sources.readers import read_text_table

# Unicode White_Space without CR/LF, spelled out for RE2 (Java uses (?U)).
_WS_NO_CRLF = r"[\t\x0B\f \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# Fixed synthetic link text (no table contains "[http...]").
LINK_SUFFIX = " see [http://example.org/a b] and [https://x.y/z]\n\n\n\nend    "


def sql_head(x):
    return f"regexp_replace({x}, '(?s)<head>.+?</head>', '', 'g')"


def sql_html(x):
    x = f"regexp_replace({x}, '</p>', '</p>' || chr(10), 'g')"
    x = f"regexp_replace({x}, '<br\\s?/>|<br>', chr(10), 'g')"
    return f"regexp_replace({x}, '<.*?>|&([a-z0-9]+|#[0-9]{{1,6}}|#x[0-9a-f]{{1,6}});', '', 'g')"


def sql_links(x):
    return f"regexp_replace({x}, '\\[(http.*?)\\]', '', 'g')"


def sql_blanks(x):
    return f"regexp_replace({x}, '{_WS_NO_CRLF}{{2,}}', ' ', 'g')"


def sql_breaks(x):
    return f"regexp_replace({x}, '[\\r\\n]{{3,}}', chr(10) || chr(10), 'g')"


def sql_rstrip(x):
    return f"regexp_replace({x}, '{_WS}+$', '')"


def sql_clean(x):
    return sql_rstrip(sql_breaks(sql_blanks(sql_links(sql_html(sql_head(x))))))


def _pages(spark, sf_dir):
    return read_text_table(spark, sf_dir, "pages", "page_id")


@register("cln_remove_head", f"SELECT page_id, {sql_head('html')} AS text FROM pages")
def cln_remove_head(spark, sf_dir):
    """CLN-2: drop <head>...</head>."""
    return _pages(spark, sf_dir).select("page_id", T.remove_head("html").alias("text"))


@register("cln_html", f"SELECT page_id, {sql_html(sql_head('html'))} AS text FROM pages")
def cln_html(spark, sf_dir):
    """CLN-3: paragraph/line-break handling, tag and entity removal (after CLN-2)."""
    return _pages(spark, sf_dir).select("page_id", T.clean_html(T.remove_head("html")).alias("text"))


@register("cln_links_blanks_breaks", f"""
SELECT doc_id, {sql_breaks(sql_blanks(sql_links('(text || ' + K.q(LINK_SUFFIX) + ')')))} AS text FROM documents""")
def cln_links_blanks_breaks(spark, sf_dir):
    """CLN-4/5/6: bracketed links, blank runs (Unicode), 3+ line breaks, on documents + fixed suffix."""
    docs = read_text_table(spark, sf_dir, "documents", "doc_id", ["doc_id", "text"])
    x = F.concat("text", F.lit(LINK_SUFFIX))
    return docs.select("doc_id", T.collapse_line_breaks(T.collapse_blanks(T.remove_links(x))).alias("text"))


@register("cln_mail_text", f"SELECT page_id, {sql_clean('html')} AS text, length({sql_clean('html')}) AS n_chars FROM pages")
def cln_mail_text(spark, sf_dir):
    """CLN-1 (+FN-8): the full cleaning chain over raw pages."""
    cleaned = _pages(spark, sf_dir).select("page_id", T.clean_mail_text("html").alias("text"))
    return cleaned.select("page_id", "text", F.length("text").alias("n_chars"))


@register("cln_comments", "SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS text FROM pages")
def cln_comments(spark, sf_dir):
    """CLN-7: HTML comments removed (intent of the comment rule)."""
    return _pages(spark, sf_dir).select("page_id", T.remove_html_comments("html").alias("text"))


@register("cln_mail_json", f"SELECT page_id, {sql_clean('html')} AS body FROM pages")
def cln_mail_json(spark, sf_dir):
    """CLN-8: cleaned text wrapped as {"data":{"body":...}}; checked by reading the body back."""
    js = _pages(spark, sf_dir).select("page_id", T.mail_json("html").alias("js"))
    return js.select("page_id", F.get_json_object("js", "$.data.body").alias("body"))


@register("fn_scalar_functions", f"""
SELECT page_id,
       string_split(url, '/')[-2] AS model_type,
       length(regexp_replace(html, '[^0-9]', '', 'g')) AS n_digits,
       length(html) - length(replace(html, chr(10), '')) AS n_newlines,
       len(string_split_regex(url, '[/:.]')) AS n_url_parts,
       {K.replace_chain("url", S.URL_PREFIX_REPLACEMENTS + ["http:", "https:"])} AS url_stripped,
       regexp_replace(' ' || url || chr(10) || ' ', '^{_WS}+|{_WS}+$', '', 'g') AS url_trimmed
FROM pages""")
def fn_scalar_functions(spark, sf_dir):
    """FN-1 model type, FN-5 sequential replace, FN-6 digits, FN-7 newlines, FN-8 strip, FN-9 split."""
    p = _pages(spark, sf_dir)
    return p.select(
        "page_id",
        T.model_type("url").alias("model_type"),
        T.digit_count("html").alias("n_digits"),
        T.newline_count("html").alias("n_newlines"),
        F.size(T.split_on("url", "/:.")).alias("n_url_parts"),
        T.replace_all("url", S.URL_PREFIX_REPLACEMENTS + ["http:", "https:"]).alias("url_stripped"),
        T.strip_all(F.concat(F.lit(" "), "url", F.lit("\n "))).alias("url_trimmed"),
    )


@register("fn_date_stamps", """
SELECT event_id, strftime(ts, '%Y_%m_%d_%H_%M') AS minute_stamp, strftime(ts, '%d/%m/%Y') AS day_stamp
FROM events""")
def fn_date_stamps(spark, sf_dir):
    """FN-2: file-name minute stamp and LAST_UPDATE day stamp."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_id", T.minute_stamp("ts").alias("minute_stamp"), T.day_stamp("ts").alias("day_stamp"))


_LANG_CASE = "CASE " + " ".join(f"WHEN x = {K.q(k)} THEN {K.q(v)}" for k, v in S.LANGUAGE_MAP.items()) + " ELSE x END"


@register("flt_language_map", f"""
SELECT doc_id, code, {_LANG_CASE.replace('x', 'code')} AS language
FROM (SELECT doc_id, unnest(['cn', 'cn-tr', 'zh', 'zh_hans', 'zh_hant', lang]) AS code FROM documents)""")
def flt_language_map(spark, sf_dir):
    """FLT-1: alias mapping; unmapped codes pass through (every row checked with the alias codes)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    codes = F.array(*[F.lit(c) for c in ["cn", "cn-tr", "zh", "zh_hans", "zh_hant"]], F.col("lang"))
    x = docs.select("doc_id", F.explode(codes).alias("code"))
    return x.select("doc_id", "code", T.map_language("code").alias("language"))


@register("flt_service_lookup", """
SELECT page_id, url FROM pages WHERE contains(url, '{' || 'en' || '}') OR contains(url, '/en/')""")
def flt_service_lookup(spark, sf_dir):
    """FLT-3: literal (not regex) substring service lookup on endpoint URLs."""
    p = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return p.where(T.serves("url", "en"))
