"""Scalar Column helpers (FN-*, FLT-1, CLN-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsift import settings as S


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- FN-8: strip with every (Unicode) whitespace ------------------------------------
def strip_all(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+\z", "")


def rstrip_all(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"(?U)\s+\z", "")


# ---- FN-6 / FN-7 ----------------------------------------------------------------------
def digit_count(c: Column | str) -> Column:
    return F.length(F.regexp_replace(_c(c), r"\D", ""))


def newline_count(c: Column | str) -> Column:
    c = _c(c)
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


# ---- FN-9: split on a set of single characters ----------------------------------------
def split_on(c: Column | str, chars: str) -> Column:
    cls = "".join("\\n" if ch == "\n" else ("\\" + ch if ch in "]\\^-" else ch) for ch in chars)
    return F.split(_c(c), f"[{cls}]", -1)


# ---- FN-5: sequential literal replacement -------------------------------------------
def replace_all(c: Column | str, needles=S.URL_PREFIX_REPLACEMENTS, replacement: str = "") -> Column:
    return reduce(lambda acc, k: F.replace(acc, F.lit(k), F.lit(replacement)), needles, _c(c))


# ---- FN-1: second-last path part of an endpoint URL ---------------------------------
def model_type(url: Column | str) -> Column:
    return F.element_at(F.split(_c(url), "/", -1), -2)


# ---- FN-2: date stamps -------------------------------------------------------------
def minute_stamp(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "yyyy_MM_dd_HH_mm")


def day_stamp(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "dd/MM/yyyy")


# ---- FLT-1: language alias mapping -------------------------------------------------
def map_language(lang: Column | str, mapping: dict = S.LANGUAGE_MAP) -> Column:
    lang = _c(lang)
    kv = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.element_at(kv, lang), lang)


# ---- FLT-3: endpoints of a service ---------------------------------------------------
def serves(url: Column | str, language: str) -> Column:
    """Whether an endpoint URL serves a language: it names it as a path part or has its place-holder (literally, no pattern)."""
    return _c(url).contains("{" + language + "}") | _c(url).contains(f"/{language}/")


# ---- CLN-1..8: mail text cleaning ---------------------------------------------------
def remove_head(c: Column | str) -> Column:
    # dot-all lazy form: an alternation in a repeated group overflows the JVM regex stack
    return F.regexp_replace(_c(c), r"(?s)<head>.+?</head>", "")


def clean_html(c: Column | str, strip_script: bool = False) -> Column:
    """Paragraphs and line breaks become line breaks; tags and entities go. ``strip_script`` also removes what stands inside
    script and style elements, which otherwise stays."""
    if strip_script:
        c = F.regexp_replace(_c(c), r"(?is)<(script|style)\b.*?</\1\s*>", "")
    c = F.regexp_replace(_c(c), "</p>", "</p>\n")
    c = F.regexp_replace(c, r"<br\s?/>|<br>", "\n")
    # (?d): '.' stops only at '\n', as in Python
    return F.regexp_replace(c, r"(?d)<.*?>|&([a-z0-9]+|#[0-9]{1,6}|#x[0-9a-f]{1,6});", "")


def remove_links(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"(?d)\[(http.*?)\]", "")


def collapse_blanks(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"(?U)[^\S\r\n]{2,}", " ")


def collapse_line_breaks(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"[\r\n]{3,}", "\n\n")


def remove_html_comments(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"(?s)<!--.*?-->", "")


def clean_mail_text(c: Column | str, strip_script: bool = False) -> Column:
    """Full chain: head -> html -> links -> blanks -> line breaks -> right strip."""
    c = remove_head(c)
    c = clean_html(c, strip_script)
    c = remove_links(c)
    c = collapse_blanks(c)
    c = collapse_line_breaks(c)
    return rstrip_all(c)


def mail_json(c: Column | str) -> Column:
    """CLN-8: cleaned text wrapped as {"data":{"body":...}}."""
    body = clean_mail_text(c)
    return F.to_json(F.struct(F.struct(body.alias("body")).alias("data")))
