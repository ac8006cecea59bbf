"""Quality rules, line first.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are removed, and a document is
rejected when the removed lines hold more than half of its non-blank characters (or when a base rule fails).

Defined cases: a null, empty or blank text has no words, no lines and fails the base rule; repeated rows are judged
each for itself; extra columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift.llm.common import append_struct, fresh, prepare

MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
#: Share of punctuation in a line's characters, words of a fragment, words per separator, words of menu and boilerplate lines.
PUNCTUATION_DIV = 5
FRAGMENT_WORDS = 6
SEPARATORS, NAV_DENSITY = "|»›•·", 10
MENU_WORDS, BOILERPLATE_WORDS = 6, 30
TERMINAL = "[.!?:;)\\]\"'…”’»。！？][\\x20\\x09-\\x0D]*$"
MENU = ("^[\\x20\\x09-\\x0D]*(home|menu|log ?in|sign ?in|sign ?up|next|previous|back to top|read more|skip to|search|"
        "share)([^a-z]|$)")
BOILERPLATE = ("all rights reserved|cookie policy|we use cookies|accept cookies|enable javascript|privacy policy|"
               "terms of use|terms of service|subscribe to|sign up for|click here|powered by|lorem ipsum")

_PUNCTUATION = bytes(i for i in range(0x21, 0x7F) if not chr(i).isalnum())
_BLANK = b" \t\n\x0b\x0c\r"
_terminal, _menu, _boilerplate = re.compile(TERMINAL), re.compile(MENU), re.compile(BOILERPLATE)
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def line_fails(line: str, raw: bytes, n_words: int, n_chars: int) -> str:
    """Name of the first rule that a non-blank line breaks, or an empty string."""
    if PUNCTUATION_DIV * (len(raw) - len(raw.translate(None, _PUNCTUATION))) > n_chars:
        return "punctuation"
    if n_words < FRAGMENT_WORDS and not _terminal.search(line):
        return "fragment"
    separators = sum(map(line.count, SEPARATORS))
    if separators >= 2 and NAV_DENSITY * separators >= n_words:
        return "navigation"
    if n_words <= BOILERPLATE_WORDS:
        low = raw.translate(_LOWER).decode()
        if n_words <= MENU_WORDS and _menu.search(low):
            return "navigation"
        if _boilerplate.search(low):
            return "boilerplate"
    return ""


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    a = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    pair = np.unique(a[:-1] * len(ids) + a[1:], return_inverse=True)[1]  # dense again, so the next product fits
    triple = pair[:-1] * np.int64(len(ids)) + a[2:]
    order = np.argsort(triple, kind="stable")
    same = triple[order[1:]] == triple[order[:-1]]
    hit = np.zeros(n, bool)
    start = np.concatenate([order[1:][same], order[:-1][same]])
    for k in range(3):
        hit[start + k] = True
    return int(hit.sum())


def judge(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_lines, clean_text)."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    chars = len(text) - (len(raw) - len(raw.translate(None, _BLANK)))
    seen: set[str] = set()
    dup = removed = lost = 0
    left = []
    for line in text.split("\n"):
        line_raw = line.encode()
        n = len(line_raw.split())
        if not n:
            left.append(line)
            continue
        dup += line in seen
        seen.add(line)
        n_chars = len(line) - (len(line_raw) - len(line_raw.translate(None, _BLANK)))
        if line_fails(line, line_raw, n, n_chars):
            removed += 1
            lost += n_chars
        else:
            left.append(line)
    repeat = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeat > 50 * len(words)
    return (len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeat, failed,
            not failed and 2 * lost <= chars, removed, "\n".join(left))


FIELDS = [("n_words", T.LongType(), pa.int64()), ("word_chars", T.LongType(), pa.int64()),
          ("n_symbols", T.LongType(), pa.int64()), ("n_dup_lines", T.LongType(), pa.int64()),
          ("n_repeat_words", T.LongType(), pa.int64()), ("base_failed", T.BooleanType(), pa.bool_()),
          ("kept", T.BooleanType(), pa.bool_()), ("n_removed_lines", T.LongType(), pa.int64()),
          ("clean_text", T.StringType(), pa.string())]


def quality(docs: DataFrame, text_col: str = "text", name: str = "quality", with_text: bool = True) -> DataFrame:
    """All columns of ``docs`` and the struct ``name``: the counts, the verdict and the text without failing lines."""
    prepare(docs.sparkSession)
    fields = FIELDS if with_text else FIELDS[:-1]

    def make():
        return judge if with_text else lambda t: judge(t)[:-1]

    return append_struct(docs, text_col, name, fields, make)


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The kept documents, their failing lines removed; the columns of ``docs``."""
    q = fresh(docs, "quality")
    out = quality(docs, text_col, q).where(F.col(f"`{q}`.kept"))
    return out.withColumn(text_col, F.col(f"`{q}`.clean_text")).drop(q)
