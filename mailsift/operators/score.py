"""Token-scorer hook (UDF-1) and language detection (UDF-4).

A scorer maps a list of texts to token predictions ``[{start, end, entity,
score}]`` with text-local offsets. ``Scorers`` holds one scorer for each
language of a task; ``score_windows`` runs them in one Arrow pass over the
windows of whole texts. The trained models are not part of the snapshot, so
the shipped default scorers are small deterministic rules; plug a real model
by passing factories of any object with the same ``__call__``.
"""

from __future__ import annotations

import functools
from bisect import bisect_right
from collections import OrderedDict, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift import settings as S
from mailsift.operators.segment import blank_separated, packed, text_units

_ORG_WORDS = {"Inc", "Inc.", "Ltd", "Ltd.", "LLC", "GmbH", "Corp", "Corp.", "SA", "AG"}


class LastLinesScorer:
    """Segmentation default: tokens on the last ``n_lines`` lines are SIGNATURE, others BODY."""

    def __init__(self, n_lines: int = 3):
        self.n_lines = n_lines

    def __call__(self, texts: list[str]) -> list[list[dict]]:
        out = []
        for t in texts:
            t = t or ""
            cut = len(t)   # the last lines begin after this line break
            for _ in range(self.n_lines):
                cut = t.rfind("\n", 0, max(cut, 0))
            starts, ends = blank_separated(t)
            body = bisect_right(starts, cut)
            preds = [{"start": s, "end": e, "entity": S.BODY_LABEL, "score": 1.0} for s, e in zip(starts[:body], ends)]
            preds += [{"start": s, "end": e, "entity": S.SIGNATURE_LABEL, "score": 1.0} for s, e in zip(starts[body:], ends[body:])]
            out.append(preds)
        return out


class RuleNerScorer:
    """NER default: long digit runs -> PHONE_OFFICE, a capitalised first word of a line ->
    NAME_GIVEN and the capitalised word after it -> NAME_SURNAME, company suffixes ->
    ORGANIZATION; other tokens are not emitted."""

    places = False

    def __call__(self, texts: list[str]) -> list[list[dict]]:
        out = []
        for t in texts:
            t = t or ""
            preds, prev_label, prev_end, listed = [], None, None, False
            for start, end in zip(*blank_separated(t)):
                w = t[start:end]
                first_in_line = prev_end is None or "\n" in t[prev_end:start]
                digits = sum(map(str.isdigit, w)) if len(w) >= 9 and not w.isalpha() else 0
                label = None
                if digits >= 9:
                    label = "PHONE_OFFICE"
                elif w in _ORG_WORDS:
                    label = "ORGANIZATION"
                elif w[:1].isupper() and w.isalpha():
                    if first_in_line:
                        label = "NAME_GIVEN"
                    elif prev_label == "NAME_GIVEN":
                        label = "NAME_SURNAME"
                    elif self.places and listed:
                        label = "ADDRESS_CITY"
                if label:
                    preds.append({"start": start, "end": end, "entity": label, "score": 1.0})
                prev_label, prev_end, listed = label, end, w[-1] in ",."
            out.append(preds)
        return out


class PlaceNerScorer(RuleNerScorer):
    """NER default of languages whose places come from the model: also, a capitalised word after a word that ends with
    ``,`` or ``.`` on the same line -> ADDRESS_CITY."""

    places = True


# ------------------------------------------------------------------------------ models by language (UDF-1)
MODELS_KEPT = 6
SLICE = 64
_MODELS: OrderedDict[tuple[str, str], Callable] = OrderedDict()


class Scorers:
    """One task's scorers: a factory for each language and one for all others.

    A Python worker builds a language's scorer when it first meets that language and keeps the ``MODELS_KEPT`` used last,
    of all tasks together. ``name`` identifies the task."""

    def __init__(self, name: str, default: Callable[[], Callable], by_language: dict[str, Callable[[], Callable]] | None = None):
        self.name, self.default, self.by_language = name, default, dict(by_language or {})

    def of(self, language: str | None) -> Callable:
        known = language if language in self.by_language else ""
        key = (self.name, known)
        if key not in _MODELS:
            while len(_MODELS) >= MODELS_KEPT:
                _MODELS.popitem(last=False)
            _MODELS[key] = self.by_language.get(known, self.default)()
        _MODELS.move_to_end(key)
        return _MODELS[key]

    def __call__(self, languages: list[str | None], texts: list[str]) -> Iterator[list[dict]]:
        """Predictions of each text by its language's scorer, ``SLICE`` texts of one language at a time."""
        out: list[list[dict] | None] = [None] * len(texts)
        places = defaultdict(list)
        for i, language in enumerate(languages):
            places[language if language in self.by_language else ""].append(i)
        for language, at in places.items():
            scorer = self.of(language)
            for low in range(0, len(at), SLICE):
                part = at[low:low + SLICE]
                for i, preds in zip(part, scorer([texts[i] for i in part])):
                    out[i] = preds
        return iter(out)


SEGMENTATION = Scorers("segmentation", functools.partial(LastLinesScorer, 2), {"en": LastLinesScorer})
NER = Scorers("ner", PlaceNerScorer, {"en": RuleNerScorer})

_ARROW = {"int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def score_windows(df: DataFrame, scorers: Scorers, fields: str, decide: Callable[[str, int, list[dict]], list[tuple]], text_col: str = "text",
                  lang_col: str | None = "lang", limit: int = S.INFERENCE_TOKEN_LIMIT, name: str = "scored") -> DataFrame:
    """``df`` with the array column ``name`` of structs ``(window, *fields)``: what ``decide(text, start, predictions)`` gives
    for each window of at most ``limit`` tokens of the text, in order (UDF-1, SPN-4).

    One Arrow pass cuts the windows, calls the scorer of each row's language and drops a window's predictions once it is
    decided, so memory follows ``SLICE`` windows and not the rows of a batch. Null and empty texts have no windows. ``fields`` is a DDL list of int, string and double."""
    names = [f.split() for f in fields.split(",")]
    element = T.StructType.fromDDL("window int, " + fields)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(element))])
    at, lang_at = df.columns.index(text_col), df.columns.index(lang_col) if lang_col else None
    columns_of = list(df.columns)
    kinds = [pa.field("window", pa.int32())] + [pa.field(n, _ARROW[t]) for n, t in names]

    def found(texts, languages):
        """Decided rows of each text, in chunks of few windows."""
        out = [[] for _ in texts]
        chunk: list[tuple[int, int, int, str]] = []

        def close():
            scored = scorers([languages[i] for i, *_ in chunk], [t for *_, t in chunk])
            for (i, no, start, text), preds in zip(chunk, scored):
                out[i].extend((no, *row) for row in decide(text, start, preds))
            chunk.clear()

        for i, text in enumerate(texts):
            for no, (_, start, end) in enumerate(packed(text_units(text, limit), limit) if text else ()):
                if end > start:
                    chunk.append((i, no, start, text[start:end]))
                if len(chunk) >= SLICE:
                    close()
        close()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 4 * SLICE):
                b = whole.slice(low, 4 * SLICE)
                languages = b.column(lang_at).to_pylist() if lang_col else [None] * b.num_rows
                rows = found(b.column(at).to_pylist(), languages)
                flat = [x for r in rows for x in r]
                ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                columns = [pa.array([x[k] for x in flat], f.type) for k, f in enumerate(kinds)]
                arrays = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, fields=kinds))
                yield pa.RecordBatch.from_arrays([*b.columns, arrays], names=[*columns_of, name])

    return df.mapInArrow(run, schema)


def predicted_tokens(text: str, start: int, preds: list[dict]) -> list[tuple]:
    """``token_no int, start int, end int, entity string, score double``: every prediction, offsets in the whole text."""
    return [(i, p["start"] + start, p["end"] + start, p["entity"], float(p.get("score", 1.0))) for i, p in enumerate(preds)]


def predicted_signature(text: str, start: int, preds: list[dict], label: str = S.SIGNATURE_LABEL) -> list[tuple]:
    """``n int, start int, end int``: one row for the window, the number of signature tokens and their span (SPN-3)."""
    hits = [p for p in preds if p["entity"] == label]
    return [(len(hits), hits[0]["start"] + start if hits else None, hits[-1]["end"] + start if hits else None)]


def predicted_entities(text: str, start: int, preds: list[dict], gap: int = 4) -> list[tuple]:
    """``start int, end int, entity string, name string, score double``: predictions of one tag joined while the next one
    starts less than ``gap`` after the last one's end (SPN-1), offsets in the whole text."""
    spans: dict[str, list[list[int]]] = {}
    for p in preds:
        own = spans.setdefault(p["entity"], [])
        if own and p["start"] - own[-1][1] < gap:
            own[-1][1] = p["end"]
        else:
            own.append([p["start"], p["end"]])
    return [(s + start, e + start, tag, text[s:e], 1.0) for tag, own in spans.items() for s, e in own]


TOKENS = "token_no int, start int, end int, entity string, score double"
SIGNATURES = "n int, start int, end int"
ENTITIES = "start int, end int, entity string, name string, score double"


# ------------------------------------------------------------------------------ UDF-4
def _letter_grams(text: Column) -> Column:
    """Distinct runs of three letters of a text, lower-cased; the look-ahead finds overlapping ones in one pass."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?=(\p{L}{3}))"), F.lit(1)))


def fit_language_profile(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(lang, gram, weight)``: how common a letter trigram is among a language's texts, the binary length of one more than
    its texts a thousand. Trigrams of less than one text in a thousand are left out, so a language has at most a thousand
    times a text's number of trigrams, however many texts there are. Null texts and languages are not learnt from."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"))
    counts = known.select("lang", F.explode(_letter_grams(F.col("t"))).alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("c"))
    totals = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.floor(F.col("c") * 1000 / F.col("n")).cast("long")
    return counts.join(totals, "lang").where(F.col("c") * 1000 >= F.col("n")).select("lang", "gram", F.length(F.bin(share + 1)).alias("weight"))


def chinese_script(text: Column) -> Column:
    """``zh-hans`` or ``zh-hant`` where most letters are Han characters, by the characters that only one script has (simplified
    when as many); else NULL."""
    han = F.length(F.regexp_replace(text, r"[^\x{4E00}-\x{9FFF}]", ""))
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    simple = F.length(F.regexp_replace(text, f"[^{S.SIMPLIFIED_ONLY}]", ""))
    full = F.length(F.regexp_replace(text, f"[^{S.TRADITIONAL_ONLY}]", ""))
    return F.when((han > 0) & (2 * han > letters), F.when(full > simple, "zh-hant").otherwise("zh-hans"))


def detect_language(docs: DataFrame, profile: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    default: str = "en") -> DataFrame:
    """UDF-4 as a corpus job: ``(id, detected_lang)``. Chinese by script; other texts by the language whose profile weighs
    their trigrams most (ties: the larger language name); ``default`` when nothing matches or the text is null."""
    text = F.col(text_col)
    x = docs.select(id_col, chinese_script(text).alias("_zh"), text.alias("_t"))
    grams = x.where("_zh IS NULL").select(id_col, F.explode(_letter_grams(F.col("_t"))).alias("gram"))
    scored = grams.join(profile, "gram").groupBy(id_col, "lang").agg(F.sum("weight").alias("score"))
    best = scored.groupBy(id_col).agg(F.max(F.struct("score", "lang")).alias("_b"))
    return x.join(best, id_col, "left").select(id_col, F.coalesce("_zh", "_b.lang", F.lit(default)).alias("detected_lang"))
