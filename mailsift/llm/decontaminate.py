"""Benchmark decontamination by one Aho-Corasick automaton.

Benchmark items are normalised to words (A-Z lower-cased, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) and cut into
windows of ``window`` words (a shorter item is one window). The automaton's letters are words: each word of the windows
has a code point of its own, every other word is U+0000, so a text is scanned once in C and a state costs a word, not
six letters. Word positions are mapped back to character offsets of the original text for the texts that have hits.

The windows are dealt by their hash into blocks of at most ``block_windows``; a block is the only thing that is
collected and broadcast, so its size is bounded whatever the benchmark's size, and further blocks scan again.

Defined cases: null, empty or wordless texts and items have no words and no hits; an item with a null id marks words but
is not counted; repeated items count once per id; repeated documents are scanned each for itself; an empty benchmark
hits nothing; extra columns pass through.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift.llm.common import append_struct, fresh, prepare, runs, sha256_joined, written

WINDOW = 10
BLOCK_WINDOWS = 200_000
_NORMAL = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_NORMAL).split() if text else []


def code(i: int) -> str:
    """The i-th letter: a code point that is neither U+0000 nor a surrogate."""
    return chr(i + 1 if i + 1 < 0xD800 else i + 1 + 0x800)


class Automaton:
    """Windows (words joined by a blank) with their item ids, compiled for scanning texts."""

    def __init__(self, rows: list[tuple[str, str | None]]):
        items: dict[str, set[str]] = defaultdict(set)
        for window, item in rows:
            items[window].update(() if item is None else (item,))
        self.letters: dict[bytes, str] = {}
        self.ac = ahocorasick.Automaton()
        for window, ids in items.items():
            words = window.encode().split(b" ")
            key = "".join(self.letters.setdefault(w, code(len(self.letters))) for w in words)
            self.ac.add_word(key, (len(words), tuple(ids)))
        self.empty = not items
        if items:
            self.ac.make_automaton()

    def scan(self, text: str | None) -> tuple:
        """(number of words, starts and ends of hit runs in words, the same in characters, item ids)."""
        words = normal_words(text)
        letters = "".join(map(self.letters.get, words, repeat("\0")))
        if self.empty or not letters.strip("\0"):
            return len(words), [], [], []
        hit, found = None, set()
        for end, (n, ids) in self.ac.iter(letters):
            if hit is None:
                hit = np.zeros(len(words), bool)
            hit[end - n + 1: end + 1] = True
            found.update(ids)
        if hit is None:
            return len(words), [], [], []
        low, high = (x.tolist() for x in runs(hit))
        place = [m.span() for m in _WORD.finditer(text)]
        return (len(words), [[a, b] for a, b in zip(low, high)],
                [[place[a][0], place[b - 1][1]] for a, b in zip(low, high)], sorted(found))


def windows(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """Distinct (window, item) rows of the benchmark."""
    schema = "window string, item string"
    src = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = [w.decode() for w in normal_words(text)]
                cut = [" ".join(words[i: i + window]) for i in range(max(1, len(words) - window + 1))] if words else []
                yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string()), pa.array([item] * len(cut), pa.string())],
                                                 names=["window", "item"])

    return src.mapInArrow(run, schema).distinct()


_SPANS = T.ArrayType(T.ArrayType(T.LongType()))
_PA_SPANS = pa.list_(pa.list_(pa.int64()))
FIELDS = [("n_words", T.LongType(), pa.int64()), ("words", _SPANS, _PA_SPANS), ("spans", _SPANS, _PA_SPANS),
          ("items", T.ArrayType(T.StringType()), pa.list_(pa.string()))]


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", name: str = "hits", window: int = WINDOW,
                  block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """All columns of ``docs`` and last the struct ``name`` (made fresh if taken): n_words, hit runs in words, the same as character spans
    [start, end), and the sorted ids of the items with windows in the text."""
    spark = docs.sparkSession
    prepare(spark)
    cut = windows(items, item_id, item_text, window)
    total = cut.count()
    blocks = max(1, -(-total // block_windows))
    if blocks > 1:
        cut = written(cut, "windows")
    out, name = docs, fresh(docs, name)
    for k in range(blocks):
        part = cut if blocks == 1 else cut.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])  # at most about block_windows rows
        here = name if k == 0 else fresh(out, f"{name}_block")

        def make(shared=shared):
            built = Automaton(shared.value)
            return built.scan

        out = append_struct(out, text_col, here, FIELDS, make)
        if k:
            a, b = F.col(f"`{name}`"), F.col(f"`{here}`")
            out = out.withColumn(name, F.struct(
                a.n_words.alias("n_words"), _joined(a.words, b.words, 0).alias("words"),
                _joined(a.spans, b.spans, 1).alias("spans"),
                F.array_sort(F.array_distinct(F.concat(a["items"], b["items"]))).alias("items"))).drop(here)
        if blocks > 1:
            out = written(out, "block")
    return out


def _joined(a, b, gap: int):
    """Runs of both arrays: sorted, then overlapping or touching ones become one. Character runs of neighbouring words
    do not touch, so only words (``gap`` 0) are merged; character spans may lie side by side or overlap."""
    both = F.array_sort(F.array_distinct(F.concat(a, b)))
    if gap:
        return both
    empty = F.array().cast("array<array<bigint>>")

    def add(acc, x):
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) == 0) | (F.get(last, F.lit(1)) < x[0]), F.concat(acc, F.array(x))).otherwise(
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(last[0], F.greatest(last[1], x[1])))))

    return F.when(F.size(both) == 0, empty).otherwise(
        F.aggregate(F.slice(both, 2, F.greatest(F.size(both), F.lit(1))), F.slice(both, 1, 1), add))


def digest(out: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document with the counts of ``decontaminate`` (its last column)."""
    h = F.col(f"`{out.columns[-1]}`")
    n_hit = F.aggregate(h["words"], F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    return out.select(id_col, h.n_words.alias("n_words"), n_hit.alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"),
                      sha256_joined(h["items"]).alias("items_sha256"), (F.size(h["words"]) > 0).alias("contaminated"))
