"""Re-alignment of an extracted signature onto the original text (SPN-5, SPN-6).

The extracted signature is stripped, its first and last character dropped,
and split on blanks into chunks. For every chunk found in the text we need its
number of non-overlapping occurrences and its first and last offset. The
anchor is the first chunk with the fewest occurrences (chunks tied at a
minimum above one count only their last occurrence). Two walks go left and
right from the anchor choosing the nearest occurrence below/above the current
bound; the span is then widened to whole lines.

A row's bounds are found in one Arrow pass that returns offsets only; the
strings are cut in the JVM. A chunk is searched until it is found twice, however
often the signature repeats it, and counted only where none is found once; a
walk searches from its bound to the nearest occurrence.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of the strip: every Unicode blank (``functions.text.strip_all``).
_BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
MIN_RESPONSE = 10
SLICE = 256
BOUNDS = pa.struct([("ok", pa.bool_()), ("lo", pa.int32()), ("hi", pa.int32())])


def _substr(s: Column, pos: Column, length: Column | None = None) -> Column:
    return F.call_function("substr", s, pos) if length is None else F.call_function("substr", s, pos, length)


class _Places:
    """Non-overlapping occurrences, from the left, of one chunk in a text.

    A chunk holds no blank, so an occurrence lies within one piece of the text between blanks, and of occurrences that
    overlap those count that a walk through their piece from its left meets: a search looks at one piece only."""

    def __init__(self, text: str, part: str):
        self.text, self.part, self.begin = text, part, -1
        # only a chunk that begins as it ends can overlap itself
        self.overlaps = any(part.startswith(part[i:]) for i in range(1, len(part))) if part.find(part[0], 1) > 0 else False

    def _listed(self, at: int) -> list[int]:
        """The occurrences in the piece around an offset; those of the piece seen last are kept."""
        begin, end = self.text.rfind(" ", 0, at) + 1, self.text.find(" ", at)
        if begin != self.begin:
            self.begin, self.end, self.listed = begin, len(self.text) if end < 0 else end, []
            at = self.text.find(self.part, begin, self.end)
            while at >= 0:
                self.listed.append(at)
                at = self.text.find(self.part, at + len(self.part), self.end)
        return self.listed

    def last(self) -> int:
        return self.before(len(self.text) + 1)

    def before(self, bound: int) -> int | None:
        """Largest occurrence offset < bound."""
        at = self.text.rfind(self.part, 0, max(bound - 1 + len(self.part), 0))
        if at < 0 or not self.overlaps:
            return at if at >= 0 else None
        listed = self._listed(at)
        return listed[bisect_left(listed, bound) - 1]

    def after(self, bound: int) -> int | None:
        """Smallest occurrence offset > bound."""
        at = self.text.find(self.part, bound + 1)
        while at >= 0 and self.overlaps:
            listed = self._listed(at)
            i = bisect_right(listed, bound)
            if i < len(listed):
                return listed[i]
            at = self.text.find(self.part, self.end)
        return at if at >= 0 else None


def signature_bounds(text: str | None, response: str | None) -> tuple[int, int] | None:
    """``(lo, hi)`` of the response in the text; None for a response shorter than 10 characters (after strip) or without any
    matching chunk (-> ``(text, '', '', -1, -1)``)."""
    resp = (response or "").strip(_BLANKS)
    if text is None or len(resp) < MIN_RESPONSE:
        return None
    parts = [x for x in resp[1:-1].strip(_BLANKS).split(" ") if x]
    at: dict[str, int] = {}
    missing = set()
    for x in set(parts):   # a chunk is searched until it is found twice
        first = text.find(x)
        if first < 0:
            missing.add(x)
        elif text.find(x, first + len(x)) < 0:
            at[x] = first
    valid = [x for x in parts if x not in missing]
    if not valid:
        return None
    known: dict[str, _Places] = {}

    def places(part):
        if part not in known:
            known[part] = _Places(text, part)
        return known[part]

    if not at:
        counts = {x: text.count(x) for x in set(valid)}
        least = min(counts.values())
        at = {x: places(x).last() for x, k in counts.items() if k == least}
    anchor = next(i for i, x in enumerate(valid) if x in at)
    lo = hi = at[valid[anchor]]
    for x in reversed(valid[:anchor]):
        bound = max(0, lo - 1)
        found = (at[x] if at[x] < bound else None) if x in at else places(x).before(bound)
        lo = lo if found is None else found
    for x in valid[anchor + 1:]:
        bound = min(len(text), hi + 1)
        found = (at[x] if at[x] > bound else None) if x in at else places(x).after(bound)
        hi = hi if found is None else found
    return lo, min(hi + len(valid[-1]), len(text))


def _bounds(texts: pa.Array, found: pa.Array) -> pa.Array:
    lo, hi = [], []
    for low in range(0, len(texts), SLICE):
        for text, response in zip(texts.slice(low, SLICE).to_pylist(), found.slice(low, SLICE).to_pylist()):
            here = signature_bounds(text, response) or (None, None)
            lo.append(here[0])
            hi.append(here[1])
    lo = pa.array(lo, pa.int32())
    return pa.StructArray.from_arrays([lo.is_valid(), lo, pa.array(hi, pa.int32())], fields=list(BOUNDS))


def alignment_bounds(text: Column, response: Column) -> Column:
    """``struct<ok, lo, hi>`` of :func:`signature_bounds`, one Arrow pass."""
    return F.arrow_udf(_bounds, "struct<ok:boolean,lo:int,hi:int>")(text, response)


def cut_alignment(text: Column, bounds: Column) -> Column:
    """Whole-line signature, body and tail (``bounds`` materialised)."""
    lo, hi = bounds["lo"], bounds["hi"]
    before = _substr(text, F.lit(1), lo)
    prefix = F.substring_index(before, "\n", -1)
    after_text = _substr(text, hi + 1)
    suffix = F.substring_index(after_text, "\n", 1)
    body = F.when(F.instr(before, "\n") > 0,
                  _substr(before, F.lit(1), F.length(before) - F.length(prefix) - 1)).otherwise(F.lit(""))
    tail = F.when(F.instr(after_text, "\n") > 0, _substr(after_text, F.length(suffix) + 2)).otherwise(F.lit(""))
    sig = F.concat(prefix, _substr(text, lo + 1, hi - lo), suffix)
    none = F.struct(text.alias("body"), F.lit("").alias("signature"), F.lit("").alias("tail"),
                    F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    found = F.struct(body.alias("body"), sig.alias("signature"), tail.alias("tail"), lo.alias("start"), hi.alias("end"))
    return F.when(bounds["ok"], found).otherwise(none)


def align(df, text_col: str, response_col: str, out_col: str = "aligned"):
    """Two projections: bounds -> strings."""
    x = df.withColumn("_align_b", alignment_bounds(F.col(text_col), F.col(response_col)))
    return x.withColumn(out_col, cut_alignment(F.col(text_col), F.col("_align_b"))).drop("_align_b")
