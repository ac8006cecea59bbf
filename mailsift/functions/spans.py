"""Regex matches with character offsets, computed inside the JVM.

``split(text, re, -1)`` yields the pieces between matches and
``regexp_extract_all(text, re, 0)`` the matches themselves, so the pieces and
matches alternate and concatenate back to the text. A left fold over the
(piece, match) pairs carries the running position and emits
``struct(start, end, name)`` per match; offsets are code points, like
``substring``/``length``. Precondition: the pattern never matches the empty
string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN_TYPE = "array<struct<start:int,end:int,name:string>>"
BLOCK = 128


def match_spans(text: Column | str, pattern: str, guard: Column | None = None) -> Column:
    """``array<struct<start,end,name>>`` of all non-overlapping matches.

    ``guard`` is an exact cheap pre-test (e.g. a literal every match must contain); rows
    failing it skip both regex passes."""
    text = F.col(text) if isinstance(text, str) else text
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    pieces = F.split(text, pattern, -1)
    pairs = F.zip_with(matches, pieces, lambda n, q: F.struct(q.alias("q"), n.alias("n")))
    skip = text.isNull() if guard is None else (text.isNull() | ~F.coalesce(guard, F.lit(False)))
    # bound as a lambda variable, so that the regexes run once and not once for each block
    return F.when(skip, F.expr(f"cast(array() as {SPAN_TYPE})")).otherwise(
        F.transform(F.array(pairs), _placed)[0])


def _placed(pairs: Column) -> Column:
    """Spans of (piece, match) pairs. Appending to an array copies it, so spans are built in blocks of ``BLOCK``
    pairs, whose starts a first fold has summed up."""
    def block(no):
        return F.slice(pairs, no * BLOCK + 1, F.lit(BLOCK))

    def sum_up(s, no):
        width = F.aggregate(block(no), F.lit(0), lambda n, x: n + F.length(x["q"]) + F.coalesce(F.length(x["n"]), F.lit(0)))
        here = F.array(F.struct(no.alias("no"), s["pos"].alias("pos")))
        return F.struct((s["pos"] + width).alias("pos"), F.concat(s["blocks"], here).alias("blocks"))

    def step(s, x):
        start = s["pos"] + F.length(x["q"])
        end = start + F.length(x["n"])
        grown = F.struct(
            end.alias("pos"),
            F.concat(s["acc"], F.array(F.struct(start.alias("start"), end.alias("end"), x["n"].alias("name")))).alias("acc"),
        )
        return F.when(x["n"].isNull(), s).otherwise(grown)

    def folded(part, pos):
        init = F.struct(pos.alias("pos"), F.expr(f"cast(array() as {SPAN_TYPE})").alias("acc"))
        return F.aggregate(part, init, step, lambda s: s["acc"])

    def spans(b):
        return folded(block(b["no"]), b["pos"])

    numbers = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))
    none = F.struct(F.lit(0).alias("pos"), F.expr("cast(array() as array<struct<no:int,pos:int>>)").alias("blocks"))
    many = F.flatten(F.transform(F.aggregate(numbers, none, sum_up, lambda s: s["blocks"]), spans))
    return F.when(F.size(pairs) <= BLOCK, folded(pairs, F.lit(0))).otherwise(many)  # few pairs need no first fold
