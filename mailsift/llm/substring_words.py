"""Substring dedup over words with difference-cover anchors.

A window is ``WINDOW`` consecutive words of a text; every word covered by a window whose words also start anywhere else is
removed. Positions whose remainder modulo ``PERIOD`` lies in ``COVER`` carry an anchor: the hash of the next ``ANCHOR``
words. The cover holds every difference modulo the period, so two equal windows always share an anchor at the same
distance from their starts. Steps:

1. anchors of all texts, counted by hash with partial sums; an anchor that occurs once names its only place, so the
   unique places come out of the same aggregation, without a join and without a group's rows in one task;
2. windows that hold a repeated anchor are extended to whole windows and hashed to 128 bits, counted in the same way;
3. every candidate window that is not unique is repeated; its words go.

A text is known by (document id, hash of the text). Defined cases: null, empty and short texts lose nothing; repeated rows
are copies of each other; ids may be null or repeated; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import Windows, WordHash, prepare, runs, written

WINDOW = 35
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
ANCHOR = WINDOW - PERIOD + 1
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_ROWS = 200_000
_KEYS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int32())])


def signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


class Hasher:
    """Word hashes of texts and hashes of their windows."""

    def __init__(self):
        self.word, self.polys = WordHash(), [Windows(b) for b in BASES]

    def values(self, raw: bytes | None) -> np.ndarray:
        words = raw.split() if raw else []
        return np.fromiter(map(self.word.__getitem__, words), np.uint64, len(words))

    def windows(self, values: np.ndarray, start: np.ndarray, size: int, which: int) -> np.ndarray:
        poly = self.polys[which]
        return poly.of(poly.prefix(values), start, start + size)


def cover_positions(n: int, size: int = ANCHOR) -> np.ndarray:
    """Positions of the anchors of a text of n words (none in a text without a window)."""
    p = np.arange(n - size + 1 if n >= WINDOW else 0)
    return p[np.isin(p % PERIOD, COVER)]


def candidates(n: int, unique: list[int] | None) -> np.ndarray:
    """Window starts of a text of n words that hold an anchor which is not unique."""
    p = cover_positions(n)
    if unique:
        p = p[~np.isin(p, unique)]
    if not len(p):
        return np.zeros(0, np.int64)
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, np.maximum(p - (WINDOW - ANCHOR), 0), 1)  # a window holds the anchor if it starts at most so far before it
    np.add.at(mark, p + 1, -1)
    return np.flatnonzero(np.cumsum(mark)[: n - WINDOW + 1] > 0)


def _emitted(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows (h1, h2, k1, k2, positions) of several texts as batches of bounded size."""
    held, size = [], 0

    def batch():
        n = [len(x[0]) for x in held]
        return pa.RecordBatch.from_arrays(
            [signed(np.concatenate([x[0] for x in held])), signed(np.concatenate([x[1] for x in held])),
             pa.array(np.repeat(np.array([x[2] for x in held], np.int64), n)),
             pa.array(np.repeat(np.array([x[3] for x in held], np.int64), n)),
             pa.array(np.concatenate([x[4] for x in held]).astype(np.int32))], schema=_KEYS)

    for row in rows:
        if len(row[0]):
            held.append(row)
            size += len(row[0])
        if size >= _ROWS:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (the id as it is), k1 and k2 (the text's key) and the text as bytes."""
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("k1"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(0)).cast("long").alias("k2"),
                       F.col(text_col).cast("string").cast("binary").alias("raw"))


def unique_places(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Per text the positions whose hash occurs once: (k1, k2, places)."""
    once = rows.groupBy(*by).agg(F.count("*").alias("n"), F.max("k1").alias("k1"), F.max("k2").alias("k2"), F.max("at").alias("at"))
    return once.where("n = 1").groupBy("k1", "k2").agg(F.collect_list("at").alias("places"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id, n_words, n_removed, kept_sha256, the removed word runs and the kept words as text."""
    spark = docs.sparkSession
    prepare(spark)
    src = keyed(docs, id_col, text_col)

    def anchors(batches):
        h = Hasher()

        def rows():
            for b in batches:
                for k1, k2, raw in zip(*(b.column(i).to_pylist() for i in range(3))):
                    values = h.values(raw)
                    p = cover_positions(len(values))
                    if len(p):
                        a = h.windows(values, p, ANCHOR, 0)
                        yield a, a, k1, k2, p
        for batch in _emitted(rows()):
            yield batch.select(["h1", "k1", "k2", "at"])

    found = src.select("k1", "k2", "raw").mapInArrow(anchors, "h1 long, k1 long, k2 long, at int")
    lists = unique_places(found, ("h1",))
    state_schema = "doc long, k1 long, k2 long, n int, low array<int>, high array<int>, raw binary"
    state_type = pa.schema([("doc", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int32()),
                            ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32())), ("raw", pa.binary())])

    def extend(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                out = []
                for doc, k1, k2, raw, places in zip(*(c.to_pylist() for c in whole.slice(at, 256).columns)):
                    n = len((raw or b"").split())
                    mask = np.zeros(n, bool)
                    mask[candidates(n, places)] = True
                    low, high = runs(mask)
                    out.append((doc, k1, k2, n, low.tolist(), high.tolist(), raw))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), state_type)], schema=state_type)

    state = written(src.join(lists, ["k1", "k2"], "left").select(F.col("doc").cast("long"), "k1", "k2", "raw", "places")
                    .mapInArrow(extend, state_schema), "substring-state")

    def whole_windows(batches):
        h = Hasher()

        def rows():
            for b in batches:
                for k1, k2, raw, low, high in zip(*(c.to_pylist() for c in b.columns)):
                    p = np.concatenate([np.arange(a, z) for a, z in zip(low, high)])
                    values = h.values(raw)
                    yield h.windows(values, p, WINDOW, 0), h.windows(values, p, WINDOW, 1), k1, k2, p
        yield from _emitted(rows())

    open_ = state.where("size(low) > 0")
    cut = open_.select("k1", "k2", "raw", "low", "high").mapInArrow(whole_windows, "h1 long, h2 long, k1 long, k2 long, at int")
    once = unique_places(cut, ("h1", "h2"))
    out_schema = "doc long, n_words long, n_removed long, kept_sha256 string, removed array<array<int>>, kept string"
    out_type = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                          ("removed", pa.list_(pa.list_(pa.int32()))), ("kept", pa.string())])

    def remove(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                out = []
                for doc, n, raw, low, high, places in zip(*(c.to_pylist() for c in whole.slice(at, 256).columns)):
                    words = (raw or b"").split()
                    starts = np.zeros(n + 1, np.int64)
                    for a, z in zip(low, high):
                        starts[a:z] = 1
                    starts[places or []] = 0
                    p = np.flatnonzero(starts)
                    mark = np.zeros(n + 1, np.int64)
                    mark[p] += 1
                    mark[p + WINDOW] -= 1
                    gone = np.cumsum(mark)[:n] > 0
                    kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if len(p) else b" ".join(words)
                    first, last = runs(gone)
                    out.append((doc, n, int(gone.sum()), hashlib.sha256(kept).hexdigest(),
                                [[a, z] for a, z in zip(first.tolist(), last.tolist())], kept.decode()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), out_type)], schema=out_type)

    same = state.where("size(low) = 0").select("doc", "n", "raw", "low", "high", F.lit(None).cast("array<int>").alias("places"))
    more = open_.join(once, ["k1", "k2"], "left").select("doc", "n", "raw", "low", "high", "places")
    return same.unionByName(more).mapInArrow(remove, out_schema).withColumnRenamed("doc", id_col)
