"""Suffix dedup over bytes: sampled positions, ranked by contexts that grow until unique or past the threshold.

Every byte covered by a ``SIZE``-byte string that also starts anywhere else is removed. Prefix doubling over every byte
position needs a row per byte and round, which is over ten times the input in every sort; so positions are sampled by
content: the position of the least ``GRAM``-byte hash inside a string (leftmost on ties) depends on the string alone, so
equal strings have their sampled position at the same distance. The strings of a text whose sampled position is the same
are a node: a range of starts. Each round ranks nodes by two growing contexts, with Spark grouping the pairs:

* the inner context, that all strings of the node's distance range share: if it occurs once, none of them is repeated
  and the node is dropped;
* the outer context, all bytes that they cover: nodes with equal ones are repeated in every string; one stands for its
  class from then on. Nodes whose outer context is unique are split by distance (512, 64, 8, 1), so the inner context
  grows from ``GRAM`` bytes to the threshold itself.

The work follows the number of sampled positions (about one in 185 bytes) and the ends of repeated passages; counts are
partial sums, so no group's rows meet in one task. Texts travel compressed and only while they have open nodes.

Defined cases: null and empty texts and those under ``SIZE`` bytes lose nothing; repeated rows are copies of each other; ids
may be null or repeated; one byte repeated for ever makes every position a sampled one, still in proportion to the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import Windows, mix, prepare, runs, written
from mailsift.llm.substring_words import _emitted, keyed, unique_places

SIZE, GRAM = 400, 32
SPAN = SIZE - GRAM + 1
SHIFTS = (9, 6, 3, 0)
_PIECE = 1 << 20
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACE = np.uint64((1 << 24) - 1)
DROP, OPEN, REP = 0, 1, 2


class Sampler:
    """Nodes of a text: sampled position, first and last start of its strings, hash of the sampled gram."""

    def __init__(self):
        self.poly = Windows(0xD6E8FEB86659FD93)

    def nodes(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        parts = []
        for low in range(0, max(0, len(raw) - SIZE + 1), _PIECE):  # pieces of starts; each sees the bytes its strings cover
            x, a, b, g = self._piece(np.frombuffer(raw, np.uint8, min(_PIECE + SIZE - 1, len(raw) - low), low))
            parts.append((x + low, a + low, b + low, g))
        if not parts:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
        return tuple(np.concatenate(c) for c in zip(*parts))

    def _piece(self, data: np.ndarray):
        n = len(data) - GRAM + 1
        at = np.arange(n)
        gram = mix(self.poly.of(self.poly.prefix(_BYTE[data]), at, at + GRAM))
        key = (gram & ~_PLACE) | at.astype(np.uint64)  # leftmost of the least
        rows = -(-n // SPAN)
        full = np.full(rows * SPAN, ~np.uint64(0))
        full[:n] = key
        full = full.reshape(rows, SPAN)
        ahead = np.minimum.accumulate(full, axis=1).ravel()
        behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - SPAN + 1
        least = np.minimum(behind[:starts], ahead[SPAN - 1: SPAN - 1 + starts])
        x = (least & _PLACE).astype(np.int64)
        cut = np.flatnonzero(np.diff(x)) + 1
        a = np.concatenate(([0], cut))
        return x[a], a, np.concatenate((cut, [starts])) - 1, gram[x[a]]


def split(x: int, a: int, b: int, shift: int) -> list[tuple[int, int]]:
    """Parts of the starts a..b whose distances to x share ``distance >> shift``."""
    out = []
    for j in range((x - b) >> shift, ((x - a) >> shift) + 1):
        out.append((max(a, x - ((j + 1) << shift) + 1), min(b, x - (j << shift))))
    return out


def contexts(raw: bytes, x: int, a: int, b: int, shift: int) -> tuple[int, int]:
    """128-bit ranks of the inner and outer context of a node."""
    near = ((x - b) >> shift) << shift
    far = near + (1 << shift) - 1
    inner = raw[min(x - near, x): max(x - far + SIZE, x + GRAM)] if shift else raw[a: a + SIZE]
    outer = raw[a: b + SIZE]
    return (xxhash.xxh3_128_intdigest(inner, seed=(shift << 20 | near) << 1),
            xxhash.xxh3_128_intdigest(outer, seed=(shift << 40 | (x - a) << 20 | (x - b)) << 1 | 1))


_M = (1 << 64) - 1


def _halves(values: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return (np.fromiter((v & _M for v in values), np.uint64, len(values)),
            np.fromiter((v >> 64 for v in values), np.uint64, len(values)))


_STATE = pa.schema([("doc", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("z", pa.binary()),
                    ("x", pa.list_(pa.int64())), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())),
                    ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())), ("sha", pa.string())])
_STATE_SQL = ("doc long, k1 long, k2 long, n long, z binary, x array<long>, a array<long>, b array<long>, low array<long>, "
              "high array<long>, sha string")


def _batches(rows, schema):
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(v) for v in r if isinstance(v, (bytes, list)))
        if len(held) >= 256 or size >= 16 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _closed(doc, k1, k2, raw, z, x, a, b, low, high):
    """State of a text: open ones and those that lose bytes keep their bytes, the others are done."""
    if x or low:
        return doc, k1, k2, len(raw), z if z is not None else zstandard.compress(raw, 1), x, a, b, low, high, None
    return doc, k1, k2, len(raw), None, [], [], [], [], [], hashlib.sha256(raw).hexdigest()


def _pack(batches):
    for b in batches:
        raw = b.column(3).to_pylist()
        z = pa.array([None if r is None else zstandard.compress(r, 1) for r in raw], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:3], z], names=["doc", "k1", "k2", "z"])


def _grams(batches):
    s = Sampler()

    def rows():
        for b in batches:
            for k1, k2, raw in zip(*(c.to_pylist() for c in b.columns)):
                x, a, _, g = s.nodes(raw or b"")
                yield g, g, k1, k2, np.arange(len(x))
    for batch in _emitted(rows()):
        yield batch.select(["h1", "k1", "k2", "at"])


def _first(batches):
    """Texts with the nodes whose gram is not unique."""
    s = Sampler()

    def rows():
        for batch in batches:
            for doc, k1, k2, z, places in zip(*(c.to_pylist() for c in batch.columns)):
                raw = zstandard.decompress(z) if z else b""
                x, a, b, _ = s.nodes(raw)
                keep = np.ones(len(x), bool)
                keep[places or []] = False
                yield _closed(doc, k1, k2, raw, z, x[keep].tolist(), a[keep].tolist(), b[keep].tolist(), [], [])
    yield from _batches(rows(), _STATE)


def _ranks(shift: int):
    """Rows (rank, kind, text, node) of the open nodes: outer contexts, and inner ones in the middle rounds."""
    inner = 0 < shift < SHIFTS[0]

    def run(batches):
        def rows():
            for batch in batches:
                for k1, k2, z, x, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                    raw = zstandard.decompress(z)
                    both = [contexts(raw, *node, shift) for node in zip(x, a, b)]
                    at = np.arange(len(x))
                    h1, h2 = _halves([o for _, o in both])
                    yield h1, h2, k1, k2, 2 * at
                    if inner:
                        h1, h2 = _halves([i for i, _ in both])
                        yield h1, h2, k1, k2, 2 * at + 1
        yield from _emitted(rows())
    return run


def _next(shift: int, then: int | None):
    """Texts after a round: repeated nodes are noted, unique inner contexts dropped, the others split for the next one."""
    def run(batches):
        def rows():
            for batch in batches:
                for doc, k1, k2, n, z, x, a, b, low, high, sha, verdicts in zip(*(c.to_pylist() for c in batch.columns)):
                    raw = zstandard.decompress(z)
                    said: dict[int, int] = {}
                    for at, what in ((v["at"], v["what"]) for v in verdicts or ()):
                        if what == DROP or said.get(at) != DROP:
                            said[at] = what
                    nx, na, nb = [], [], []
                    for i, node in enumerate(zip(x, a, b)):
                        what = said.get(i)
                        if what == DROP:
                            continue
                        if what != OPEN:
                            low.append(node[1])
                            high.append(node[2] + 1)
                        if what is not None and then is not None:
                            for p, q in split(*node, then):
                                nx.append(node[0])
                                na.append(p)
                                nb.append(q)
                    yield _closed(doc, k1, k2, raw, z, nx, na, nb, *_merged(low, high))
        yield from _batches(rows(), _STATE)
    return run


def _merged(low: list[int], high: list[int]) -> tuple[list[int], list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(low, high)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [a for a, _ in out], [b for _, b in out]


def _verdicts(ranks: DataFrame) -> DataFrame:
    """Per text: dropped nodes (inner context once), open ones (outer context once) and representatives of classes.

    The outer class's representative is its largest (k1, k2, node); nodes without a verdict are repeated and done with.
    """
    kind = F.col("at") % 2
    groups = ranks.groupBy("h1", "h2", kind.alias("kind")).agg(
        F.count("*").alias("n"), F.max(F.struct("k1", "k2", (F.col("at") / 2).cast("int").alias("at"))).alias("m"))
    what = F.when((F.col("kind") == 1) & (F.col("n") == 1), DROP).when((F.col("kind") == 0) & (F.col("n") == 1), OPEN).when(
        F.col("kind") == 0, REP)
    return groups.select("m.*", what.alias("what")).where("what is not null").groupBy("k1", "k2").agg(
        F.collect_list(F.struct("at", "what")).alias("verdicts"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id, n_bytes, n_removed, n_spans, kept_sha256, the removed byte spans and the kept bytes (null
    if nothing was removed)."""
    spark = docs.sparkSession
    prepare(spark)
    src = keyed(docs, id_col, text_col).withColumn("doc", F.col("doc").cast("long"))
    lists = unique_places(src.select("k1", "k2", "raw").mapInArrow(_grams, "h1 long, k1 long, k2 long, at int"), ("h1",))
    packed = src.mapInArrow(_pack, "doc long, k1 long, k2 long, z binary")
    state = packed.join(lists, ["k1", "k2"], "left").select("doc", "k1", "k2", "z", "places").mapInArrow(_first, _STATE_SQL)
    state = written(state, "bytes-0")
    done = state.where("size(x) = 0")
    state = state.where("size(x) > 0")
    for k, shift in enumerate(SHIFTS):
        then = SHIFTS[k + 1] if k + 1 < len(SHIFTS) else None
        ranks = state.select("k1", "k2", "z", "x", "a", "b").mapInArrow(_ranks(shift), "h1 long, h2 long, k1 long, k2 long, at int")
        state = state.join(_verdicts(ranks), ["k1", "k2"], "left").select(*_STATE.names, "verdicts").mapInArrow(_next(shift, then), _STATE_SQL)
        state = written(state, f"bytes-{k + 1}")
        done = done.unionByName(state.where("size(x) = 0"))
        state = state.where("size(x) > 0")

    out_type = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                          ("kept_sha256", pa.string()), ("removed", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])

    def finish(batches):
        def rows():
            for b in batches:
                for doc, n, z, low, high, sha in zip(*(c.to_pylist() for c in b.columns)):
                    if not low:
                        yield doc, n, 0, 0, sha or hashlib.sha256(zstandard.decompress(z)).hexdigest(), [], None
                        continue
                    gone = np.zeros(n + 1, np.int64)
                    np.add.at(gone, low, 1)
                    np.add.at(gone, np.array(high) + SIZE - 1, -1)
                    gone = np.cumsum(gone)[:n] > 0
                    first, last = runs(gone)
                    kept = np.frombuffer(zstandard.decompress(z), np.uint8)[~gone].tobytes()
                    yield (doc, n, int(gone.sum()), len(first), hashlib.sha256(kept).hexdigest(),
                           [[p, q] for p, q in zip(first.tolist(), last.tolist())], kept)
        yield from _batches(rows(), out_type)

    out = done.select("doc", "n", "z", "low", "high", "sha").mapInArrow(
        finish, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<array<long>>, kept binary")
    return out.withColumnRenamed("doc", id_col)
