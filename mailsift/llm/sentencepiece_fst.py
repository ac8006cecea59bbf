"""SentencePiece encoding and decoding by shortest paths through a weighted transducer.

The transducer is compiled from a model file: the normaliser (blanks become U+2581, with a dummy prefix), an arc for every
piece, and byte arcs for characters without a piece. Composing it with a text gives a lattice; the encoding is the path of
least weight in the tropical semiring (min, +).

* Unigram models: an arc weighs minus its piece's score.
* BPE models: scores are merge priorities, which no weight of a single arc expresses. A sequence is the BPE result exactly
  if every two neighbours keep apart when merged by themselves, so an arc weighs 0 after a piece it is compatible with
  and infinity after others: the only finite path is the result. Pieces of blanks only, whose priorities are equal, merge
  from the left and are compiled by run length.

Blanks end a piece, so a text falls into segments whose paths are independent; results of segments are remembered for a
bounded number. Defined cases: null and empty texts have no tokens; every text is decoded to itself, except that U+2581
becomes a blank; repeated rows are encoded each for itself.
"""

from __future__ import annotations

import heapq
import re
import struct
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mailsift.llm.common import append_struct, prepare

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Segments, and pairs of pieces, that a worker remembers in each of two generations (some 400 and 200 bytes for one).
REMEMBER = 400_000
NORMAL, UNKNOWN, USER, UNUSED, BYTE = 1, 2, 4, 5, 6
UNIGRAM, BPE = 1, 2
INFINITY = float("inf")


def fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = data[at: at + size]
            at += size
        yield tag >> 3, value


class Transducer:
    """A compiled model. ``ids`` of pieces, ``rank`` of pieces (0 is merged first) and the last merge of each."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        kind, self.byte_fallback, self.prefix = UNIGRAM, False, True
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif number == 2:
                spec = dict(fields(value))
                kind, self.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(fields(value))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only the identity normaliser without removal of blanks is compiled")
                self.prefix = bool(spec.get(3, 1))
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are compiled")
        self.kind = kind
        usable = [(p, s, i) for i, (p, s, t) in enumerate(self.pieces) if t in (NORMAL, USER, UNUSED) and p]
        self.ids = {p: i for p, _, i in usable}
        self.score = {p: s for p, s, _ in usable}
        self.unknown = next((i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.rank, self.last = {}, {}
        self.apart: dict[tuple[str, str], bool] = {}
        if kind == BPE:
            self._merges()
        alphabet = {c for p in self.ids if len(p) > 1 for c in p}
        # Segments: a word with the blank before it, runs of blanks, and line ends if no piece holds one.
        line = "" if "\n" in alphabet else "\n"
        self.tokens = re.compile(f"{BLANK}?[^{BLANK}{line}]+|{BLANK}+(?={BLANK}[^{BLANK}{line}])|{BLANK}+" + (f"|{line}+" if line else "")).findall
        self.written = [bytes([int(p[3:5], 16)]) if t == BYTE else p.encode() for p, _, t in self.pieces]
        if any(BLANK in p.lstrip(BLANK) or len(p) > 1 and p.startswith(BLANK * 2) and p.strip(BLANK) for p in self.ids):
            raise ValueError("a piece goes on after a blank; segments would not be independent")
        self.memo: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.remember = REMEMBER
        self.older_apart: dict[tuple, bool] = {}
        self.runs: dict[int, tuple] = {}

    def _merges(self) -> None:
        """The last merge of every piece that BPE can build, in the order of priority."""
        order = sorted((p for p in self.ids if len(p) > 1 and p.strip(BLANK)), key=lambda p: -self.score[p])
        self.rank = {p: k + 1 for k, p in enumerate(order)}
        for p in order:
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if all(len(x) == 1 or x in self.last and self.rank[x] < self.rank[p] for x in (a, b)) and \
                        self._keep_apart(a, b, self.rank[p]):
                    self.last[p] = (a, b)
                    break

    def _keep_apart(self, left: str, right: str, limit: float = INFINITY) -> bool:
        """True if no merge before ``limit`` crosses the border of the two pieces when they are built side by side.

        Along the border, ``left`` was preceded by the right part of its last merge, and so on; each part lives until the
        merge that uses it. A crossing merge happens if it comes before the end of both parts; at equal priority
        the one further left is first, which the left piece's own merge is and the right piece's is not.
        """
        spine, end = [], limit
        a = left
        while True:
            spine.append((a, end))
            if a not in self.last:
                break
            end, a = self.rank[a], self.last[a][1]
        end, b = limit, right
        while True:
            start_b = self.rank[b] if b in self.last else 0
            for a, end_a in spine:
                start = max(start_b, self.rank[a] if a in self.last else 0)
                crossing = self.rank.get(a + b)
                if crossing is not None and start < min(end_a, end) and crossing < end_a and crossing <= end:
                    return False
            if b not in self.last:
                return True
            end, b = self.rank[b], self.last[b][0]

    def weight(self, before: str | None, piece: str) -> float:
        """Weight of an arc after another one."""
        if self.kind == UNIGRAM:
            return -self.score[piece] if piece in self.score else 1e6
        if before is None:
            return 0.0
        pair = (before, piece)
        apart = self.apart.get(pair)
        if apart is None:
            if len(self.apart) >= self.remember:
                self.older_apart, self.apart = self.apart, {}
            apart = self.older_apart.get(pair)
            if apart is None:
                apart = self._keep_apart(before, piece)
            self.apart[pair] = apart
        return 0.0 if apart else INFINITY

    def path(self, segment: str) -> list[str]:
        """Pieces (and single characters without a piece) of the shortest path."""
        pieces = self.last if self.kind == BPE else self.score
        free = self.kind == BPE  # all weights are 0 or infinity: a path of weight 0 is least
        apart, weight = self.apart, self.weight
        total_to, last, since = [0.0], [None], [0]
        for end in range(1, len(segment) + 1):
            least, least_piece, least_start = INFINITY, None, 0
            for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                piece = segment[start:end]
                if piece in pieces or start == end - 1:
                    before = last[start]
                    if free and before is not None and (before, piece) in apart:
                        step = 0.0 if apart[before, piece] else INFINITY
                    else:
                        step = weight(before, piece)
                    total = total_to[start] + step
                    if total < least:
                        least, least_piece, least_start = total, piece, start
                        if free:
                            break
            total_to.append(least)
            last.append(least_piece)
            since.append(least_start)
        out, end = [], len(segment)
        while end:
            out.append(last[end])
            end = since[end]
        return out[::-1]

    def blanks(self, n: int) -> tuple:
        """Ids of a run of n blanks: pieces of equal priority merge from the left."""
        if n not in self.runs:
            if self.kind == UNIGRAM:
                parts = self.path(BLANK * n)
            else:
                size = {i: 1 for i in range(n)}
                after = {i: i + 1 for i in range(n)}
                before = {i: i - 1 for i in range(n)}
                heap = [(0.0, i, 1, 1) for i in range(n - 1)]
                heap = [(-self.score[BLANK * 2], i, 1, 1) for _, i, _, _ in heap] if BLANK * 2 in self.score else []
                while heap:
                    _, i, a, b = heapq.heappop(heap)
                    j = after.get(i, n)
                    if size.get(i) != a or size.get(j) != b:
                        continue
                    size[i] += size.pop(j)
                    after[i] = after.pop(j)
                    if after[i] < n:
                        before[after[i]] = i
                    for x in (before[i], i):
                        y = after.get(x, n) if x >= 0 else n
                        if y < n and (p := BLANK * (size[x] + size[y])) in self.score:
                            heapq.heappush(heap, (-self.score[p], x, size[x], size[y]))
                parts = [BLANK * size[i] for i in sorted(size)]
            if len(self.runs) > 10_000:
                self.runs.clear()
            self.runs[n] = tuple(self.outputs(parts))
        return self.runs[n]

    def outputs(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            if p in self.ids:
                out.append(self.ids[p])
            elif self.byte_fallback:
                out += [self.bytes[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return out

    def segment(self, text: str) -> tuple[bool, tuple]:
        """(starts with a blank that stays alone, ids of the rest)."""
        known = self.memo.get(text)
        if known is None:
            if len(self.memo) >= self.remember:
                self.older, self.memo = self.memo, {}
            known = self.older.get(text)
            if known is None:
                parts = self.path(text)
                alone = parts[0] == BLANK
                known = (alone, tuple(self.outputs(parts[alone:])))
            self.memo[text] = known
        return known

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out, waiting = [], 0
        for token in self.tokens((BLANK if self.prefix else "") + text.replace(" ", BLANK)):
            found = self.memo.get(token)
            if found is None:
                if not token.strip(BLANK):
                    waiting += len(token)
                    continue
                if token[0] == "\n":
                    out += self.blanks(waiting) if waiting else ()
                    out += self.outputs(["\n"]) * len(token)
                    waiting = 0
                    continue
                found = self.segment(token)
            alone, ids = found
            if alone or waiting:
                out += self.blanks(waiting + alone)
                waiting = 0
            out += ids
        if waiting:
            out += self.blanks(waiting)
        return out

    def decode(self, ids: list[int]) -> str:
        """The output side read backwards: pieces and bytes to text."""
        if not ids:
            return ""
        text = b"".join(map(self.written.__getitem__, ids)).decode(errors="replace").replace(BLANK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(4)
def compiled(data: bytes) -> Transducer:
    """One transducer per Python worker and model."""
    return Transducer(data)


FIELDS = [("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), ("n_tokens", T.LongType(), pa.int64()),
          ("same", T.BooleanType(), pa.bool_())]


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL, name: str = "pieces", remember: int = REMEMBER) -> DataFrame:
    """All columns of ``docs`` and last the struct ``name``: ids, their number, and whether they decode to the text.

    ``remember`` bounds what a worker keeps of segments that it has encoded: fewer take less memory and more time, the
    result is the same."""
    spark = docs.sparkSession
    prepare(spark)
    with open(model, "rb") as f:  # a model file of at most a few MB beside the driver; tasks get its bytes
        shared = spark.sparkContext.broadcast(f.read())

    def make():
        fst = compiled(shared.value)
        fst.remember = remember

        def one(text):
            ids = fst.encode(text)
            return ids, len(ids), fst.decode(ids) == (text or "").replace(BLANK, " ")
        return one

    return append_struct(docs, text_col, name, FIELDS, make)
