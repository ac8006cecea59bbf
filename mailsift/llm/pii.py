"""Personal data: base patterns, and a boosted-tree verdict on the spans of high-recall generators.

Base kinds (email, ip, card, phone) always stay. Generators propose overlapping spans of digits with separators, address
tokens around an at sign (also a written one), and letter-digit account numbers. Validators that are not the base patterns
(check digits of account numbers, cue word and digit format, written-out addresses; dates, decimals and the like are
refuted) label what they can; proposals on base spans are personal, and what nobody decides stays unlabelled.
Gradient-boosted trees over format and context features, without the plus and at signs that make a base span, learn these
labels in a bounded sample of documents (``TRAIN_DOCS``, at most ``TRAIN_ROWS`` spans, both parameters), half of which
calibrates scores and the threshold. Of the spans that touch no base span, validated ones and undecided ones over the
threshold are added as kind ``model``.

Patterns are applied so that the time stays linear in the text: runs are entered at their start only, and addresses are
looked for at their at sign. Defined cases: null and empty texts have no spans; without labelled spans of both classes only
validated spans are added; repeated rows are scanned each for itself; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift.llm.common import append_struct, prepare

KINDS = ("email", "ip", "card", "phone", "model")
TRAIN_DOCS, TRAIN_ROWS = 5000, 20_000
ROUNDS, RATE, BINS, PRECISION = 40, 0.2, 16, 0.95
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_chain = re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,29}")
_account = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){10,30}")
_dot = r"(?:\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20)"
_at = re.compile(r"[^\s@]{1,64}(?:@|\x20at\x20|\x20?(?:\(at\)|\[at\])\x20?)[^\s@]{1,64}(?:" + _dot + r"[^\s@]{1,64}){0,4}")
_hidden = re.compile(r"[\w.%+-]+(\x20at\x20|\x20?(?:\(at\)|\[at\])\x20?)[A-Za-z0-9-]+(?:(?:\.|" + _dot + r")[A-Za-z0-9-]+)*"
                     r"(?:\.|(" + _dot + r"))[A-Za-z]{2,24}[.,;:!?)]*")
_date = re.compile(r"(?:(?:19|20)[0-9]{2}([-./\x20])[01]?[0-9]\1[0-3]?[0-9]|[0-3]?[0-9]([-./])[0-3]?[0-9]\2(?:19|20)[0-9]{2})(?![0-9])")
_decimal = re.compile(r"[0-9]+\.[0-9]+")
_called = re.compile(r"\b(?:tel|telephone|phone|call|mobile|cell|fax|contact|whatsapp)\b[^0-9]{0,12}$")
_banked = re.compile(r"\b(?:account|iban|a/c)\b[^0-9]{0,12}$")
_ssn = re.compile(r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}")
#: Lengths of account numbers by country.
IBAN = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 "
    "GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 "
    "MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 "
    "XK20").split()}
_digit = re.compile("[^0-9]+")
CUES = ("tel", "phone", "call", "mobile", "fax", "card", "visa", "iban", "account", "mail", "contact", "ssn", "id", "ip")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(x * 2 - 9 * (x > 4) for x in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, sorted."""
    found = []
    last, at = 0, text.find("@")
    while at >= 0:
        m = _domain.match(text, at + 1)
        start = last + len(text[last:at].rstrip(_LOCAL))
        if m and start < at:
            found.append((start, 0, m.end()))
            last = m.end()
        elif not m:
            last = max(last, at)  # nothing before this sign can be part of a later address
        at = text.find("@", max(at + 1, last))
    for m in _ip.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _card.finditer(text):
        if m.end() - m.start() <= 40:
            digits = _digit.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in _phone.finditer(text):
        if 9 <= len(_digit.sub("", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    found.sort()
    return found


def _cut(m: re.Match) -> tuple[int, int]:
    """The span of an account number, without capitals that follow a known country's length."""
    left = IBAN.get(m[0][:2], len(m[0]))
    for at, c in enumerate(m[0]):
        left -= c != " "
        if not left:
            return m.start(), m.start() + at + 1
    return m.span()


def verdict_of(text: str, start: int, end: int) -> int | None:
    """1 for a validated span, 0 for a refuted one, None where no validator decides. Base patterns are not asked."""
    s, before = text[start:end], text[max(0, start - 24):start].lower()
    if _account.fullmatch(s):
        code = s.replace(" ", "")
        return int(IBAN.get(code[:2]) == len(code) and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1)
    if not _chain.fullmatch(s):
        m = _hidden.fullmatch(s)
        if not m:
            return 0
        return 1 if m[1] != " at " or m[2] or "mail" in before or "contact" in before else None
    digits, groups = _digit.sub("", s), re.findall("[0-9]+", s)
    if (_date.match(s) and len(digits) <= 14) or _decimal.fullmatch(s) or len(set(digits)) == 1 or max(map(len, groups)) == 1:
        return 0
    if len(digits) > 19 or (len(digits) > 15 and not luhn(digits)):
        return 0
    if _called.search(before) and 7 <= len(digits) <= 15 or _banked.search(before) and 8 <= len(digits) <= 17:
        return 1
    return 1 if _ssn.fullmatch(s) and "ssn" in before else None


def proposals(text: str) -> list[tuple[int, int]]:
    spans = {m.span() for m in _chain.finditer(text)} | {_cut(m) for m in _account.finditer(text)}
    if "@" in text or " at " in text or "at)" in text or "at]" in text:
        spans |= {m.span() for m in _at.finditer(text)}
    return sorted(spans)


def features(text: str, start: int, end: int) -> list[float]:
    """Format and context of a span; the signs of the base patterns are masked, as no span to be added has them."""
    s, before, after = text[start:end], text[max(0, start - 24):start], text[end:end + 12]
    s, before = s.replace("@", " at "), before.rstrip("+")
    digits = sum(map(str.isdigit, s))
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    low = before.lower()
    return [len(s), digits, digits / len(s), sum(map(str.isalpha, s)), sum(map(str.isupper, s)), len(groups),
            max(groups, default=0), min(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0,
            s.count("."), s.count("-"), s.count(" "), s.count("("), float(before[-1:].isalnum()), float(after[:1].isalnum()),
            float(any(c in low for c in CUES)), float(before.rstrip().endswith((":", "="))), float(after[:1] in (".", ",")),
            len(set(s)) / len(s), float(s[:1] == "4")]


class Boosted:
    """Boosted trees of depth two on binned features, logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self._bins(x)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start, self.trees = float(np.log(rate / (1 - rate))), []
        score = np.full(len(y), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p) + 1e-9
            top = self._split(binned, grad, hess, np.ones(len(y), bool))
            side = binned[:, top[0]] > top[1]
            tree = [top, *(self._split(binned, grad, hess, m) for m in (~side, side))]
            self.trees.append(tree)
            score += RATE * self._leaf(tree, binned)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)

    @staticmethod
    def _split(binned, grad, hess, mask) -> tuple[int, int, float, float]:
        """(feature, bin, value at or below, value above) of the best split of the masked rows."""
        g, h = grad[mask], hess[mask]
        best = (0, BINS, g.sum() / (h.sum() + 1), 0.0)
        gain = g.sum() ** 2 / (h.sum() + 1)
        for f in range(binned.shape[1]):
            gs = np.cumsum(np.bincount(binned[mask, f], g, BINS + 1))
            hs = np.cumsum(np.bincount(binned[mask, f], h, BINS + 1))
            right_g, right_h = gs[-1] - gs, hs[-1] - hs
            value = gs ** 2 / (hs + 1) + right_g ** 2 / (right_h + 1)
            k = int(value.argmax())
            if value[k] > gain + 1e-9:
                gain = value[k]
                best = (f, k, float(gs[k] / (hs[k] + 1)), float(right_g[k] / (right_h[k] + 1)))
        return best

    @staticmethod
    def _leaf(tree, binned) -> np.ndarray:
        (f, k, *_), left, right = tree
        part = lambda t: np.where(binned[:, t[0]] > t[1], t[3], t[2])
        return np.where(binned[:, f] > k, part(right), part(left))

    def score(self, x: np.ndarray) -> np.ndarray:
        binned = self._bins(x)
        return self.start + RATE * sum((self._leaf(t, binned) for t in self.trees), np.zeros(len(x)))


class Verdict:
    """Trees, calibration (a + b * score as log odds) and the probability from which spans are chosen."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray):
        self.trees = Boosted(x[~fold], y[~fold])
        s, t = self.trees.score(x[fold]), y[fold]
        self.a, self.b = 0.0, 1.0
        for _ in range(50):  # Newton steps of a logistic fit with a weak pull to (0, 1)
            p = self._p(s)
            d = np.array([(t - p).sum() - self.a, ((t - p) * s).sum() - (self.b - 1)])
            w = p * (1 - p)
            hess = np.array([[w.sum() + 1, (w * s).sum()], [(w * s).sum(), (w * s * s).sum() + 1]])
            step = np.linalg.solve(hess, d)
            self.a, self.b = self.a + step[0], self.b + step[1]
        p = self._p(s)
        order = np.argsort(-p)
        good = np.cumsum(t[order]) / np.arange(1, len(p) + 1) >= PRECISION
        self.threshold = float(p[order][np.flatnonzero(good)[-1]]) if good.any() else 2.0

    def _p(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a + self.b * score, -50, 50)))

    def chosen(self, x: np.ndarray) -> np.ndarray:
        return self._p(self.trees.score(x)) >= self.threshold


def labelled(text: str) -> list[tuple[list[float], int]]:
    """Features of the proposals that hold or touch a base span (1) or that a validator decides (1 or 0)."""
    base, out = base_spans(text), []
    for s, e in proposals(text):
        y = 1 if any(a < e and s < b for a, _, b in base) else verdict_of(text, s, e)
        if y is not None:
            out.append((features(text, s, e), y))
    return out


def train(docs: DataFrame, id_col: str, text_col: str, train_docs: int = TRAIN_DOCS, train_rows: int = TRAIN_ROWS) -> Verdict | None:
    # The ids of least hash are found without their texts; repeated ids count once and give their least text.
    keyed = docs.select(F.xxhash64(F.col(id_col)).alias("k"), F.col(text_col).cast("string").alias("t"))
    cut = keyed.select("k").distinct().orderBy("k").limit(train_docs).agg(F.max("k").alias("k")).first().k
    if cut is None:
        return None
    sample = keyed.where(F.col("k") <= F.lit(cut)).groupBy("k").agg(F.min("t").alias("t"))

    def run(batches):
        for b in batches:
            rows = [(k, i, *r) for k, t in zip(*(c.to_pylist() for c in b.columns)) if t for i, r in enumerate(labelled(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(
                (pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.int32()))], names=["k", "i", "x", "y"])

    rows = sample.mapInArrow(run, "k long, i int, x array<double>, y int").orderBy("k", "i").limit(train_rows).collect()
    rows = sorted((tuple(r.x), r.y) for r in rows)
    y = np.array([r[1] for r in rows], float)
    fold = np.arange(len(y)) % 2 == 1
    if not len(y) or any(len(set(y[m])) < 2 for m in (fold, ~fold)):
        return None
    return Verdict(np.array([r[0] for r in rows]), y, fold)


def scan(text: str | None, verdict: Verdict | None) -> list[tuple[int, int, int]]:
    if not text:
        return []
    found = base_spans(text)
    spans = proposals(text)
    if spans:
        decided = [verdict_of(text, s, e) for s, e in spans]
        chosen = verdict.chosen(np.array([features(text, s, e) for s, e in spans])) if verdict else [False] * len(spans)
        last = -1
        # Validated spans first: an undecided one that overlaps them must not take their place.
        sure = [x for x, y in zip(spans, decided) if y == 1]
        for (s, e), yes, y in zip(spans, chosen, decided):
            if y is None and yes and not any(a < e and s < b for a, b in sure) or y == 1:
                if s >= last and not any(a < e and s < b for a, k, b in found if k < 4):
                    found.append((s, 4, e))
                    last = e
    return sorted(found)


FIELDS = [(f"n_{k}", T.LongType(), pa.int64()) for k in KINDS] + [("base_sha256", T.StringType(), pa.string()),
                                                                  ("spans", T.StringType(), pa.string())]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "pii", train_docs: int = TRAIN_DOCS,
             train_rows: int = TRAIN_ROWS) -> DataFrame:
    """All columns of ``docs`` and last the struct ``name``: counts per kind, digest of the base spans, all spans."""
    prepare(docs.sparkSession)
    verdict = train(docs, id_col, text_col, train_docs, train_rows)

    def one(text):
        found = scan(text, verdict)
        named = [f"{KINDS[k]}:{s}:{e}" for s, k, e in found]
        base = ",".join(n for n, (_, k, _) in zip(named, found) if k < 4)
        return (*(sum(k == i for _, k, _ in found) for i in range(5)), hashlib.sha256(base.encode()).hexdigest(), ",".join(named))

    return append_struct(docs, text_col, name, FIELDS, lambda: one)
