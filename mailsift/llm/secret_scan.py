"""Secret scans with DataFrame functions only.

Three base patterns give spans (kinds assign, access, hex). Further candidate strings of one character class are judged
by the Shannon entropy of a sliding window: a fold over the characters keeps a count per character and adds the change
of c*log2(c) for the character that enters and the one that leaves, in integer millionths so that results are the same
everywhere. A candidate is suspicious if its best window reaches the bound of its class and no allow-list rule matches.

Places: ``split`` gives the texts between the matches of a pattern, so a match starts at the sum of the gaps up to it and
of the matches before it; the sums are window sums over the exploded matches of a row, no growing arrays. Only lengths
are shuffled, never texts (``redact`` carries each text once).

Defined cases: null and empty texts have no spans; repeated rows are scanned each for itself; ties of start are ordered by
the kinds as listed; extra columns pass through ``redact``; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailsift.llm.common import sha256_joined

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = "(?i)(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_MIN = 12
ACCESS = "AKIA[A-Z0-9]{14,}"  # 18 characters or more
HEX = "[0-9a-f]{16,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Character classes in order: pattern of the whole candidate, least entropy in bits of a window of 20 characters.
CLASSES = (("^[0-9a-fA-F]+$", 3.0), ("^[a-z_-]+$", 4.2), ("^[A-Z_-]+$", 4.2), ("^[A-Za-z_-]+$", 4.0), ("", 3.6))
#: Candidates that are never secrets: decimal numbers, UUIDs, words with hyphens, paths, placeholders, sequences.
ALLOW = ("^[0-9_-]+$", "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "^[A-Za-z]+([-_][A-Za-z]+)+$",
         "^/?[A-Za-z_-]+(/[A-Za-z_-]+)+/?$", "(?i)example|placeholder|changeme|your[-_]|dummy|redacted|x{6}",
         "0123456789|abcdefghij|^(.)\\1+$")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_UNIT = 1_000_000


def weight(c: int) -> int:
    """c * log2(c) in millionths."""
    return round(c * math.log2(c) * _UNIT) if c > 1 else 0


def least_weight(candidate: Column) -> Column:
    """Least sum of weights over all windows: the window of the highest entropy, by incremental counts."""
    chars = F.split(candidate, "")
    gone = F.concat(F.array_repeat(F.lit(""), WINDOW), chars)
    steps = F.slice(F.arrays_zip(chars.alias("into"), gone.alias("out")), F.lit(1), F.length(candidate))
    weights = F.array(*[F.lit(weight(c)).cast("long") for c in range(WINDOW + 2)])
    start = F.struct(F.array_repeat(F.lit(0), len(_ALPHABET)).alias("counts"), F.lit(0).cast("long").alias("total"),
                     F.lit(0).alias("n"), F.lit(1 << 60).cast("long").alias("best"))

    def count(counts: Column, ch: Column) -> Column:
        return F.element_at(counts, F.instr(F.lit(_ALPHABET), ch))

    def step(acc: Column, x: Column) -> Column:
        into, out = x["into"], x["out"]
        same = into == out
        a = count(acc.counts, into)
        added = F.when(same, 0).otherwise(F.get(weights, a + 1) - F.get(weights, a))
        b = F.when(out == "", 0).otherwise(count(acc.counts, F.when(out == "", "A").otherwise(out)))
        taken = F.when(same | (out == ""), 0).otherwise(F.get(weights, b - 1) - F.get(weights, b))
        total = acc.total + added + taken
        counts = F.when(same, acc.counts).otherwise(F.transform(
            acc.counts, lambda c, k: c + (k == F.instr(F.lit(_ALPHABET), into) - 1).cast("int")
            - ((out != "") & (k == F.instr(F.lit(_ALPHABET), out) - 1)).cast("int")))
        return F.struct(counts.alias("counts"), total.alias("total"), (acc.n + 1).alias("n"),
                        F.when(acc.n + 1 >= WINDOW, F.least(acc.best, total)).otherwise(acc.best).alias("best"))

    return F.aggregate(steps, start, step, lambda acc: acc.best)


def suspicious(candidate: Column) -> Column:
    """Entropy test and allow-list of one candidate string."""
    most = F.lit(None)
    for pattern, bits in reversed(CLASSES):
        bound = F.lit(round(WINDOW * (math.log2(WINDOW) - bits) * _UNIT)).cast("long")
        most = bound if not pattern else F.when(candidate.rlike(pattern), bound).otherwise(most)
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | candidate.rlike(pattern)
    return F.when(allowed, False).otherwise(least_weight(candidate) <= most)


def _items(text: Column, kind: str, pattern: str, test, group: int = 0) -> Column:
    """Array of (kind number, gap before the match, length, passes) of one pattern; the fold sees one element a time."""
    zipped = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
                          F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
                          F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    rows = F.transform(zipped, lambda x: F.struct(
        F.lit(KINDS.index(kind)).alias("k"), x["gap"].alias("gap"), F.length(x["match"]).alias("len"),
        test(x["value"]).alias("ok")))
    none = F.array().cast("array<struct<k:int,gap:int,len:int,ok:boolean>>")
    return F.when(text.rlike(pattern), F.filter(rows, lambda x: x.len.isNotNull())).otherwise(none)


def spans(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), whole: bool = False) -> DataFrame:
    """One row per document: a struct ``c`` of the carried columns and ``found``, the sorted array of
    (start, k, end, before), ``before`` being the largest end of the spans in front of it. ``whole`` also keeps the
    text in ``c`` as a last field."""
    text = F.col(f"`{text_col}`")
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    yes = lambda m: F.lit(True)
    src = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*kept, *([text.alias("t")] if whole else [])).alias("c"),
                      F.concat(_items(text, "assign", ASSIGN, lambda v: F.length(v) >= ASSIGN_MIN, 1),
                               _items(text, "access", ACCESS, yes), _items(text, "hex", HEX, yes),
                               _items(text, "entropy", CANDIDATE, suspicious)).alias("items"))
    src = src.withColumn("items", F.coalesce("items", F.array().cast("array<struct<k:int,gap:int,len:int,ok:boolean>>")))
    rows = src.select("rid", "c", F.posexplode_outer("items").alias("at", "x"))
    first = F.coalesce("at", F.lit(0)) == 0
    rows = rows.select("rid", F.when(first, F.col("c")).alias("c"), "at", "x.*").repartition("rid")
    w = Window.partitionBy("rid", "k").orderBy("at")
    rows = rows.withColumn("start", F.sum(F.col("gap").cast("long")).over(w) + F.coalesce(
        F.sum(F.col("len").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("end", F.col("start") + F.col("len"))
    order = Window.partitionBy("rid").orderBy("start", "k", "at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.max(F.when(F.col("ok"), F.col("end"))).over(order), F.lit(0)))
    span = F.when(F.col("ok"), F.struct("start", "k", "end", "before"))
    return rows.groupBy("rid").agg(F.first("c", ignorenulls=True).alias("c"),
                                   F.sort_array(F.collect_list(span)).alias("found")).drop("rid")


def _named(array: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.transform(array, lambda s: F.concat_ws(":", F.get(names, s.k), s.start.cast("string"), s.end.cast("string")))


def find_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per document: the counts of the base kinds, the digest of the base spans and all spans as text."""
    out = spans(docs, text_col, (id_col,))
    n = lambda kind: F.size(F.filter("found", lambda s: s.k == KINDS.index(kind))).cast("long")
    base = F.filter("found", lambda s: s.k < 3)
    return out.select(F.col("c.c0").alias(id_col), n("assign").alias("n_assign"), n("access").alias("n_access"),
                      n("hex").alias("n_hex"), sha256_joined(_named(base)).alias("base_sha256"),
                      F.array_join(_named(F.col("found")), ",").alias("spans"), n("entropy").alias("n_entropy"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret (the union of its spans) replaced by ``mark``; same columns."""
    out = spans(docs, text_col, tuple(docs.columns), whole=True)
    t = F.col("c.t")
    pieces = F.transform("found", lambda s: F.concat(
        t.substr((s.before + 1).cast("int"), F.greatest(s.start - s.before, F.lit(0)).cast("int")),
        F.when((s.start >= s.before) | (s.before == 0), mark).otherwise("")))
    last = F.array_max(F.transform("found", lambda s: s.end))
    done = F.concat(F.array_join(pieces, ""), t.substr((last + 1).cast("int"), F.length(t)))
    text = F.when(F.size("found") == 0, t).otherwise(done)
    return out.select(*[(text if c == text_col else F.col(f"c.c{i}")).alias(c) for i, c in enumerate(docs.columns)])


