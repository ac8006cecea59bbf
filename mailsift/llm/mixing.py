"""Mixing sources to target weights with DataFrame functions only: whole copies, then Pareto order sampling.

A source's target is its weighted share of ``share`` times all words; targets stop at ``most`` times the source's words and
what is over goes to the other sources by weight until none is above. Over the sources sorted by cap / weight the level of
the others after the first k are capped is (words - their caps) / (the others' weights), and the first source whose cap
lies above it ends the search; so running sums give what rounds of sharing would. Weights are above 0.

Within a source a document expects target / words copies, times its own weight where a weight column is given. Its whole
part is allocated as certain copies. The rest, l in [0, 1), is its inclusion probability in a sample that adds one more
copy: with a uniform u from a hash, documents are ranked by the random odds over the inclusion odds, u/(1-u) / (l/(1-l)),
and the smallest are taken until the sample has its fixed size, the words that the target still lacks. The document in
which that size is reached is taken if more than half of it lies below, so a source misses its target by at most half a
document (where no document weights force more). Running sums come from ranges of the order (``operators.ranks``), so a
source with most of the rows is spread over many tasks; per-source numbers are joined by broadcast up to
``BROADCAST_SOURCES`` sources and by salted rows beyond.

Defined cases: null and empty texts have size 0 and are never taken; null is a source of its own, the last one; equal rows
have equal keys and which of them the sample ends with does not change the result's rows; sources without words have
target 0; null or negative document weights count as 0, and a source with only those as if it had none; an empty table
gives an empty table; further columns pass through under their names and clashing new names get a leading underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import fresh, written
from mailsift.operators.ranks import numbered, running_sums

WEIGHTS = (3, 1, 2)
SHARE, MOST, SEED = 1.5, 2.0, 7
BROADCAST_SOURCES = 50_000
SALTS = 32
ROUNDS = 60
_UNIT = 1 << 52


def n_words(text: Column) -> Column:
    """Number of runs of characters other than the six ASCII blanks."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1 from the MD5 of the parts: (k + 0.5) / 2^52, exact as a double."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(_UNIT)


def _joined(rows: DataFrame, per: DataFrame, n: int, on: str, spread: Column, limit: int = BROADCAST_SOURCES) -> DataFrame:
    """``rows`` with the columns of ``per`` (one row for each value of ``on``, ``n`` of them), null equal to null."""
    key = fresh(per, "of")
    per = per.withColumnRenamed(on, key)
    same = F.col(f"`{on}`").eqNullSafe(F.col(key))
    if n <= limit:
        return rows.join(F.broadcast(per), same).drop(key)
    salt, other = fresh(rows, "salt"), fresh(rows, "salted")
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    per = per.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return rows.join(per, same & (F.col(salt) == F.col(other))).drop(key, salt, other)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes`` has a row (source, source_size) for each source; adds ``target``. Weights repeat over the sources in order."""
    order = [F.col("source").isNull(), F.col("source")]
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = numbered(sizes, order, "no").withColumn("w", F.get(cycle, F.pmod(F.col("no") - 1, F.lit(len(weights))).cast("int")))
    per = per.withColumn("cap", most * F.col("source_size"))
    words = share * (sizes.agg(F.sum("source_size")).first()[0] or 0)
    ranked = running_sums(per, [], [F.col("cap") / F.col("w"), F.col("no")], {"caps": F.col("cap"), "ws": F.col("w")})
    all_w = per.agg(F.sum("w")).first()[0] or 0.0
    ranked = ranked.withColumn("num", words - (F.col("caps") - F.col("cap"))).withColumn("den", all_w - (F.col("ws") - F.col("w")))
    level = ranked.where(F.col("w") * F.col("num") / F.col("den") <= F.col("cap"))
    level = level.agg(F.min(F.struct(F.col("cap") / F.col("w"), "no", "num", "den")).alias("x")).first().x
    share_of = F.col("w") * F.lit(level.num) / F.lit(level.den) if level else F.col("cap")
    return per.select("source", "source_size", F.least("cap", share_of).alias("target"))


def _copies(rows: DataFrame, per: DataFrame, n: int, most: float, spread: Column) -> DataFrame:
    """Expected copies ``m`` of every row: weight times a level of its source, at most ``most``, words adding up to the target.

    Each round caps the rows above ``most`` and gives the rest to the others; it ends when no further row is capped."""
    level = per.select("source", "target", (F.col("target") / F.nullif("weighted", F.lit(0.0))).alias("c"))
    capped = -1
    for _ in range(ROUNDS):
        out = _joined(rows, level, n, "source", spread)
        over = F.col("c") * F.col("weight") >= most
        sums = out.groupBy("source", "target").agg(
            F.sum(F.when(over, most * F.col("size")).otherwise(0.0)).alias("full"), F.count(F.when(over, 1)).alias("k"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight") * F.col("size"))).alias("open"))
        sums = written(sums, "levels")
        now = sums.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
        if now == capped:
            break
        capped = now
        level = sums.select("source", "target", ((F.col("target") - F.col("full")) / F.nullif("open", F.lit(0.0))).alias("c"))
    return out.withColumn("m", F.coalesce(F.least(F.lit(most), F.col("c") * F.col("weight")), F.when(over, most).otherwise(0.0))).drop("c", "target")


def mix(docs: DataFrame, size: Column | None = None, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
        weight_col: str | None = None, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED,
        keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` (without the text unless ``keep_text``) and size, source_size, target, copies, taken.

    ``copies`` counts how often the mix takes the document, ``taken`` its words."""
    text = F.col(f"`{text_col}`")
    rest = [c for c in docs.columns if keep_text or c != text_col]
    rows = written(docs.select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).alias("row"),
        F.col(f"`{source_col}`").alias("source"), F.col(f"`{id_col}`").cast("string").alias("id"),
        (n_words(text) if size is None else F.coalesce(size, F.lit(0)).cast("long")).alias("size"),
        uniform(F.lit(seed), F.col(f"`{id_col}`"), F.md5(F.coalesce(text, F.lit("")))).alias("u"),
        (F.lit(1.0) if weight_col is None else F.greatest(F.coalesce(F.col(f"`{weight_col}`").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("weight")), "sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("weight") * F.col("size")).alias("weighted"))
    sums = written(sums, "sources")
    per = written(targets(sums.select("source", "source_size"), weights, share, most), "targets")
    n = per.count()
    spread = F.struct("id", "u")
    if weight_col is None:
        out = _joined(rows, per, n, "source", spread)
        out = out.withColumn("m", F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0)))
    else:
        both = sums.drop("source_size").withColumnRenamed("source", "s").join(per, F.col("s").eqNullSafe(F.col("source"))).drop("s")
        out = _joined(_copies(rows, both, n, most, spread), per, n, "source", spread)
    out = out.withColumn("whole", F.floor("m").cast("long"))
    certain = out.groupBy("source").agg((F.max("target") - F.sum(F.col("whole") * F.col("size"))).alias("lacking"))
    out = _joined(out, written(certain, "lacking"), n, "source", spread)
    out = out.withColumn("l", F.when(F.col("m") > F.col("whole"), F.col("m") - F.col("whole")))
    out = out.withColumn("q", (F.col("u") / (1 - F.col("u"))) / (F.col("l") / (1 - F.col("l"))))
    out = running_sums(out, ["source"], [F.col("q").asc_nulls_last(), F.col("id"), F.col("u")], {"below": F.when(F.col("q").isNotNull(), F.col("size")).otherwise(0)})
    more = F.col("q").isNotNull() & (2 * F.col("below") - F.col("size") <= 2 * F.col("lacking"))
    out = out.withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + more.cast("long")).cast("long"))
    columns = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(rest)]
    new = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": F.col("copies"), "taken": F.col("copies") * F.col("size")}
    named = out.select(F.struct(*columns).alias("d"), *[v.alias(f"v{i}") for i, v in enumerate(new.values())])
    names = [fresh(docs, k) for k in new]
    return named.select("d.*", *[F.col(f"v{i}").alias(k) for i, k in enumerate(names)])
