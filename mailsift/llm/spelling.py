"""Spelling variant grouping: words one edit apart, found by a relational trie frontier, and the forms they point to.

Words are counted over all texts. A trie is a distributed table with one row for each node, the node's prefix being its
name: the characters of its edges and the count of the word that ends there. A frontier of states (word, position, node,
edits) is joined with the nodes of one depth, level by level. A state without an edit goes on along its word, changes to an
edge of a larger character, or drops a character; a state with one edit only follows its word. A state that has read its
word with one edit in a node where a word ends is a pair. Insertions and changes to smaller characters are the same pairs
seen from the other word, so each pair comes out once and is mirrored.

Two tries keep the frontier small: the edit must lie in the second half of the word, and the words turned round have their
own trie for edits in the first half. States so start in the middle of their word, where nodes have few edges. A run of equal
characters can lose any of them with the same result; only its last one is dropped.

Nodes with many words beneath (over a thousandth of all, and over 1000) are stored in several copies and their states are
dealt over them. There are at most 1000 such nodes a depth, so this table is broadcast. Words longer than ``LEVELS``
characters would need a level for each: such words are paired by equal halves (two words one edit apart share the first or the
last half) and compared directly, with the same result.

A word's form is its near word of the largest count if that is at least twice its own, so counts at least double along a
chain; roots come from pointer jumping, as many rounds as the logarithm of the longest chain.

Defined cases: null and empty texts have no words; a null id is written as nothing in ``<id>:<run>``; repeated rows count again;
ties go to the smallest word in code-point order; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import prepare, written

_RUNS = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+").findall
MISSPELT, LEAST_LENGTH, LEAST_COUNT, FACTOR = 97, 5, 3, 2
LEVELS = 48
CROWDED, SHARE = 1000, 1000
#: Different words that a task counts before it gives partial counts.
KEPT = 200_000


def misspelt(run: bytes, h: int) -> bytes:
    """The run without the code point that its hash names."""
    text = run.decode()
    k = h % len(text)
    return (text[:k] + text[k + 1:]).encode()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words. Runs are found in UTF-8, where ``bytes.lower`` changes A-Z only and U+00C0 to U+00FF are
    the byte C3 and one more; each different run of a text is hashed once, going on from the hash of ``<id>:``."""
    counts: dict[bytes, int] = defaultdict(int)

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for rows in batches:
        for low in range(0, rows.num_rows, 100):
            part = rows.slice(low, 100)
            for d, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                start = zlib.crc32(f"{d}:".encode())
                for run, n in Counter(_RUNS(text.encode().lower())).items():
                    if len(run) >= LEAST_LENGTH:
                        h = zlib.crc32(run, start)
                        word = run if h % MISSPELT else misspelt(run, h)
                        if len(word) - word.count(b"\xc3") >= LEAST_LENGTH:
                            counts[word] += n
                if len(counts) >= KEPT:
                    yield batch()
    yield batch()


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words that occur often enough, with their counts."""
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("d"), F.col(f"`{text_col}`").alias("t"))
    counts = rows.where(F.length("t") > 0).mapInArrow(_counted, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _char(word: Column, at: Column) -> Column:
    """The character at a position from 0, empty behind the end."""
    return F.substring(word, at + 1, F.lit(1))


def _turned(found: DataFrame) -> DataFrame:
    """(rev, word, n, length, half): every word and every word turned round; edits are sought from ``half`` on."""
    n = F.char_length("word").cast("int")
    both = found.select("word", "n", n.alias("length"), F.explode(F.array(F.lit(False), F.lit(True))).alias("rev"))
    half = F.floor(F.col("length") / 2).cast("int")
    return both.select("rev", F.when(F.col("rev"), F.reverse("word")).otherwise(F.col("word")).alias("word"), "n", "length",
                       F.when(F.col("rev"), F.col("length") - half).otherwise(half).alias("half"))


def _nodes(both: DataFrame) -> DataFrame:
    """The trie from the words' halves on: (rev, depth, node, chars, ends, beneath)."""
    at = both.select("rev", "word", "n", "length", F.explode(F.sequence("half", "length")).alias("depth"))
    at = at.select("rev", "depth", F.substring("word", F.lit(1), F.col("depth")).alias("node"), _char(F.col("word"), F.col("depth")).alias("ch"),
                   F.when(F.col("depth") == F.col("length"), F.col("n")).alias("n"))
    edges = at.groupBy("rev", "depth", "node", "ch").agg(F.max("n").alias("n"), F.count("*").alias("beneath"))
    return edges.groupBy("rev", "depth", "node").agg(F.array_remove(F.collect_list("ch"), "").alias("chars"), F.max("n").alias("ends"), F.sum("beneath").alias("beneath"))


def _steps() -> Column:
    """What a state becomes at its node: an array of (pos, edits, node, near); ``near`` is the count of the word that was reached."""
    word, pos, node, chars, length = (F.col(c) for c in ("word", "pos", "node", "chars", "length"))
    c, after = _char(word, pos), _char(word, pos + 1)
    none = F.lit(None).cast("long")

    def to(p: Column, ch: Column) -> Column:
        return F.struct(p.alias("pos"), F.concat(node, ch).alias("node"), none.alias("near"))

    here = F.struct(length.alias("pos"), node.alias("node"), F.col("ends").alias("near"))
    empty = F.array().cast("array<struct<pos:int,node:string,near:bigint>>")
    changed = F.transform(F.filter("chars", lambda x: x > c), lambda x: to(pos + 1, x))
    last_of_run = F.when(F.col("rev"), (pos == 0) | (_char(word, pos - 1) != c)).otherwise(after != c)
    dropped = (F.when(~last_of_run, empty).when(pos + 1 == length, F.when(F.col("ends").isNotNull(), F.array(here)).otherwise(empty))
               .when(F.array_contains("chars", after), F.array(to(pos + 2, after))).otherwise(empty))
    followed = (F.when(pos == length, F.when(F.col("ends").isNotNull(), F.array(here)).otherwise(empty))
                .when(F.array_contains("chars", c), F.array(to(pos + 1, c))).otherwise(empty))
    return F.when(F.col("edits") == 0, F.concat(changed, dropped)).otherwise(followed)


def _short_pairs(found: DataFrame) -> DataFrame:
    """(word, n, near, near_n), each pair once, of words of at most ``LEVELS`` characters."""
    both = _turned(found)
    nodes = _nodes(both)
    total, longest = found.agg(F.count("*"), F.max(F.char_length("word"))).first()
    crowded = max(CROWDED, total // SHARE)
    tables = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = written(nodes.repartitionByRange(tables, "depth", "rev", "node"), "trie")
    big = written(nodes.where(F.col("beneath") > crowded).select("rev", "depth", "node", F.ceil(F.col("beneath") / crowded).cast("int").alias("parts")), "crowded")
    levels, states = [], None
    for depth in range(LEAST_LENGTH // 2, (longest or 0) + 1):
        wide = big.where(F.col("depth") == depth).drop("depth")
        parts = F.coalesce("parts", F.lit(1))
        start = both.where((F.col("half") <= depth) & (F.col("length") > depth)).select(
            "rev", "word", "n", "length", F.lit(depth).alias("pos"), F.lit(0).alias("edits"), F.substring("word", 1, depth).alias("node"))
        now = start if states is None else start.unionByName(states)
        now = now.join(F.broadcast(wide), ["rev", "node"], "left").withColumn("part", F.pmod(F.xxhash64("word", "pos"), parts).cast("int")).drop("parts")
        at = nodes.where(F.col("depth") == depth).join(F.broadcast(wide), ["rev", "node"], "left")
        at = at.select("rev", "node", "chars", "ends", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        step = now.join(at, ["rev", "node", "part"]).select("rev", "word", "n", "length", F.explode(_steps()).alias("s"))
        step = written(step.select("rev", "word", "n", "length", "s.pos", F.lit(1).alias("edits"), "s.node", "s.near"), "frontier")
        levels.append(step)
        states = step.where("near IS NULL").drop("near")
    pairs = None
    for level in levels:
        one = level.where("near IS NOT NULL").select("rev", "word", "n", "node", "near")
        pairs = one if pairs is None else pairs.unionByName(one)
    if pairs is None:
        return found.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    way = lambda c: F.when(F.col("rev"), F.reverse(c)).otherwise(F.col(c))
    return pairs.select(way("word").alias("word"), "n", way("node").alias("near"), F.col("near").alias("near_n"))


def _long_pairs(found: DataFrame) -> DataFrame:
    """(word, n, near, near_n), each pair once, of words of which the longer one has more than ``LEVELS`` characters.

    Words one edit apart agree in the first or the last half of the shorter one; the longer one's halves are cut for its own
    length and for the length less one. A pair that agrees in both is taken once."""
    n = F.char_length("word")
    rows = found.where(n >= LEVELS).select("word", "n", n.alias("length"), F.explode(F.array(n, n - 1)).alias("size"))
    half = F.floor(F.col("size") / 2).cast("int")
    rows = rows.select("word", "n", "length", "size", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.md5(F.substring("word", F.lit(1), half)).alias("key")),
        F.struct(F.lit(1).alias("side"), F.md5(F.substring("word", F.col("length") - (F.col("size") - half) + 1, F.col("size") - half)).alias("key")))).alias("k"))
    rows = rows.select("word", "n", "length", "size", "k.side", "k.key")
    a = rows.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns])
    b = rows.where("length = size").select(*[F.col(c).alias(f"b_{c}") for c in rows.columns])
    on = (F.col("a_size") == F.col("b_size")) & (F.col("a_side") == F.col("b_side")) & (F.col("a_key") == F.col("b_key"))
    on = on & ((F.col("a_length") > F.col("b_length")) | ((F.col("a_length") == F.col("b_length")) & (F.col("a_word") > F.col("b_word"))))
    both = a.join(b, on).where((F.col("a_length") > LEVELS) & (F.levenshtein("a_word", "b_word", 1) == 1))
    return both.select(F.col("a_word").alias("word"), F.col("a_n").alias("n"), F.col("b_word").alias("near"), F.col("b_n").alias("near_n")).distinct()


def near_words(found: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every pair of ``found`` (word, n) one edit apart, from both sides."""
    short = _short_pairs(found.where(F.char_length("word") <= LEVELS))
    pairs = short.unionByName(_long_pairs(found))
    return pairs.select(F.explode(F.array(
        F.struct("word", "n", "near", "near_n"),
        F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("p")).select("p.*")


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last of the chain of forms, by pointer jumping."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        at = step.drop("moved")
        if not step.where("moved").limit(1).count():
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts."""
    prepare(docs.sparkSession)
    found = written(words(docs, id_col, text_col), "words")
    best = near_words(found).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("b"))
    fits = -F.col("b.minus") >= FACTOR * F.col("n")
    best = written(best.select("word", "n_near", F.when(fits, F.col("b.near")).alias("form"), F.when(fits, -F.col("b.minus")).alias("form_n")), "forms")
    roots = rooted(best.where("form IS NOT NULL"))
    out = found.join(best.join(roots, "word", "left"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
