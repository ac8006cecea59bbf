"""Source mixing, vector codes and spelling variants against plain statements."""

import random

import brute
import numpy as np
import pytest
from llm_rows import SF01, result
from mailsift.llm import mixing, spelling, vector_codes
from pyspark.sql import functions as F


def checked_mix(df, tolerance):
    out = mixing.mix(df, keep_text=False)
    rows = out.collect()
    sizes, taken, target, largest = {}, {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
    want = brute.op11_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= max(largest[s] / 2, tolerance * target[s])
    assert {r.source_size for r in rows} == set(sizes.values())
    again = mixing.mix(df.repartition(5), keep_text=False).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    return rows


def test_mix_given(spark):
    df = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = checked_mix(df, 0)
    assert len(rows) == df.count() and {r.copies for r in rows} == {0, 1, 2}


def test_mix_odd(spark):
    r = random.Random(2)
    text = lambda n: " ".join(["w"] * n)
    data = [(k, text(r.randint(0, 60)), "abc"[k % 3]) for k in range(90)] + [(None, text(30), None)] * 40 + [(1, None, "a"), (2, "", "z"), (3, " \t", "z")]
    data += [(9, text(20000), "é"), (10, text(3), "é")] + [(k, text(1), "B") for k in range(40)]
    df = spark.createDataFrame([(*x, "k", 1) for x in data], "doc_id long, text string, source string, SIZE string, taken int")
    out = mixing.mix(df)
    assert out.columns == ["doc_id", "text", "source", "SIZE", "taken", "_size", "source_size", "target", "copies", "_taken"]
    assert out.count() == len(data) and out.where("source = 'z' and target = 0 and copies = 0").count() == 2
    checked_mix(df.drop("SIZE", "taken"), 0)
    assert mixing.mix(df.limit(0)).count() == 0
    salted = mixing._joined(df, df.groupBy("source").agg(F.count("*").alias("n")), 6, "source", F.col("doc_id"), limit=0)
    assert salted.count() == len(data) and salted.where("source is null and n = 40").count() == 40


def test_pareto_inclusion(spark):
    """Over many seeds a document's mean copies are what its weight asks for, and heavier ones come more often."""
    docs = spark.createDataFrame([(k, "a b c d e", "s", float(1 + k % 4)) for k in range(80)], "doc_id long, text string, source string, q double")
    total = dict.fromkeys(range(80), 0)
    runs = 12
    for seed in range(runs):
        for row in mixing.mix(docs, weight_col="q", seed=seed).collect():
            total[row.doc_id] += row.copies
    mean = [sum(total[k] for k in range(80) if k % 4 == j) / (20 * runs) for j in range(4)]
    # target 1.5 x words; weights 1..4 with at most 2 copies: levels 0.75, 1.5 (x 2), then capped at 2
    c = 2 / 3
    want = [c, 2 * c, 2, 2]
    assert mean == pytest.approx(want, abs=0.12)


def test_limbs_are_exact():
    r = np.random.default_rng(4)
    for top in (3, 1 << 20, (1 << 27)):
        x, c = r.integers(-top, top + 1, (50, 8)), r.integers(-top, top + 1, (9, 8))
        x[0], c[0] = top, -top
        assert (vector_codes.dots(x, c) == x.astype(object) @ c.T.astype(object)).all()
        k, d = vector_codes.nearest(x, c)
        full = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v)) for v in c] for u in x]
        assert [min(range(9), key=lambda j: (f[j], j)) for f in full] == list(k) and [min(f) for f in full] == list(d)


def test_codes_given(spark):
    df = spark.read.parquet(f"{SF01}/embeddings.parquet")
    got = vector_codes.digest(df)
    assert result(got, *got.columns) == sorted(brute.op12([tuple(r) for r in df.collect()]), key=repr)


def test_codes_odd(spark):
    r = random.Random(1)
    rows = [(k, [r.uniform(-3, 3) if k % 7 else float(k % 3) for _ in range(32)], k % 3 if k % 5 else None) for k in range(150)]
    rows += [(500 + k, rows[3][1], 1) for k in range(40)] + [(None, rows[5][1], 7)]
    bad = [(600, None, 1), (601, [None] * 32, 1), (602, [float("nan")] * 32, 1), (603, [float("inf")] * 32, None), (604, [1.0] * 31, 2), (605, [], 2)]
    df = spark.createDataFrame([(*x, "c") for x in [*rows, *bad]], "vec_id long, embedding array<float>, label int, code string").repartition(4)
    plain = [(i, list(map(float, np.float32(v))), lab) for i, v, lab in rows]
    want = brute.op12([(10**9 if i is None else i, v, lab) for i, v, lab in plain])
    got = vector_codes.digest(df)
    assert result(got, *got.columns) == sorted(((None if i == 10**9 else i, *x) for i, *x in want), key=repr)
    assert vector_codes.digest(df.limit(0)).count() == 0
    short = spark.createDataFrame([(k, [1.0] * 16 if k == 3 else [float(k)] * 32, 0, "c") for k in range(70)], df.schema)
    same = [(k, [float(k)] * 32, 0) for k in range(70) if k != 3]
    got = vector_codes.digest(short)  # a vector of another length takes no place in the first codebook
    assert result(got, *got.columns) == sorted(brute.op12(same), key=repr)
    few = vector_codes.digest(df.where("vec_id < 5"))
    assert result(few, *few.columns) == sorted(brute.op12([x for x in plain if x[0] is not None and x[0] < 5]), key=repr)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants_given(spark, docs):
    df, rows = docs
    want = sorted(brute.op13(rows), key=repr)
    assert sum(w[1] is not None for w in want) > 1000
    assert result(spelling.variants(df), *COLUMNS) == want


def test_variants_odd(spark, odd):
    r = random.Random(9)
    long = "".join(r.choice("abcé") for _ in range(300))
    some = ["abcde"] * 9 + ["abcdf"] * 4 + ["abcd", "abde", "aabcde"] * 5 + ["aaaaa"] * 3 + ["aaaaaa"] * 7 + ["ÀÈÌÒÙ"] * 3 + ["ÀÈÌÒÿ"] * 8
    some += ["tabcde"] * 20 + ["tabcdes"] * 41 + [long] * 3 + [long[:150] + "x" + long[150:]] * 6 + [long[:40] + long[41:]] * 4 + [long[:299] + "q"] * 3
    some += ["x" * 48] * 3 + ["x" * 49] * 6 + ["x" * 47] * 3 + ["x" * 50] * 12 + ["".join(r.choice("ab") for _ in range(6)) for _ in range(900)]
    rows = [(k, f"{w}. " * (1 + k % 2)) for k, w in enumerate(some)] + [(None, "abcde 漢abcde"), (None, None), (5, "")] + [(7, "abcdx ABCDX")] * 3
    df = spark.createDataFrame([(*x, "n", 1) for x in rows], "doc_id long, text string, word string, N int")
    assert result(spelling.variants(df), *COLUMNS) == sorted(brute.op13(rows), key=repr)
    spelling.CROWDED, before = 2, spelling.CROWDED  # every node in copies
    try:
        assert result(spelling.variants(df), *COLUMNS) == sorted(brute.op13(rows), key=repr)
    finally:
        spelling.CROWDED = before
    for frame, data in (odd, (df.limit(0), [])):
        assert result(spelling.variants(frame), *COLUMNS) == sorted(brute.op13(data), key=repr)
