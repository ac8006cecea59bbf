"""Repeated passages, against plain statements of the contracts."""

import random

import brute
import numpy as np
from llm_rows import result
from mailsift.llm import substring_bytes, substring_words

WORDS = ["doc_id", "n_words", "n_removed", "kept_sha256"]
BYTES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_cover_holds_every_difference():
    d = {(a - b) % substring_words.PERIOD for a in substring_words.COVER for b in substring_words.COVER}
    assert d == set(range(substring_words.PERIOD))


def made(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(r.randint(30, 150)) for _ in range(8)]
    rows = []
    for k in range(120):
        parts = []
        for _ in range(r.randint(1, 4)):
            parts.append(text(r.randint(0, 90)))
            if r.random() < 0.6:
                s = r.choice(shared).split(" ")
                a = r.randint(0, 20)
                parts.append(" ".join(s[a:len(s) - r.randint(0, 20)]))
            if r.random() < 0.2:
                parts.append(parts[-1])
        rows.append((k, r.choice([" ", "\n", "  "]).join(parts)))
    for k in range(40):  # copies and near copies
        t = rows[r.randint(0, 20)][1].split(" ")
        if k % 3:
            t[r.randrange(len(t))] = "changed"
        rows.append((200 + k, " ".join(t)))
    rows += [(300, "a" * 2500), (301, "a" * 900 + "b" + "a" * 900), (302, "ab" * 700), (303, "x y " * 500), (304, "z" * 399),
             (305, "q" * 400), (306, "q" * 400), (307, "w" * 401)]
    return rows


def both(spark, df, rows):
    got = result(substring_words.dedup(df), *WORDS)
    assert got == sorted(brute.op5(rows), key=repr)
    got = result(substring_bytes.dedup(df), *BYTES)
    assert got == sorted(brute.op6(rows), key=repr)


def test_made(spark):
    for seed in (1, 2):
        rows = made(seed)
        both(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_odd(spark, odd):
    both(spark, *odd)
    df, rows = odd
    out = substring_words.dedup(df).collect()
    assert all(" ".join(w for i, w in enumerate((r.kept or "").split(" "))) == r.kept for r in out) and len(out) == len(rows)
    assert substring_words.dedup(df.limit(0)).count() == 0 and substring_bytes.dedup(df.limit(0)).count() == 0


def test_given(spark, docs):
    df, rows = docs
    assert sum(r[2] for r in brute.op5(rows)) > 0
    both(spark, df, rows)


def test_sampler_is_local():
    """Equal strings have the sampled position at the same place, in any surroundings and over piece borders."""
    r = np.random.default_rng(4)
    core = r.integers(97, 101, 3000).astype(np.uint8).tobytes()
    a, b = r.bytes(1234) + core + r.bytes(99), r.bytes(77) + core
    s = substring_bytes.Sampler()

    def sampled(raw, low):
        x, p, q, _ = s.nodes(raw)
        at = {i: x[k] - i for k in range(len(x)) for i in range(p[k], q[k] + 1)}
        assert sorted(at) == list(range(len(raw) - 399))
        return [at[low + i] for i in range(len(core) - 399)]

    want = sampled(a, 1234)
    assert want == sampled(b, 77)
    old, substring_bytes._PIECE = substring_bytes._PIECE, 700
    try:
        assert want == sampled(a, 1234)
    finally:
        substring_bytes._PIECE = old
