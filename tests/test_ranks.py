"""Numbers over ranges, exact splits, quotas of file splits, the containment index, joined cells."""
import random

import pytest
from pyspark.sql import functions as F

from mailsift.operators import evaluate as E
from mailsift.operators.ranks import numbered, running_sums
from mailsift.operators.split import two_way_split_exact
from mailsift.sources.readers import read_dataframe


def test_running_sums_with_a_hot_key(spark):
    r = random.Random(1)
    data = [(r.choice(["hot"] * 8 + ["a", "b", None]), r.randint(0, 50), i, r.randint(-5, 9)) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, o int, slice_no int, v long")
    got = running_sums(df, ["k"], [F.col("o"), F.col("slice_no")], {"total": F.col("v"), "n": F.lit(1)}, slices=7).collect()
    want, seen = {}, {}
    for k, o, i, v in sorted(data, key=lambda x: (str(x[0]), x[1], x[2])):
        t, n = seen.get(k, (0, 0))
        seen[k] = want[i] = (t + v, n + 1)
    assert {x.slice_no: (x.total, x.n) for x in got} == want
    assert sorted(x.no for x in numbered(df, [F.col("o"), F.col("slice_no")], "no").collect()) == list(range(1, 3001))
    assert running_sums(df.limit(0), ["k"], [F.col("o")], {"t": F.col("v")}).count() == 0


@pytest.mark.parametrize("ratio", [0, 0.001, 0.25, 0.5, 1.0])
def test_exact_split(spark, ratio):
    df = spark.range(1000).select(F.when(F.col("id") % 41 > 0, F.col("id") % 41).alias("g"), "id")
    train, test = two_way_split_exact(df, "g", ratio)
    groups = {x.g for x in test.select("g").distinct().collect()}
    assert len(groups) == -(-round(ratio * 41 * 1000) // 1000) and train.count() + test.count() == 1000
    assert not groups & {x.g for x in train.select("g").distinct().collect()}


def test_cap_over_several_splits_of_a_file(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 30), ("c", 0), ("d", 1200)):
        (tmp_path / f"{name}.csv").write_text("no,file\n" + "".join(f"{i},{name}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = read_dataframe(spark, f"{tmp_path}/*.csv", max_records_per_file=1000).collect()
        assert spark.read.csv(f"{tmp_path}/a.csv").rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    by = {}
    for x in got:
        by.setdefault(x.file, []).append(int(x.no))
    assert {k: sorted(v) for k, v in by.items()} == {"a": list(range(1000)), "b": list(range(30)), "d": list(range(1000))}


def sieve(values):
    out = []
    for s in sorted(values, key=len, reverse=True):
        if not any(s in o for o in out):
            out.append(s)
    return set(out)


def test_sieve_matches_its_statement(spark):
    r = random.Random(5)
    groups = {k: {"".join(r.choice("ab1") for _ in range(r.randint(0, 9))) for _ in range(60)} for k in range(6)}
    groups[7] = {"x" * n for n in (1, 2, 31, 32, 33, 64, 65, 100)} | {"y" + "x" * 63, "é漢" * 20, "漢é漢"}
    groups[8] = {""}
    rows = [(k, v) for k, vs in groups.items() for v in vs] * 2 + [(None, "a"), (None, "ab"), (1, None)]
    got = E.substring_sieve(spark.createDataFrame(rows, "k long, name string"), ["k"]).collect()
    assert sorted((x.k, x.name) for x in got if x.k is not None and x.name is not None) == sorted((k, v) for k, vs in groups.items() for v in sieve(vs))
    assert {(x.k, x.name) for x in got if x.k is None or x.name is None} == {(None, "a"), (None, "ab"), (1, None)} and len(got) == len({(x.k, x.name) for x in got})


def test_sieve_of_one_large_group(spark):
    df = spark.range(150_000).select(F.lit(1).alias("k"), (F.col("id") * 7).cast("string").alias("name"))
    kept = E.substring_sieve(df, ["k"])
    names = [str(i * 7) for i in range(150_000)]
    inside = {n[a:b] for n in names for a in range(len(n)) for b in range(a + 1, len(n) + 1) if b - a < len(n)}
    assert kept.count() == sum(n not in inside for n in names)


def test_joined_cells_of_a_hot_tag(spark):
    n = 150_000
    df = spark.range(n).select(F.lit(1).alias("id"), F.lit("URL").alias("entity"), (n - F.col("id")).alias("o"), F.col("id").cast("string").alias("name"))
    more = spark.createDataFrame([(2, "URL", 1, " a "), (2, "EMAIL", 1, " b "), (2, "EMAIL", 0, "c"), (2, "UNKNOWN", 0, "d"), (3, "URL", 0, None)],
                                 "id int, entity string, o long, name string")
    got = {(x.id, x.tag): x.entities for x in E.concat_entities(df.unionByName(more), "id", "o").collect()}
    assert got == {(1, "URL"): " ; ".join(str(i) for i in reversed(range(n))), (2, "URL"): "a", (2, "EMAIL"): "c ;  b "}


def test_regrouped_names(spark):
    rows = [(1, 0, "UNKNOWN", "ann", 0, 3), (1, 1, "NAME", "ann", 9, 12), (1, 2, "NAME", "ann lee", 5, 12), (1, 3, "UNKNOWN", "x", 1, 2),
            (1, 4, "UNKNOWN", "y", 1, 2), (1, 5, "UNKNOWN", "y", 3, 4), (1, 6, "ORG", "lee", 2, 5), (2, 0, "NAME", None, 0, 1)]
    got = E.regroup_names(spark.createDataFrame(rows, "id int, seq int, entity string, name string, start long, end long"), ["id"], "seq").collect()
    assert sorted(map(tuple, got)) == [(1, "NAME", "ann lee", 5, 12), (1, "ORG", "lee", 2, 5), (1, "UNKNOWN", "x", 1, 2)]
