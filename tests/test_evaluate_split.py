"""Evaluation on a hand-made wide fixture; split invariants."""
from pyspark.sql import functions as F

from mailsift.operators import evaluate as E
from mailsift.operators.quality import normalise_gold, validate_gold
from mailsift.operators.split import assign_split, overlapping_groups


def test_evaluate_wide_fixture(spark):
    gold = spark.createDataFrame([
        ("1", "a ; b ; b", "x"), ("2", "", None), ("3", "c", "y ; z"), ("9", "q", "q")],
        "email_id string, EMAIL string, URL string")
    pred = spark.createDataFrame([
        ("1", "a ; c", None), ("2", "d", "w"), ("3", " c ", "z")], "email_id string, EMAIL string, NAME_GIVEN string")
    perf = {r.Entity: (r.TP, r.FP, r.FN) for r in E.evaluate_wide(gold, pred, "email_id").collect()}
    # URL/NAME_GIVEN are on one side only -> not evaluated; id 9 has no prediction -> ignored
    assert perf == {"EMAIL": (2, 2, 1)}


def test_leaderboard_rounding(spark):
    perf = spark.createDataFrame([("EMAIL", 1, 7, 0)], "Entity string, TP long, FP long, FN long")
    row = E.format_leaderboard(E.with_ratios(perf)).first()
    assert row.LEADER_BOARD_VALUE == "12.5/100.0/22.22"


def test_quality_rules(spark):
    df = spark.createDataFrame([("nan",), ("[a, b]",), ("  ",), ("a , b",), ("ok",)], "EMAIL string")
    assert [r.EMAIL for r in normalise_gold(df).collect()] == ["", "a ;  b", "", "a , b", "ok"]
    v = {(r.rule): r.n for r in validate_gold(df).collect()}
    assert v == {"sentinel": 1, "brackets": 1, "whitespace_only": 1, "bad_separator": 1}


def test_split_disjoint_and_stable(spark):
    df = spark.range(2000).select((F.col("id") % 97).alias("g"), "id")
    a = assign_split(df, "g")
    assert overlapping_groups(a, "g").count() == 0
    b = assign_split(df.repartition(13), "g")
    assert sorted(a.collect()) == sorted(b.collect())
    sizes = {r.split: r["count"] for r in a.groupBy("split").count().collect()}
    assert set(sizes) == {"train", "validation", "test"}
