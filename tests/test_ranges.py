"""The range-partitioned forms give the window forms' rows, whether or not Spark evaluates a shuffle twice."""
import random

import pytest
from pyspark.sql import functions as F

from mailsift.operators.segment import training_segments, training_segments_skewsafe
from mailsift.operators.spans import merge_spans, merge_spans_skewsafe, next_gap, next_gap_skewsafe

EVENTS = "/root/testdata/sf0.01/events.parquet"


@pytest.fixture(params=["true", "false"])
def reuse(spark, request):
    spark.conf.set("spark.sql.exchange.reuse", request.param)
    yield
    spark.conf.unset("spark.sql.exchange.reuse")


def _spans(spark):
    s = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    hot = F.when(F.col("event_id") % 5 < 3, F.lit(None)).otherwise(F.col("user_id"))  # a null key with 60 % of the rows
    return spark.read.parquet(EVENTS).select(hot.alias("k"), "event_id", s.alias("start"), (s + 60).alias("end"))


def test_spans_and_gaps(spark, reuse):
    df, order = _spans(spark), ["start", "event_id"]
    a = merge_spans(df, ["k"], order, gap=3600).select("k", "start", "end", "n")
    b = merge_spans_skewsafe(df, ["k"], order, gap=3600)
    assert sorted(a.collect(), key=repr) == sorted(b.collect(), key=repr)
    a, b = (f(df, ["k"], order).select("event_id", "diff") for f in (next_gap, next_gap_skewsafe))
    assert sorted(a.collect()) == sorted(b.collect())


@pytest.mark.parametrize("order", ["cast(n as string)", "timestamp_micros(n)", "n"])
def test_training_segments(spark, reuse, order):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.6 else f"m{rnd.randint(0, 9)}", n, rnd.choice("ab"),
             " ".join(rnd.choice(["one", "two.", "three", "", "four!"]) for _ in range(rnd.randint(0, 40)))) for n in range(400)]
    rows += [("blank", 1, "a", ""), ("blank", 2, "b", "  "), ("tie", 5, "b", "x y."), ("tie", 5, "a", "z."), ("tie", 5, "a", "w.")]
    df = spark.createDataFrame(rows, "mail string, n long, label string, text string").withColumn("o", F.expr(order))
    a = training_segments(df, ["mail"], "o", "text", "label", limits=[7, 30], remove_columns=["n"])
    b = training_segments_skewsafe(df, ["mail"], "o", "text", "label", limits=[7, 30], remove_columns=["n"], num_partitions=9)
    got = sorted(map(tuple, a.collect()))
    assert got == sorted(map(tuple, b.collect()))
    assert ("blank", 7, 0, [], []) in got
