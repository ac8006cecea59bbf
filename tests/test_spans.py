"""Skew-safe span merging equals the window form, also when one key holds most rows."""
import random

from pyspark.sql import functions as F

from mailsift.operators.spans import merge_spans, merge_spans_skewsafe


def _data(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows, t = [], {}
    for i in range(n):
        k = 0 if rnd.random() < 0.6 else rnd.randint(1, 5)     # key 0 is hot
        t[k] = t.get(k, 0) + rnd.choice([0, 1, 2, 3, 4, 5, 9])
        rows.append((k, i, t[k], t[k] + rnd.randint(0, 3)))
    return spark.createDataFrame(rows, "k int, id int, start long, end long")


def test_skewsafe_equals_window(spark):
    df = _data(spark)
    for gap, inc in [(4, False), (2, True), (0, False)]:
        a = merge_spans(df, ["k"], ["start", "id"], gap=gap, inclusive=inc).select("k", "start", "end", "n")
        for parts in (3, 16):
            b = merge_spans_skewsafe(df, ["k"], ["start", "id"], gap=gap, inclusive=inc, num_partitions=parts)
            assert sorted(a.collect()) == sorted(b.collect()), (gap, inc, parts)


def test_hot_key_spread_over_partitions(spark):
    df = _data(spark)
    ranged = df.repartitionByRange(16, "k", "start", "id")
    per_part = ranged.where(F.col("k") == 0).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(per_part) > 4  # the hot key is not confined to one task


def test_next_gap_skewsafe_equals_window(spark):
    from mailsift.operators.spans import next_gap, next_gap_skewsafe
    df = _data(spark)
    for fill in (False, True):
        a = next_gap(df, ["k"], ["start", "id"], fill_with_end=fill).select("id", "diff")
        for parts in (2, 16):
            b = next_gap_skewsafe(df, ["k"], ["start", "id"], fill_with_end=fill, num_partitions=parts).select("id", "diff")
            assert sorted(a.collect()) == sorted(b.collect()), (fill, parts)


def test_find_signature_text_column(spark):
    from mailsift.operators.spans import find_signature
    preds = spark.createDataFrame([(1, 0, 6, 10, "SIGNATURE")], "doc_id long, token_no int, start int, end int, entity string")
    texts = spark.createDataFrame([(1, "hello name")], "doc_id long, mail string")
    row = find_signature(preds, texts, ["doc_id"], text_col="mail").first()
    assert (row.body, row.signature, row.tag) == ("hello ", "name", "perfect_match")


def test_post_filter_counts_digits_of_any_script(spark):
    from mailsift.operators.fuse import post_filter
    phone = "".join(chr(0xFF10 + int(c)) for c in "5551234567")
    ents = spark.createDataFrame([(1, 0, 10, "PHONE", phone)], "doc_id long, start int, end int, entity string, name string")
    texts = spark.createDataFrame([(1, phone, "en")], "doc_id long, text string, lang string")
    assert post_filter(ents, texts).count() == 1


def test_match_spans_over_block_borders(spark):
    from mailsift import settings as S
    from mailsift.functions.spans import BLOCK, match_spans
    texts = ["", " ", *(" ".join(f"é{i}" for i in range(n)) for n in (1, BLOCK - 1, BLOCK, BLOCK + 1, 2 * BLOCK + 1, 5000))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in df.select("text", match_spans("text", S.WORD_PATTERN).alias("a")).collect():
        assert [x.name for x in row.a] == row.text.split()
        assert all(row.text[x.start: x.end] == x.name for x in row.a)


def test_url_span_starts_after_a_removed_prefix(spark):
    from mailsift.operators.extract import regex_entities
    text = "see w:www.acme.io. and www.b.com"
    got = regex_entities(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sorted(e.name for e in got) == ["www.acme.io", "www.b.com"]
    assert all(text[e.start: e.end] == e.name for e in got)
