"""Language detection on rows that were not used to fit."""
import pytest

from mailsift.operators.score import detect_language, fit_language_profile
from mailsift.operators.split import hash_fraction


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fit = hash_fraction("doc_id") >= 0.5
    got = detect_language(docs.where(~fit), fit_language_profile(docs.where(fit))).join(docs.where("length(text) > 200"), "doc_id").collect()
    assert len(got) > 300 and sum(r.detected_lang == r.lang for r in got) >= 0.95 * len(got)


def test_scripts_nulls_and_nothing(spark):
    rows = [(1, "我们的学校"), (2, "我們的學校"), (3, "中文"), (4, "one 中"), (5, None), (6, ""), (7, "zzz"), (8, "日本 hello world")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    profile = spark.createDataFrame([("de", "hel", 3), ("fr", "hel", 3), ("en", "one", 1)], "lang string, gram string, weight int")
    got = {r.doc_id: r.detected_lang for r in detect_language(df, profile).collect()}
    assert got == {1: "zh-hans", 2: "zh-hant", 3: "zh-hans", 4: "en", 5: "en", 6: "en", 7: "en", 8: "fr"}
    assert fit_language_profile(df.limit(0).selectExpr("text as lang", "text")).count() == 0


@pytest.mark.parametrize("n", [1, 1000])
def test_profile_is_bounded(spark, n):
    df = spark.range(n).selectExpr("'x' as lang", "concat('abcd', case when id % 2 = 0 then 'ef' else '' end) as text")
    assert fit_language_profile(df).count() == 4
