import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and blank texts, ties, repeated rows and a very long text."""
    r = random.Random(5)
    vocabulary = ["word%d" % i for i in range(300)] + ["Ünï", "漢字", "a,b", "x\x00y"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base, long = text(120), text(20000)
    shared = text(60)
    rows = [(1, base), (2, base), (2, base), (3, base.replace("word1 ", "other ", 1) + " end"), (None, base), (None, None),
            (4, None), (5, ""), (6, " \t\n"), (7, long), (8, text(80) + " " + shared + "\n" + text(30)),
            (9, text(10) + "\n" + shared + " " + text(70)), (10, shared), (11, "one two"), (12, "one two"), (13, "ONE two"),
            (14, "a" * 5000), (15, "ab " * 900), (16, text(40) + " " + base[:420]), (16, text(55))]
    return spark.createDataFrame([(d, t, "x", k, "clash") for k, (d, t) in enumerate(rows)],
                                 "doc_id long, text string, n_words string, hits long, Quality string").repartition(3), rows


@pytest.fixture(scope="session")
def docs(spark):
    from llm_rows import SF01
    df = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    return df, [tuple(x) for x in df.collect()]
