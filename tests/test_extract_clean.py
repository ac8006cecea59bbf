"""Pattern-extraction and cleaning quirks on hand-made rows."""
import random
import re

from mailsift import settings as S
from mailsift.functions import text as T
from mailsift.operators.extract import LINKEDIN_RUNS, WEB_RUNS, regex_entities, regex_entity_array


def test_url_linkedin_email_rules(spark):
    text = ("Mail me at jo@acme.com or see blog:www.acme.com. "
            "Profile https://www.linkedin.com/in/jo-x> and linkedin.com, www.example.org/a")
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r.entity, r.name, text[r.start:r.end]) for r in regex_entities(df).orderBy("seq").collect()]
    names = [(e, n) for e, n, _ in got]
    assert ("EMAIL", "jo@acme.com") in names
    assert ("URL", "www.acme.com") in names                 # prefix removed, trailing dot stripped
    assert ("LINKEDIN", "https://www.linkedin.com/in/jo-x") in names
    assert not any(n == "linkedin.com" and e == "LINKEDIN" for e, n in names)
    for e, n, sl in got:                                    # offsets slice back to the (trimmed) name
        if e == "EMAIL":
            assert sl == n


def test_cleaning_chain(spark):
    raw = ("<head>\n<title>x</title>\n</head><p>Hi&amp;</p><br>Line<br/>Two<br />x [http://a b] "
           "  y\r\n\r\n\r\nz   ")
    df = spark.createDataFrame([(raw,)], "t string")
    out = df.select(T.clean_mail_text("t").alias("c")).first().c
    assert out == "Hi\n\nLine\nTwo\nx  y\n\nz".replace("x  y", "x y")


def test_language_map(spark):
    df = spark.createDataFrame([("cn",), ("zh_hant",), ("fr",)], "l string")
    assert [r.m for r in df.select(T.map_language("l").alias("m")).collect()] == ["zh-hans", "zh-hant", "fr"]


def test_uk_phone_rewrite_agrees(spark):
    import duckdb

    from mailsift.operators.extract import phone_spans
    from mailsift.plans.q_extract import _UK_SQL
    texts = ["+44 (20) 7946 0958", "020 7946 0958 #12\n", "7946 0958", "call +44 20 7946 0958 now", "44 1234 567890"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {(r.doc_id, r.start, r.end, r.name) for r in
           phone_spans(spark.createDataFrame(rows, "doc_id long, text string"), ["uk"]).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {(r[0], r[3], r[4], r[5]) for r in con.sql(_UK_SQL).fetchall()}
    assert got == want and len(got) == 3


def test_patterns_run_once_for_a_text(spark):
    # e-mail and LinkedIn patterns stood inside the filter of the web matches and ran again for each of them
    df = spark.createDataFrame([(1, "a@x.io www.acme.com linkedin.com/in/a-b"), (2, None)], "doc_id long, text string")
    x = df.select("doc_id", regex_entity_array("text").alias("e"))
    assert x._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 3
    got = {r.doc_id: [(e.entity, e.name) for e in r.e] for r in x.collect()}
    assert got == {1: [("EMAIL", "a@x.io"), ("LINKEDIN", "linkedin.com/in/a-b"), ("URL", "www.acme.com")], 2: []}


def test_run_patterns_match_as_the_fixed_ones():
    rnd = random.Random(7)
    parts = [*"linked:/~-_,&=?;<>x9@w#(+", ".", ".", " ", "\n", "é", "linkedin", "http://", "https://", "http", "com", "www."]
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 30)))
        for fixed, runs in ((S.LINKEDIN_PATTERN, LINKEDIN_RUNS), (S.WEB_PATTERN, WEB_RUNS)):
            assert [m.span() for m in re.finditer(fixed, text)] == [m.span() for m in re.finditer(runs, text)], text
