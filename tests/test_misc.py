"""Small operators: length sort, evaluate composition, FLT-6, reconstruction and tokenizer hooks, readers."""
from pyspark.sql import functions as F

from mailsift.operators import evaluate as E
from mailsift.operators.quality import drop_then_dropna
from mailsift.operators.segment import tokenizer_hook
from mailsift.sources.readers import read_text_articles
from mailsift.sources.writers import read_prompt_library, reconstruct


def test_sort_by_length(spark):
    df = spark.createDataFrame([(["a", "ccc", "bb", "dd"],)], "v array<string>")
    assert df.select(E.sort_by_length_desc(F.col("v")).alias("s")).first().s == ["ccc", "bb", "dd", "a"]


def test_evaluate_results_composition(spark):
    gold = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "email_id string, EMAIL string")
    pred = spark.createDataFrame([("1", "a"), ("2", "x")], "email_id string, EMAIL string")
    full, weighted, perf = E.evaluate_results(gold, pred, "email_id", "m", "d", "1", "http://h/models/ner/predict",
                                              last_update=F.lit("01/01/2024"))
    assert full.first().MODEL == "m-ner" and full.first().EMAIL == "50.0/50.0/50.0"
    assert weighted.first().ENTITIES_NUMBER == "1/25"


def test_drop_then_dropna(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "y", "z")], "a int, b string, c string")
    assert drop_then_dropna(df, ["c"]).count() == 2
    assert drop_then_dropna(df, ["c", "missing"]).count() == 1


def test_reconstruct_and_tokenizer(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, t string")
    out = reconstruct(df, lambda r: [(r["id"], w) for w in r["t"].split()], "id long, w string")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a"), (1, "b"), (2, "c")]
    tok = tokenizer_hook(lambda texts: [t.upper().split() for t in texts])
    assert df.select(tok(F.col("t")).alias("x")).orderBy("x").first().x == ["A", "B"]


def test_options(spark):
    from mailsift.functions.text import clean_mail_text
    from mailsift.operators.extract import regex_entities
    from mailsift.operators.response import responses
    html = "<p>a</p><script>var x = 1;\n</script>b<STYLE>p{}</style> c"
    row = spark.createDataFrame([(html,)], "h string").select(clean_mail_text("h").alias("a"), clean_mail_text("h", strip_script=True).alias("b")).first()
    assert row.a == "a\nvar x = 1;\nbp{} c" and row.b == "a\nb c"
    text = spark.createDataFrame([(1, "mailto:a.example.org and b.example.org")], "doc_id int, text string")
    assert [r.name for r in regex_entities(text).collect()] == ["b.example.org"]
    ents = spark.createDataFrame([("x", [("LINKEDIN", "www.linkedin.com/in/x"), ("URL", "x.org")])], "block string, entities array<struct<entity:string,name:string>>")
    sites = lambda **o: [(w.url, w.tag) for w in responses(ents, "block", **o).first().signatureFields.webSites]
    assert sites() == [("x.org", None)] and sites(linkedin=True) == [("x.org", None), ("www.linkedin.com/in/x", "LINKEDIN")]


def test_hooks_of_the_training_segmenter(spark):
    from mailsift.operators.segment import hooked_tokens, training_segments
    df = spark.createDataFrame([(1, 0, "a", "One two; three."), (1, 1, "b", "x"), (2, 0, "a", None)], "id int, n int, label string, text string")
    plain = training_segments(df, ["id"], "n", "text", "label", limits=[9])
    same = training_segments(df, ["id"], "n", "text", "label", limits=[9], sentences=hooked_tokens())
    assert sorted(plain.collect()) == sorted(same.collect())
    hooks = hooked_tokens(lambda ts: [t.split(";") for t in ts], lambda ss: [list(s.strip().upper().split()) for s in ss])
    got = training_segments(df, ["id"], "n", "text", "label", limits=[3], sentences=hooks).collect()
    assert [(r.tokens, r.labels) for r in got] == [(["ONE", "TWO", "THREE."], ["a"] * 3), (["THREE.", "X"], ["a", "b"])]


def test_file_readers(spark, tmp_path):
    (tmp_path / "12_Great news.txt").write_text("Headline\n\nBy Jo Doe (May 1) -- Body text here ")
    (tmp_path / "plain.txt").write_text("no separators at all")
    arts = {r.file_title: r for r in read_text_articles(spark, str(tmp_path / "*.txt")).collect()}
    a = arts["Great news"]
    assert (a.title, a.author, a.published_date, a.text) == ("Headline", "Jo Doe", "May 1", "Body text here")
    assert arts["plain"].author is None and arts["plain"].text == ""
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "email_prompt.json").write_text('{"TASK": "t", "FIELDS": ["email"]}')
    lib = read_prompt_library(spark, str(tmp_path / "p")).first()
    assert lib.name == "email" and lib.prompt.TASK == "t"


def test_strip_empty_and_sender_rules(spark):
    from mailsift.operators.quality import strip_empty
    from mailsift.operators.response import ADDR, sender_data
    df = spark.createDataFrame([("", ("", None)), ("x", ("y", ""))], "a string, m struct<p:string,q:string>")
    s = df.select(F.struct("a", "m").alias("r"))
    out = s.select(F.to_json(strip_empty(F.col("r"), s.schema["r"].dataType)).alias("j")).collect()
    assert [r.j for r in out] == [None, '{"a":"x","m":{"p":"y"}}']
    meta = F.struct(F.struct(F.lit("a@x.org").alias("address"), F.lit(None).cast("string").alias("displayName"))
                    .alias("senderEmailAddress"),
                    F.array(F.struct(F.lit("a@x.org").alias("address"), F.lit("Ann").alias("displayName")))
                    .alias("fromEmailAddresses"),
                    F.array(F.struct(F.lit("r@x.org").alias("address"), F.lit("R").alias("displayName")))
                    .alias("replyToEmailAddresses"))
    ents = F.array(F.struct(F.lit(0).alias("seq"), F.lit("EMAIL").alias("entity"), F.lit("a@x.org").alias("name")))
    got = spark.range(1).select(sender_data(meta, ents).alias("s")).first().s
    assert [(g.address, g.name, list(g.sourceTypes)) for g in got] == [
        ("a@x.org", "Ann", ["SENDER", "FROM", "SIGNATURE_EMAIL_ADDRESS"])]
