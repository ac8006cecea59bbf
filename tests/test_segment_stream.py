"""Packing folds against small Python statements; streaming counters equal the batch result."""
import datetime
import random

from pyspark.sql import functions as F

from mailsift.operators.segment import pack_greedy, pack_overlapping
from mailsift.streaming.jobs import read_parsed, start_parse_stream, start_windowed_counts


def greedy_spec(ns, limit):
    segs, cn, cs, ce, pos = [], 0, 0, 0, 0
    for n in ns:
        s, e = pos, pos + n
        pos = e + 1
        if cn + n > limit:
            segs.append((cn, cs, ce))
            cn, cs, ce = n, s, e
        else:
            cn, ce = cn + n, e
    segs.append((cn, cs, ce))
    return segs


def overlap_spec(ns, limit):
    ol, out, cur, a, b = int(limit * 1.5), [], 0, 0, -1
    for i, n in enumerate(ns):
        if cur + n > limit:
            if i > 0:
                out.append((a, b))
                if ns[i - 1] + n > ol:
                    cur, a, b = n, i, i
                    continue
            a, b, cur = max(i - 1, 0), i, (ns[i - 1] if i > 0 else 0) + n
            continue
        cur, b = cur + n, i
    out.append((a, b))
    return out


def test_packers(spark):
    rnd = random.Random(5)
    cases = [[rnd.randint(1, 9) for _ in range(rnd.randint(0, 30))] for _ in range(60)]
    rows = []
    for i, ns in enumerate(cases):
        pos, units = 0, []
        for n in ns:
            units.append((n, pos, pos + n))
            pos += n + 1
        rows.append((i, units, ns))
    df = spark.createDataFrame(rows, "i int, u array<struct<n:int,start:int,end:int>>, ns array<int>")
    got = df.select("i", pack_greedy(F.col("u"), 10).alias("g"), pack_overlapping(F.col("ns"), 10).alias("o")).collect()
    for r in got:
        ns = cases[r.i]
        assert [tuple(x) for x in r.g] == (greedy_spec(ns, 10) if ns else [(0, 0, 0)])
        assert [tuple(x) for x in r.o] == overlap_spec(ns, 10)


def test_windows_close_and_late_rows_are_left_out(spark, tmp_path):
    def at(*minutes):
        return [(datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m), "a") for m in minutes]
    schema = "ts timestamp_ntz, event_type string"
    # hours 0 and 1; hour 5 moves the watermark (2 hours) to 3:30, so the row at 0:40 is late and the one at 4:10 is not
    for no, minutes in enumerate([(5, 20, 65, 70), (330,), (40, 250), (900,)]):
        spark.createDataFrame(at(*minutes), schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{no}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        start_windowed_counts(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [(f"2024-01-01 {h:02}:00:00", "a", n) for h, n in ((0, 2), (1, 2), (4, 1), (5, 1))]


def test_parse_stream_equals_batch_after_restart(spark, tmp_path):
    from mailsift.operators.parse import parse_bodies
    from mailsift.plans.q_gazetteer import gazetteer_df
    mails = [(i, f"hello {i}\nsome text\nmore\nlast line\nJane Miller\nAcme Inc\njane{i}@acme.org" if i % 3 else "", "en") for i in range(9)]
    schema, gaz = "doc_id long, text string, lang string", gazetteer_df(spark)
    df = spark.createDataFrame(mails, schema)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        start_parse_stream(stream, gaz, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()

    for no in range(3):
        df.where(f"doc_id div 3 = {no}").coalesce(1).write.parquet(str(tmp_path / "in" / f"f{no}"))
        if no:
            run()
    # a failure after the output was written and before the batch was noted as done: the batch is run again
    commits = sorted((tmp_path / "ck" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        p.unlink(missing_ok=True)
    run()
    same = lambda x: sorted(map(repr, x.collect()))
    assert len(commits) == 3 and same(read_parsed(spark, str(tmp_path / "out"))) == same(parse_bodies(df, gaz))


def test_a_batch_of_one_file_is_spread(spark, tmp_path, monkeypatch):
    # every micro-batch was parsed by the one task that read its file
    from mailsift.plans.q_gazetteer import gazetteer_df
    from mailsift.streaming import jobs
    seen, parse = [], jobs.parse_bodies
    monkeypatch.setattr(jobs, "parse_bodies", lambda mails, *a, **k: (seen.append(mails.rdd.getNumPartitions()), parse(mails, *a, **k))[1])
    schema = "doc_id long, text string, lang string"
    spark.createDataFrame([(i, f"some text\nmore\nlast\nJane Miller\njane{i}@acme.org", "en") for i in range(5)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    start_parse_stream(stream, gazetteer_df(spark), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert seen == [2 * spark.sparkContext.defaultParallelism]
    assert read_parsed(spark, str(tmp_path / "out")).count() == 5


def test_skewsafe_training_packer_hot_mail(spark):
    from mailsift.operators.packing import with_previous
    from mailsift.operators.segment import training_segments, training_segments_skewsafe
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    # one mail holding every block: the in-row packer puts it in one task, the skew-safe one spreads it
    hot = conv.select(F.lit(1).cast("long").alias("conv_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("turn"),
                      "role", "text")
    a = training_segments(hot, ["conv_id"], "turn", "text", "role", limits=[25, 100])
    b = training_segments_skewsafe(hot, ["conv_id"], "turn", "text", "role", limits=[25, 100], num_partitions=12)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    df = spark.range(2000).select((F.col("id") % 3).alias("k"), "id", (F.col("id") % 5).alias("v"))
    p = with_previous(df.repartitionByRange(7, "k", "id").sortWithinPartitions("k", "id"), ["k"], "id", ["v"])
    assert p.where("prev_v IS NULL").count() == 3


def test_segments_of_a_long_text_take_linear_time(spark):
    # F8: one text of many windows; every window was a fold's copy of those before it and a search from the text's start
    import time

    from mailsift.operators.segment import inference_segments
    text = "Some words, here. " * 40_000
    df = spark.createDataFrame([(0, None), (1, ""), (2, text + "\u00e9t\u00e9 " * 30)], "doc_id long, text string")
    begun = time.monotonic()
    got = sorted(tuple(r) for r in inference_segments(df, limit=12).collect())
    assert time.monotonic() - begun < 30  # 8 s with one pass, 67 s before
    assert got[:2] == [(0, 0, 0, 0, 0, None), (1, 0, 0, 0, 0, "")]
    assert got[2][1:] == (0, 10, 0, 35, "Some words, here. Some words, here.")
    assert [r[2] for r in got[2:]] == [10] * 19_999 + [10, 12, 12, 6]
    assert all(r[5] == (text + "\u00e9t\u00e9 " * 30)[r[3]:r[4]] for r in got[2:])


def test_skewsafe_packer_moves_one_string_for_a_sentence(spark, monkeypatch):
    # arrays of every token and of as many labels were shuffled and written
    from mailsift.operators import packing
    from mailsift.operators.segment import training_segments, training_segments_skewsafe
    sizes, pack = [], packing.pack_overlapping_skewsafe

    def seen(rows, *args):
        sizes.append(tuple(rows.agg(F.max(F.size("tokens")), F.max(F.size("labels"))).first()))
        return pack(rows, *args)

    monkeypatch.setattr(packing, "pack_overlapping_skewsafe", seen)
    blocks = spark.createDataFrame([(1, "en", i, "user" if i % 2 else "a:b 1", "Hi there. One two, three four! x" * (i % 4)) for i in range(6)]
                                   + [(2, "en", 0, "user", "")], "conv_id long, lang string, turn int, role string, text string")
    rows = lambda f: sorted(map(repr, f(blocks, ["conv_id", "lang"], "turn", "text", "role", limits=[3, 7]).collect()))
    assert rows(training_segments_skewsafe) == rows(training_segments)
    assert sizes == [(1, 1)]
