"""Signature location over all windows, models by language, and the parse pipelines on mails."""
import pytest

from mailsift.operators import parse as P
from mailsift.operators import score
from mailsift.plans.q_gazetteer import gazetteer_df

BODY = "\n".join(f"This is sentence number {i} of a long mail." for i in range(150))
MAILS = [(1, f"{BODY}\nKind regards\nJane Miller\njane.miller@long.org", "en"), (2, "Hello there\nsome words\nmore\nBob Short\nbob@short.org", "en"),
         (3, "", "en"), (4, None, None)]


@pytest.fixture(scope="module")
def mails(spark):
    return spark.createDataFrame(MAILS, "doc_id long, text string, lang string")


def test_signature_of_a_long_text(mails):
    got = {r.doc_id: r.located for r in P.locate_signatures(mails).collect()}
    first = {r.doc_id: r.located for r in P.locate_signatures(mails, all_windows=False).collect()}
    assert "jane.miller@long.org" in got[1].signature and "jane.miller@long.org" not in first[1].signature
    assert got[1].body + "\n" + got[1].signature == MAILS[0][1]
    assert got[2] == first[2] and got[3].signature == got[4].signature == ""


def test_models_by_language_are_bounded():
    built = []

    def factory(language):
        def make():
            built.append(language)
            return lambda texts: [[{"start": 0, "end": 1, "entity": language}] for _ in texts]
        return make

    task = score.Scorers("test-task", factory("other"), {x: factory(x) for x in "abcdefgh"})
    languages = [*"abcdefgh", "zz", None, *"ab"]
    got = list(task(languages, ["x"] * len(languages)))
    assert [p[0]["entity"] for p in got] == [*"abcdefgh", "other", "other", *"ab"]
    assert len(built) == 9 and len(score._MODELS) <= score.MODELS_KEPT
    list(task(["zz"], ["x"]))
    assert len(built) == 9  # still kept


def test_windows_carry_offsets(mails):
    x = score.score_windows(mails, score.SEGMENTATION, score.TOKENS, score.predicted_tokens, name="p").collect()
    text = {i: t for i, t, _ in MAILS}
    for r in x:
        words = [text[r.doc_id][p.start:p.end] for p in r.p]
        assert words == (text[r.doc_id] or "").split()
    assert max(p.window for r in x if r.doc_id == 1 for p in r.p) > 2


def test_parse_bodies_cleans_the_signature_and_adds_senders(spark):
    html = "<html><body><p>Dear all,<p>\nsome text here</p>\n<p>more of it</p>\nbest\nJane Miller<br>Acme Inc<br>jane&amp;@acme.org <b>jane@acme.org</b>"
    meta = {"senderEmailAddress": {"address": "jane@acme.org", "displayName": ""}, "fromEmailAddresses": [{"address": "jane@acme.org", "displayName": "Jane"}],
            "replyToEmailAddresses": None}
    a = "struct<address:string,displayName:string>"
    df = spark.createDataFrame([(1, html, "en", meta), (2, None, "cn", None), (3, "  ", "de", meta)],
                               f"doc_id long, text string, lang string, meta struct<senderEmailAddress:{a},fromEmailAddresses:array<{a}>,replyToEmailAddresses:array<{a}>>")
    got = {r.doc_id: r for r in P.parse_bodies(df, gazetteer_df(spark), meta_col="meta").collect()}
    one = got[1]
    assert one.parseStatusType == "SUCCESS" and "<" not in one.signatureBlock.block and "&amp;" not in one.signatureBlock.block
    assert [e.address for e in one.signatureFields.emails] == ["jane@acme.org", "jane@acme.org"] and one.signatureFields.names[0].given == "Jane"
    assert [(s.address, s.name, s.sourceTypes) for s in one.senderEmailData] == [
        ("jane@acme.org", "Jane", ["SENDER", "FROM", "SIGNATURE_EMAIL_ADDRESS", "SIGNATURE_EMAIL_ADDRESS"])]
    assert got[2].parseStatusType == got[3].parseStatusType == "NO_SIGNATURE_BLOCK" and got[3].senderEmailData is None


def test_places_of_other_languages_come_from_the_model(spark):
    df = spark.createDataFrame([(1, "Hans Meier\nin Ulm, Berlin\n", "de"), (2, "Hans Meier\nin Ulm, Berlin\n", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: [(e.entity, e.name) for e in r.entities] for r in P.clean_and_extract(df, gazetteer_df(spark)).collect()}
    assert ("ADDRESS_CITY", "Berlin") in got[1] and not any(t == "ADDRESS_CITY" for t, _ in got[2])
