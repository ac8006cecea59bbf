"""Driver contract and a sample of oracle comparisons on sf0.001 (the full set runs in tools/check_oracle.py)."""
import pytest

import __spark_entry__ as entry
from oracle_rows import SF001, rows

QUICK = ["ext_email_spans", "ext_phone_us_ca", "cln_mail_text", "fn_scalar_functions", "eval_performance_long",
         "eval_full_leaderboard", "dq_validate", "spn_merge_events", "spn_merge_events_skewsafe", "spl_documents_by_source",
         "seg_training_segments", "seg_token_chunks", "rsp_sender_metadata", "str_error_capture"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"lang", "entity", "n_entities", "n_docs"}
    assert df.count() >= 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF001)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())
