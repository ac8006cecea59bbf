"""The SQL of the contracts against their plain statements."""

import brute
import pytest
from llm_rows import SF001
from mailsift.llm import oracles


@pytest.mark.parametrize("name,plain", [("op1_decontaminate", None), ("op5_substring_dedup", brute.op5), ("op8_minhash_forest", brute.op8)])
def test_sql(duck, name, plain):
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    want = plain(rows) if plain else brute.op1(rows, items)
    assert sorted(duck.execute(oracles.ORACLES[name]).fetchall()) == sorted(want)


def test_sql_of_codes(duck):
    rows = duck.execute(f"SELECT vec_id, embedding, label FROM read_parquet('{SF001}/embeddings.parquet')").fetchall()
    duck.execute(f"CREATE OR REPLACE TEMP VIEW embeddings AS SELECT * FROM read_parquet('{SF001}/embeddings.parquet')")
    assert sorted(duck.execute(oracles.ORACLES["op12_vector_codes"]).fetchall()) == sorted(brute.op12(rows))


def test_sql_of_variants(duck):
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    assert sorted(duck.execute(oracles.ORACLES["op13_spelling_variants"]).fetchall()) == sorted(brute.op13(rows))


def test_sql_of_targets(duck):
    got = duck.execute(f"SELECT source, min(target), max(source_size), sum(taken) FROM ({oracles.ORACLES['op11_mix_sources']}) JOIN documents USING (doc_id) GROUP BY 1").fetchall()
    want = brute.op11_targets({s: n for s, _, n, _ in got})
    assert all(t == pytest.approx(want[s]) and 0.5 * t <= k <= 1.5 * t for s, t, n, k in got)
