import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]


@pytest.fixture(scope="session")
def spark():
    from mailsift.session import local_session
    s = local_session("*", 8, app="mailsift-tests")
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    from oracle_rows import SF001
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ["events", "documents", "pages", "benchmark", "labels", "conversations", "orders"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con
