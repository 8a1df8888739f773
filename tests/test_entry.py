import os
import re

import pytest

import __spark_entry__ as entry
from tests.conftest import rows

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
    assert {f"p{n}_found" for n in range(1, 7)} <= set(queries)
    assert all(re.fullmatch(r"[a-z0-9_]+", n) for n in queries)


def oracle(name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    found = con.execute(entry.oracle_sql()[name])
    return [c[0] for c in found.description], found.fetchall()


@here
@pytest.mark.parametrize("name", ["flagship_revenue", "join_asof", "join_band", "ev_session", "p2_found", "p3_found", "p6_found"])
def test_against_oracle(spark, name):
    df = entry.queries()[name](spark, DATA)
    names, want = oracle(name)
    got = rows(df.select(*names))
    assert got == sorted(want, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


@here
def test_entry(spark):
    assert entry.entry(spark).count() > 0
