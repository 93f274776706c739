from pathlib import Path

import duckdb
import pytest

from nearfield.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, corpus, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{Path(corpus) / 'documents.parquet'}'")
    df = QUERIES[name](spark, corpus)
    names = ", ".join(sorted(df.columns))
    assert sorted(con.sql(ORACLES[name]).columns) == sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))
    assert got == sorted(map(repr, con.sql(f"SELECT {names} FROM ({ORACLES[name]})").fetchall()))


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))
