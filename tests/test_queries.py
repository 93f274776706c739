import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from nearfield.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))
    if name not in ORACLES:
        assert got
        return
    sql = entry.oracle_sql()[name]
    names = ", ".join(f'"{c}"' for c in sorted(duck.sql(sql).columns))
    assert sorted(duck.sql(sql).columns) == sorted(df.columns)
    assert got == sorted(map(repr, duck.sql(f"SELECT {names} FROM ({sql})").fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_llm_package(tmp_path):
    """The library and the entry file work where the llm package and the pipeline are deleted."""
    root = Path(entry.__file__).parent
    (tmp_path / "nearfield").mkdir()
    for p in (root / "nearfield").iterdir():
        if p.name != "llm":
            (tmp_path / "nearfield" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout
    assert json.loads(said) == [sorted(QUERIES), sorted(ORACLES)]
