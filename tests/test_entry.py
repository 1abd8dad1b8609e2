"""The entry points: names, SQL, equality with DuckDB on the smallest tables, and life without optional parts."""

from __future__ import annotations

import math
import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as e

FOLDER = "/root/testdata/sf0.001"
HERE = Path(__file__).resolve().parents[1]
core = sorted(k for k in e.queries() if not (k[0] == "p" and k[1].isdigit()))


def cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data here")
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    return con


def test_every_sql_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries()) and len(core) > 100


@pytest.mark.parametrize("name", core)
def test_query_equals_sql(spark, duck, name):
    df = e.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    if name not in e.oracle_sql():
        return
    cur = duck.execute(e.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(cell(r[i]) for i in at) for r in cur.fetchall())


def test_flagship(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data here")
    assert e.entry(spark).columns == ["query_id", "rank", "item_id", "score"]


def test_core_imports_without_optional_parts(tmp_path):
    import shutil

    shutil.copytree(HERE / "quillmill", tmp_path / "quillmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(HERE / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0 and int(out.stdout.split()[0]) == len(core), out.stderr
    for f in (HERE / "quillmill").rglob("*.py"):
        if "llm" not in f.relative_to(HERE / "quillmill").parts:
            assert "quillmill.llm" not in f.read_text()
