"""Every query with an oracle, on the smallest tables, and the contract of the entry module."""

from __future__ import annotations

import importlib
import math
import os
import subprocess
import sys
from pathlib import Path

import pytest

from kinweave.plans import registry

DATA = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(row):
    return tuple(None if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(str(plain(r)) for r in df.select(*columns).collect())
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    assert got == sorted(str(plain(r[i] for i in order)) for r in rel.fetchall())


def test_entry_without_the_corpus_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert e.llm_registry is None and 'block_pairs' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, env=os.environ | {"PYTHONPATH": str(REPO)})


def test_nothing_else_imports_the_corpus_operators():
    for p in (REPO / "kinweave").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert "kinweave.llm" not in p.read_text()


def test_flagship(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    entry = importlib.import_module("__spark_entry__")
    rows = entry.entry(spark).collect()
    assert len({r.main_id for r in rows}) == len(rows) == len({r.compare_id for r in rows})
