"""Every catalog query against its SQL in DuckDB, and the driver's entry."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from corbel.plans import catalog_queries, contract_queries, reader_queries  # noqa: F401  the latter two add to the first

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog_queries.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got = catalog_queries.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    cursor = duck.execute(catalog_queries.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(dict(zip(names, r, strict=True))[c] for c in cols)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == want


def test_snapshot_diff(spark, sf):
    got = catalog_queries.snapshot_diff(lambda n: spark.read.parquet(f"{sf}/{n}.parquet")).collect()
    kinds = {r.kind for r in got}
    assert kinds == {"added", "removed"} and len({r.id for r in got}) == len(got)
    gone = [r for r in got if r.pointer == "/p_size"]
    assert gone and all(r.kind == "removed" and r.after is None for r in gone)


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_everything_else_works_without_the_training_data_operators(tmp_path):
    for p in ("corbel", "__spark_entry__.py"):
        (tmp_path / p).symlink_to(ROOT / p) if p.endswith(".py") else None
    pkg = tmp_path / "corbel"
    pkg.mkdir()
    for p in (ROOT / "corbel").iterdir():
        if p.name != "llm":
            (pkg / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
