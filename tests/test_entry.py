"""The registered queries and the entry module's guard."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_module

TOP = Path(__file__).resolve().parents[1]
SMALL = Path("/root/testdata/sf0.001")


def test_every_sql_has_its_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(entry_module.queries()) > 60


@pytest.mark.skipif(not SMALL.is_dir(), reason="the driver's tables are not here")
def test_entry(spark):
    assert entry_module.entry(spark).columns == ["i", "j", "l", "s"]


@pytest.mark.skipif(not SMALL.is_dir(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["radius_join", "knn_join", "laplacian_geometric", "connected_components", "dual_metric", "kmeans_step", "doubling_dimension"])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    got = entry_module.queries()[name](spark, str(SMALL))
    want = con.execute(entry_module.oracle_sql()[name]).df()
    assert sorted(map(tuple, got.select(sorted(got.columns)).collect())) == sorted(want[sorted(want.columns)].itertuples(index=False, name=None))


def test_import_without_the_optional_parts(tmp_path):
    for name in ("geolattice", "__spark_entry__.py"):
        source = TOP / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(n.startswith('op') and n[2].isdigit() for n in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
