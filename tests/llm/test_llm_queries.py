"""Registered queries against their SQL on the smallest tables, and how the package hangs together."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from landledger.llm import queries

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_duckdb(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_a_broken_import_inside_the_package_is_an_error(tmp_path):
    """The entry only forgives that the package or the pipeline isn't there."""
    shutil.copytree(f"{ROOT}/landledger", tmp_path / "landledger")
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    (tmp_path / "landledger/llm/warc.py").write_text("import a_module_that_is_nowhere\n")
    r = subprocess.run([sys.executable, "-c", "import __spark_entry__"], capture_output=True, text=True, cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert r.returncode != 0 and "a_module_that_is_nowhere" in r.stderr
