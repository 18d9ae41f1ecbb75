"""Every query of the reference's operators runs on the smallest tables and, where there is SQL, equals it."""

import pytest

from oracle import TINY, connect, same

from tidemark.plans.registry import FLAGSHIP, QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return connect(TINY)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    same(QUERIES[name](spark, TINY), SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert len(QUERIES[name](spark, TINY).collect()) > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 15
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert FLAGSHIP in entry.queries()


def test_imports_without_the_text_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    from oracle import REPO

    shutil.copytree(f"{REPO}/tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(QUERIES)), "0"], out.stderr
