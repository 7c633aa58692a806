"""Every registered query of the catalogue, the media browser, statistics and rasters against its SQL."""

import pytest

from lumenframe import plans
from tests.compare import connect, spark_rows, sql_rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, sf_dir, name):
    df = plans.QUERIES[name](spark, sf_dir)
    rows = spark_rows(df)
    if name in plans.SQL:
        cols, want = sql_rows(con, plans.SQL[name])
        assert sorted(df.columns) == cols and rows == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns and set(e.oracle_sql()) <= set(e.queries())


def test_without_training_text_package(tmp_path):
    """The entry module works where that package and the pipeline are deleted."""
    import pathlib
    import shutil
    import subprocess
    import sys

    top = pathlib.Path(__file__).parent.parent
    shutil.copytree(top / "lumenframe", tmp_path / "lumenframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'grid' in e.queries(), any(q.startswith('op1_') for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert said.stdout.split()[1:] == ["True", "False"], said.stderr
