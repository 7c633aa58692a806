"""The queries of this package that have SQL against it."""

import pytest

from lumenframe.llm import queries
from tests.compare import connect, spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    cols, want = sql_rows(connect(sf_dir), queries.SQL[name])
    assert sorted(df.columns) == cols and spark_rows(df) == want
