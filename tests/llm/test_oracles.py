"""The operators that SQL can express give DuckDB's rows."""

import duckdb
import pytest

from sidetrace.llm import queries
from tests.test_catalogue import DIR, TABLES, plain


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = plain(tuple(r[k] for k in columns) for r in df.select(*columns).collect())
    assert rows and rows == plain(c.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall())
