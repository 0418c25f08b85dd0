"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

import os

import duckdb
import pytest

from sidetrace import catalogue

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(None if v is None or v != v else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = plain(tuple(r[c] for c in columns) for r in df.select(*columns).collect())
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    wanted = duck.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert rows == plain(wanted)
