"""The registered queries agree with their SQL on the smallest tables, and the others run."""

import duckdb
import pytest
from driftlens.llm.queries import ORACLE_SQL, QUERIES

from ..test_queries import D, rows

TABLES = "documents embeddings pages conversations"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, db, name):
    got, want = QUERIES[name](spark, D).toPandas(), db.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, D).count() > 0
