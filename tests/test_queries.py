"""Every registered query that has SQL agrees with it on the smallest tables."""

import sys

import __spark_entry__ as entry
import duckdb
import pandas as pd
import pytest
from driftlens.plans.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
    return c


def rows(df):
    cell = lambda v: None if v is None or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(str(cell(v)) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, db, name):
    got, want = QUERIES[name](spark, D).toPandas(), db.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"paired_scores"}))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, D).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_library_stands_without_the_llm_folder():
    import pathlib
    import subprocess

    root = pathlib.Path(entry.__file__).parent
    code = "import sys; sys.modules['driftlens.llm'] = None; import driftlens.plans.queries, driftlens.plans.build, driftlens.plans.protocol"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0
