"""Every query with SQL against DuckDB on the smallest tables."""
import os

import duckdb
import pytest

from tidemark import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(records, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([round(r[k], 9) if isinstance(r[k], float) else r[k] for k in order]) for r in records)


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_sql(spark, db, name):
    df = engine.QUERIES[name](spark, SF)
    cursor = db.execute(engine.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.collect(), df.columns) == rows(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.SQL)))
def test_runs(spark, name):
    assert engine.QUERIES[name](spark, SF).count() > 0


def test_filters_deny_nothing_held(spark):
    assert engine.bloom_membership(spark, SF).where("held and not maybe").isEmpty()
