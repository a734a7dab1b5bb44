"""Every query with SQL against DuckDB on the smallest tables; every other one runs and gives the same schema twice."""

import os

import duckdb
import pytest

from corpusloom.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(rows):
    def one(x):
        if x is None or x != x:
            return "null"
        if isinstance(x, float):
            return round(x, 5) + 0.0
        return x if isinstance(x, str) or not hasattr(x, "__int__") else int(x)

    return sorted((tuple(map(one, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = [tuple(r) for r in df.select(*cols).collect()]
    cursor = duck.execute(ORACLE_SQL[name])
    theirs = [c[0] for c in cursor.description]
    assert sorted(theirs) == cols
    at = [theirs.index(c) for c in cols]
    assert plain(mine) == plain([tuple(r[i] for i in at) for r in cursor.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert "document_rank" in e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
