import duckdb
import pytest

from tamis.plans import contract

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(contract.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = contract.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    q = duck.sql(contract.ORACLE_SQL[name])
    assert sorted(q.columns) == cols
    want = sorted((tuple(r[q.columns.index(c)] for c in cols) for r in q.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == want
