"""The SQL of the queries against the operators, on nulls, empty texts, repeated ids and copies."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tamis.llm import queries

from test_ops import corpus, docs


def items():
    texts = dict((k, t) for k, t in corpus() if k is not None)
    return [("b", texts[5]), ("a", "egg cat"), ("c", None), ("d", "..."), (None, texts[6]), ("e", texts[6] + " " + texts[7]), ("f", "DOG")]


@pytest.mark.parametrize("name", ["op4_substring_dedup", "op6_minhash", "op8_decontamination"])
@pytest.mark.parametrize("empty", [False, True])
def test_sql_agrees(spark, tmp_path, name, empty):
    df, bench = docs(spark, corpus()), spark.createDataFrame(items(), "item_id string, text string")
    where = F.lit(not empty)
    df.where(where).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    bench.where(where).coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    out = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in out.description]
    found = queries.QUERIES[name](spark, str(tmp_path))
    assert found.columns == columns
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, out.fetchall()))
