import duckdb
import pytest

from parcelforge.llm.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    plain = lambda v: v.item() if hasattr(v, "item") else v
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
