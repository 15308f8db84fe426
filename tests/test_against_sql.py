"""Queries against their SQL over small tables of odd rows."""

import duckdb
import pandas as pd
import pytest
from test_catalog import plain

from parcelforge.plans.catalog import ORACLE_SQL, QUERIES


def nations(n=5):
    return pd.DataFrame({"n_nationkey": range(n), "n_name": [f"NATION_{i}" for i in range(n)], "n_regionkey": [i % 2 for i in range(n)]}), pd.DataFrame({"r_regionkey": range(2), "r_name": ["WEST", "EAST"]})


def customers(keys):
    return pd.DataFrame({"c_custkey": keys, "c_name": [f"C{k}" for k in keys], "c_nationkey": [k % 5 for k in keys], "c_acctbal": [float(k % 700) for k in keys], "c_mktsegment": ["AUTO" if k % 2 else "HOME" for k in keys]})


def suppliers(keys):
    return pd.DataFrame({"s_suppkey": keys, "s_name": [f"S{k}" for k in keys], "s_nationkey": [k % 5 for k in keys], "s_acctbal": [float(k) for k in keys]})


@pytest.fixture
def same_as_sql(spark, tmp_path):
    """Writes the tables and holds a query over them against its SQL."""
    def check(name, **tables):
        nation, region = nations()
        con = duckdb.connect()
        for t, rows in ({"nation": nation, "region": region} | tables).items():
            rows.to_parquet(tmp_path / f"{t}.parquet")
            con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
        df = QUERIES[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
        rel = con.sql(ORACLE_SQL[name])
        at = [rel.columns.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
        return got

    return check


def test_whole_fold_tells_the_greatest_confidence(same_as_sql):
    keys = [5, 10, 20, 25, 30]  # 0.0, none, none; 0.0, none
    orders = pd.DataFrame({"o_orderkey": keys, "o_custkey": [1, 1, 2, 3, 3], "o_orderstatus": "F", "o_totalprice": 7.5, "o_orderdate": pd.Timestamp("1997-09-22"), "o_orderpriority": [f"{k}-LOW" for k in keys]})
    assert len(same_as_sql("property_fold_whole", orders=orders)) == 3
