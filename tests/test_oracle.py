"""Every registered query against its DuckDB oracle on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from thetaflow.plans.registry import QUERIES as CORE
from scripts.check_oracle import TABLES, digest, type_diffs

SF = "/root/testdata/sf0.001"
SQLS = {k: v for k, v in entry.oracle_sql().items() if k in CORE}
QUERIES = {k: v for k, v in entry.queries().items() if k in CORE}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_oracle():
    assert set(QUERIES) == set(SQLS) == set(CORE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(SQLS[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert type_diffs(df.schema, res.description) == []
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(dcols, drows)[0]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "straddle_day_0" in df.columns
