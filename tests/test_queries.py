import os

import duckdb
import pytest

from veilspark.plans import queries as core

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return c


def plain(v):
    return str(round(v, 6) if isinstance(v, float) else v)


@pytest.mark.parametrize("name", core.queries())
def test_query(spark, duck, name):
    df = core.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in core.oracle_sql():
        found = duck.execute(core.oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == cols
        assert sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()) == rows


def test_flagship_has_no_exchange(spark):
    from veilspark.operators import scan

    plan = scan.matches(spark.read.parquet(f"{DIR}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
