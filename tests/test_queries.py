"""Every registered graph query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lodestone import queries as q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(df, columns):
    return sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in q.REGISTRY.items() if sql))
def test_query(spark, duck, name):
    want = duck.sql(q.oracle_sql()[name]).df()
    got = q.queries()[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and e.oracle_sql().keys() <= e.queries().keys()


@pytest.mark.parametrize("name", ["chunk_points", "risk_enhanced"])
def test_tables_of_all_classes_are_not_broadcast(spark, name):
    plan = q.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "BroadcastHashJoin" in x]
    assert all("[term_id#" in x for x in joins) and "SortMergeJoin" in plan
