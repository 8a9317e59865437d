"""Every query of the library that has SQL, against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import tessera.queries_files  # noqa: F401  registers its queries
import tessera.queries_state  # noqa: F401
from tessera.queries import QUERIES, SQL
from tessera.session import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(found):
    return sorted(tuple("NaN" if isinstance(v, float) and math.isnan(v) else str(v) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == names
    assert rows(df.select(*names).collect()) == rows(want.project(", ".join(f'"{n}"' for n in names)).fetchall())


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)


def test_filter_and_columns_reach_the_scan(spark):
    from tessera.session import table

    df = table(spark, SF, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan
