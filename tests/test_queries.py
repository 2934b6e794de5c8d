"""Every engine query against its SQL, on the smallest tables."""

import glob
import os
from decimal import Decimal

import pytest

from derivia import queries

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


def plain(value):
    """Numbers as numbers: decimals and floats that are equal look equal."""
    return float(value) if isinstance(value, (float, Decimal)) else value


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(str([plain(v[k]) for k in order]) for v in values)


def equal(spark_frame, result):
    names = [c[0] for c in result.description]
    assert sorted(spark_frame.columns) == sorted(names)
    assert rows(spark_frame.columns, spark_frame.collect()) == rows(names, result.fetchall())


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, tables, name):
    equal(queries.queries()[name](spark, SF), tables.execute(queries.ORACLE[name]))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the tables aren't here")
def test_backfill_goes_on_to_the_last_order(spark):
    # more than one full chunk
    orders = "/root/testdata/sf0.1/orders.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{orders}'")
    got = queries.queries()["q_backfill_all"](spark, "/root/testdata/sf0.1")
    assert got.count() == spark.read.parquet(orders).count() > 100_000
    equal(got, con.execute(queries.ORACLE["q_backfill_all"]))
