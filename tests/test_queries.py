"""Registered queries against their SQL counterparts on the given tables."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
from panelspan.plans import driver_tables  # noqa: E402
from panelspan.plans.queries import QUERIES, tidy  # noqa: E402
from check_oracle import compare, tables  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")


@pytest.fixture(scope="module")
def database():
    return tables(DATA)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())


def test_large_values_keep_their_size(spark):
    rows = tidy(spark.createDataFrame([(1.5e13,), (-9.3e18,), (1.23456789,), (None,)], "v double")).collect()
    assert [r.v for r in rows] == [1.5e13, -9.3e18, 1.234568, None]


def test_every_order_is_in_one_period(spark):
    every = driver_tables.orders(spark, DATA)
    counted = sum(
        frame.selectExpr(f"sum({total}) AS n").first().n
        for frame, total in ((driver_tables.first_period(every), "soma_g_almas"), (driver_tables.second_period(every), "popmun20")))
    assert counted == every.count()


def test_comparison_notices_a_difference():
    import pandas as pd

    left = pd.DataFrame({"a": [1, 2], "b": [0.5, None]})
    assert compare(left, left.iloc[::-1]) == "ok"
    assert compare(left, left.assign(b=[0.5, 0.1])) != "ok" and compare(left, left.head(1)) != "ok"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    ours = entry.queries()[name](spark, DATA).toPandas()
    assert len(ours) > 0
    assert compare(ours, database.execute(entry.oracle_sql()[name]).df()) == "ok"


def test_entry(spark):
    assert entry.entry(spark).count() == 15
