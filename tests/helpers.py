"""Small helpers shared by the tests."""

from __future__ import annotations


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(df):
    (row,) = df.collect()
    return row


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def initial_plan(df) -> str:
    """Physical plan before any stage ran."""
    return plan(df).split("== Initial Plan ==")[-1]
