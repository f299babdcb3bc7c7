"""Arithmetic with missing-value rules that match the published panels.

A missing value is always NULL; NaN never enters.  Every expression is safe
under ANSI mode: no division by zero can be raised.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0
LOGIT_MARGIN = 1e-8


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Wide tables have hundreds of sums.  These builders return SQL text, so that a
# whole panel becomes a handful of parsed expressions instead of thousands of
# Column calls on the driver.

def row_total_sql(columns: Iterable[str]) -> str:
    """Sum across a row, missing counted as zero; no column gives zero."""
    terms = [f"coalesce(cast({quoted(c)} as double), 0D)" for c in columns]
    return "(" + " + ".join(terms) + ")" if terms else "0D"


def residual_sql(whole: str, *parts: str) -> str:
    """What the parts leave of the whole, never below zero; NULL stays NULL."""
    left = f"({whole} - {' - '.join(parts)})"
    return f"CASE WHEN {left} < 0 THEN 0D ELSE {left} END"


def ratio_sql(numerator: str, denominator: str) -> str:
    return f"CASE WHEN {denominator} > 0 THEN {numerator} / {denominator} END"


def row_total(columns: Iterable[str]) -> Column:
    return F.expr(row_total_sql(columns))


def group_total(column: str, name: str | None = None) -> Column:
    """Grouped sum, missing counted as zero; an all-missing group gives zero."""
    return F.expr(f"coalesce(sum(cast({quoted(column)} as double)), 0D) AS {quoted(name or column)}")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient where the denominator is known and positive, else NULL."""
    return F.when(denominator > 0, numerator / denominator)


def portion(part: Column, whole: Column) -> Column:
    """Unguarded quotient whose undefined cases (0/0, missing) become zero."""
    return F.coalesce(F.try_divide(part, whole), F.lit(ZERO))


def floor_at_zero(value: Column) -> Column:
    """Negative becomes zero, missing stays missing (``greatest`` would not)."""
    return F.when(value < 0, F.lit(ZERO)).otherwise(value)


def logit(share: Column, margin: float = LOGIT_MARGIN) -> Column:
    low, high = F.lit(margin), F.lit(1 - margin)
    inside = F.when(share < low, low).when(share > high, high).otherwise(share)
    return F.ln(inside / (1 - inside))


def _both_positive(before: Column, after: Column, value: Column) -> Column:
    return F.when((before > 0) & (after > 0), value)


def log_ratio(before: Column, after: Column) -> Column:
    return _both_positive(before, after, F.ln(after / before))


def compound_growth(before: Column, after: Column, years: float) -> Column:
    return _both_positive(before, after, F.pow(after / before, F.lit(1.0 / years)) - 1)


def log_growth(before: Column, after: Column, years: float) -> Column:
    return log_ratio(before, after) / F.lit(float(years))


def logit_shift(before: Column, after: Column) -> Column:
    """Logit difference where both shares lie strictly between 0 and 1."""
    open_interval = (before > 0) & (before < 1) & (after > 0) & (after < 1)
    return F.when(open_interval, logit(after) - logit(before))


def absolute_shift(pairs: Iterable[tuple[Column, Column]]) -> Column:
    """Sum of absolute differences; NULL when any input is missing."""
    return reduce(add, [F.abs(after - before) for before, after in pairs])


def field(name: str) -> Column:
    """Column by its exact name, whatever characters the name holds."""
    return F.col(quoted(name))
