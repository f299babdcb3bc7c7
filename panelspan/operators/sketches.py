"""Distinct counts that roll up: sketches per unit, merged upward.

A distinct count of a parent is not the sum of its children's.  A sketch of
fixed size per unit is: it is built in one map-side combined pass, stored, and
merged into parents, or with the sketches of new rows, without the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2**PRECISION registers; the standard error of an estimate is about 1.04 / 2**(PRECISION / 2).
PRECISION = 14


def error_bound(precision: int = PRECISION, deviations: float = 4.0) -> float:
    """Relative error that an estimate stays below but for the given number of standard deviations."""
    return deviations * 1.04 / 2 ** (precision / 2)


def distinct_sketches(df: DataFrame, keys: Sequence[str | Column], column: str, precision: int = PRECISION) -> DataFrame:
    """One sketch of the column's values per key; missing values are not counted."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(F.col(column), F.lit(precision)).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Sketches of coarser keys, from those of finer ones or of several batches."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated(sketches: DataFrame, out: str = "estimate") -> DataFrame:
    return sketches.withColumn(out, F.hll_sketch_estimate("sketch")).drop("sketch")
