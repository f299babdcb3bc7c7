"""Exact quantiles at scale, and binning by them.

``percentile`` keeps every distinct value of a group in one task's memory.
Here values are selected by radix.  A double has an order-preserving integer;
a histogram of its leading bits, of fixed size, tells in which cell each
wanted rank lies, and the next scan looks into those cells only, as ranges of
values that reach the Parquet filter.  Two or three scans find every order
statistic, whatever the distribution.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspan.sources.stage import written

QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)
QUARTILE_LABELS = ("Q1 (lowest)", "Q2", "Q3", "Q4 (highest)")
#: Bits left after each scan: a histogram has at most 2**20 cells, for each cell looked into.
LEVELS = (44, 24, 4, 0)
#: Cells with no more rows than this are resolved to single values at once.
DIRECT = 1 << 20
_INFINITE = 2047 << 52
_NAN = (1 << 63) - 1


def with_bits(values: DataFrame) -> DataFrame:
    """(v, bits): the order-preserving long of a double, its bits negated for negative values; NaN is the greatest.

    Both zeros are 0.  The exponent comes from ``log2`` and is corrected by
    comparing with the exact powers on both sides, so every step is exact.
    Each step is a projection of its own, so that none is computed twice.
    """
    return (
        values.selectExpr("v", "abs(v) AS size")
        .selectExpr("v", "size", "greatest(least(coalesce(floor(log2(size)), -1022), 1023), -1022) AS about")
        .selectExpr("v", "size", "about", "pow(2D, about) AS power")
        .selectExpr("v", "size", "about + if(size >= 2 * power, 1, 0) - if(about > -1022 AND size < power, 1, 0) AS exponent")
        .selectExpr("v", f"(exponent + 1022) * {1 << 52}L + try_cast(size / pow(2D, exponent) * {float(1 << 52)}D AS bigint) AS finite")
        .selectExpr("v", f"CASE WHEN isnan(v) THEN {_NAN}L WHEN v = double('infinity') THEN {_INFINITE}L "
                         f"WHEN v = double('-infinity') THEN {-_INFINITE}L WHEN v < 0 THEN -finite ELSE finite END AS bits")
    )


def double_of(bits: int) -> float:
    """The double an order-preserving long stands for."""
    value = struct.unpack("<d", struct.pack("<q", min(abs(bits), _NAN)))[0]
    return -value if bits < 0 else value


def _within(low: int, high: int) -> str:
    """Condition on ``v`` that its long lies in [low, high]."""
    if low > _INFINITE:
        return "isnan(v)"
    def literal(bits: int) -> str:
        value = double_of(bits)
        return f"double('{'-' if value < 0 else ''}infinity')" if math.isinf(value) else f"{value!r}D"
    if high > _INFINITE:
        return f"v >= {literal(low)}"
    return f"v >= {literal(max(low, -_INFINITE))} AND v <= {literal(high)}"


def order_statistics(values: DataFrame, ranks: Sequence[int] | None = None, probabilities: Sequence[float] = ()) -> tuple[int, dict[int, float]]:
    """Number of values of the double column ``v`` and the values at the given ranks (from 0), in two to four scans.

    Instead of ranks, ``probabilities`` asks for both neighbours of each
    quantile's position.  One row per wanted rank reaches the driver after a
    scan.
    """
    keyed = with_bits(values.where("v IS NOT NULL"))
    cells = [(-_NAN - 1, _NAN, 0)]                                 # least and greatest long, rows before
    wanted: dict[int, int] = {}
    found: dict[int, float] = {}
    n, single = None, False
    for shift in LEVELS:
        shift = 0 if single else shift
        looked = keyed if n is None else keyed.where(" OR ".join(f"({_within(a, b)})" for a, b, _ in cells))
        histogram = looked.groupBy(F.shiftright("bits", shift).alias("cell")).agg(F.count("*").alias("rows"))
        if n is None:                                              # one cell: everything
            histogram = histogram.selectExpr("cell", "rows", "0 AS of", "0L AS base")
        else:
            of = " ".join(f"WHEN shiftleft(cell, {shift}) BETWEEN {a}L AND {b}L THEN {k}" for k, (a, b, _) in enumerate(cells))
            base = ", ".join(f"{before}L" for _, _, before in cells)
            histogram = histogram.selectExpr("cell", "rows", f"CASE {of} END AS of").selectExpr("*", f"array({base})[of] AS base")
        counted = histogram.selectExpr("cell", "rows", "base + sum(rows) OVER (PARTITION BY of ORDER BY cell ROWS UNBOUNDED PRECEDING) AS upto")
        if n is None:
            places = [f"cast({f}((n - 1) * {float(p)!r}D) AS bigint)" for p in probabilities for f in ("floor", "ceil")]
            asked = ", ".join([*places, *[f"{r}L" for r in ranks or ()]])
            counted = counted.selectExpr("*", "max(upto) OVER () AS n")
        else:
            counted, asked = counted.selectExpr("*", f"{n}L AS n"), ", ".join(f"{r}L" for r in wanted)
        counted = counted.selectExpr("*", f"array_distinct(array({asked})) AS asked")
        hit = counted.selectExpr("cell", "rows", "upto", "n", "filter(asked, r -> r >= upto - rows AND r < upto) AS here").where("size(here) > 0")
        rows = hit.collect()
        if not rows:
            return n or 0, found
        n = rows[0].n
        cells, wanted = [], {}
        for r in sorted(rows, key=lambda r: r.cell):
            low = r.cell << shift
            if shift == 0:
                found.update({rank: double_of(low) for rank in r.here})
                continue
            cells.append((low, low + (1 << shift) - 1, r.upto - r.rows))
            wanted.update({rank: r.cell for rank in r.here})
        if shift == 0:
            return n, found
        single = sum(r.rows for r in rows) <= DIRECT
    return n, found


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float] = QUARTILES, stage: bool | None = None) -> DataFrame:
    """One row ``(n, quantiles)``: linear interpolation between order statistics.

    The scans run when this is called.  ``stage`` writes the column to a table
    first; by default that is done unless the input is a plain scan, so that
    what leads to the column is evaluated once.  Missing values are ignored.
    """
    values = df.select(F.col(column).cast("double").alias("v"))
    if stage is None:
        stage = any(node in df._jdf.queryExecution().optimizedPlan().toString() for node in ("Aggregate", "Join", "Window", "Generate", "Sort", "Repartition"))
    n, found = order_statistics(written(values, "values") if stage else values, probabilities=probabilities)
    quantiles = None
    if n:
        at = [(n - 1) * float(p) for p in probabilities]
        quantiles = [found[math.floor(x)] + ((x - math.floor(x)) * (found[math.ceil(x)] - found[math.floor(x)]) if x != math.floor(x) else 0.0) for x in at]
    return df.sparkSession.createDataFrame([(n, quantiles)], "n long, quantiles array<double>")


def approximate_quantiles(
    df: DataFrame, column: str, probabilities: Sequence[float] = QUARTILES, accuracy: int = 10_000
) -> DataFrame:
    """Same shape from the sketch alone, without interpolation."""
    quantiles = F.percentile_approx(F.col(column).cast("double"), list(probabilities), accuracy)
    return df.agg(F.count(column).alias("n"), quantiles.alias("quantiles"))


def quantile_bins(
    df: DataFrame,
    column: str,
    breaks: DataFrame,
    labels: Sequence[str] = QUARTILE_LABELS,
    out: str = "quartile",
) -> DataFrame:
    """Assign right-closed bins, the lowest value included in the first.

    Breaks are one row of ``exact_quantiles`` and arrive as a scalar, not a
    join.  Equal breaks raise: bins would be ambiguous.
    """
    row = breaks.select("quantiles").scalar()
    value, edge = F.col(column), F.col("_breaks")
    tied = reduce(or_, [edge[i] >= edge[i + 1] for i in range(len(labels))])
    bin_ = F.when(tied, F.raise_error(F.lit(f"breaks of {column} are not unique")).cast("string"))
    # Values outside the breaks stay without a bin.
    bin_ = bin_.when((value < edge[0]) | (value > edge[len(labels)]), F.lit(None).cast("string"))
    for i, label in enumerate(labels):
        bin_ = bin_.when(value <= edge[i + 1], label)
    return df.withColumn("_breaks", row).withColumn(out, bin_).drop("_breaks")
