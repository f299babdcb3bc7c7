"""Positions along a total order without a single sorting task.

Rows are range-partitioned and sorted within partitions; a row's place there
plus the rows of all partitions before it is its rank.  The offsets are one
number per partition.  A value that most rows share is spread over several
partitions by a hash of the row, so no task holds all its ties.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspan.functions.guarded import field
from panelspan.sources.stage import written


class Ranked:
    """Rows of ``df`` with a value in ``column``, stored once in its order.

    ``rows`` is the stored table (the input's columns, ``_part`` and ``_place``).
    """

    def __init__(self, df: DataFrame, column: str):
        self.column = column
        known = df.where(field(column).isNotNull())
        # evaluated once; finding range bounds and dealing rows out read the stored rows
        stored = written(known, "ranked-input")
        tie = F.xxhash64(*[field(c) for c in stored.columns if not stored.schema[c].dataType.simpleString().startswith("map")])
        ordered = stored.withColumn("_tie", tie).repartitionByRange(field(column), F.col("_tie")).sortWithinPartitions(field(column), "_tie")
        at = F.monotonically_increasing_id()
        placed = ordered.withColumn("_at", at).withColumns({
            "_part": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_tie", "_at")
        self.rows = written(placed, "ranked")

    def offsets(self) -> DataFrame:
        """_part, _before (rows of the partitions before it) and _rows of all; one row per partition."""
        counts = self.rows.groupBy("_part").agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
        return counts.select("_part", (upto - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_rows"))

    def with_rank(self, out: str = "rank") -> DataFrame:
        """Rank from 1 along the order; ties follow each other."""
        placed = self.rows.join(self.offsets(), "_part")
        return placed.withColumn(out, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before", "_rows")

    def quantiles(self, probabilities: Sequence[float]) -> tuple[int, list[float] | None]:
        """Number of rows and linearly interpolated quantiles, from the wanted ranks alone."""
        position = [f"(_rows - 1) * {float(p)!r}D" for p in probabilities]
        asked = "array_distinct(array(" + ", ".join(f"cast({f}({x}) AS bigint)" for x in position for f in ("floor", "ceil")) + "))"
        wanted = self.offsets().withColumn("at", F.explode(F.expr(asked))) \
            .where("at >= _before").withColumn("last", F.max("_before").over(Window.partitionBy("at"))).where("_before = last") \
            .select("_part", (F.col("at") - F.col("_before")).alias("_place"), "at", "_rows")
        # partitions without rows have no offsets, so each rank lies in exactly one
        found = {r.at: (r.value, r._rows) for r in self.rows.join(F.broadcast(wanted), ["_part", "_place"]).select(
            "at", "_rows", field(self.column).cast("double").alias("value")).collect()}
        if not found:
            return 0, None
        n = next(iter(found.values()))[1]
        out = []
        for p in probabilities:
            x = (n - 1) * float(p)
            low, high = found[math.floor(x)][0], found[math.ceil(x)][0]
            out.append(low + (x - math.floor(x)) * (high - low) if high != low else low)
        return n, out
