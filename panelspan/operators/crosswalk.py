"""Crosswalk between geographies and comparable areas, and its quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspan.functions.guarded import field
from panelspan.functions.text import id_code
from panelspan.operators.quality import Watch


def explode_crosswalk(
    raw: DataFrame, area: str = "code_amc", codes: str = "list_code_muni_2010", out: str = "muni_code"
) -> DataFrame:
    """One row per (area, code) from a comma-separated list; narrow."""
    items = F.split(F.col(codes).cast("string"), ",")
    return raw.select(area, F.explode(items).alias(out)).withColumn(out, F.trim(out))


def code_of(df: DataFrame, identifier: str, crosswalk: DataFrame, code: str = "muni_code") -> Column:
    """The id in the crosswalk's own type: text codes need the id as text.

    Where both already share a type the id is used as it is, so that an
    existing partitioning on it serves the join.
    """
    if df.schema[identifier].dataType == crosswalk.schema[code].dataType:
        return field(identifier)
    return id_code(field(identifier))


def unmatched(df: DataFrame, identifier: str, crosswalk: DataFrame, code: str = "muni_code") -> DataFrame:
    """Rows whose code the crosswalk does not know."""
    rows = df.withColumn(code, code_of(df, identifier, crosswalk, code))
    return rows.join(crosswalk.select(code), code, "left_anti")


def attach_geography(
    df: DataFrame, lookup: DataFrame, key: str, required: str = "code_state", watch: Watch | None = None
) -> tuple[DataFrame, DataFrame]:
    """Left-join attributes; return (matched rows, rows without geography).

    No hint on the lookup: it grows with the geographies, and the optimizer
    broadcasts it only if its measured size allows.  ``watch`` observes all
    rows and the ``unmatched`` ones.
    """
    joined = df.join(lookup, key, "left")
    if watch:
        joined = watch(joined, unmatched=F.col(required).isNull())
    return joined.where(F.col(required).isNotNull()), joined.where(F.col(required).isNull())


def majority_parent(
    df: DataFrame,
    identifier: str,
    crosswalk: DataFrame,
    parent: Column,
    area: str = "code_amc",
    code: str = "muni_code",
    out: str = "state_code",
    unique_ids: bool = False,
) -> DataFrame:
    """Per area the parent with most members; ties go to the lowest parent.

    Counting first leaves one row per (area, parent); the winner is then the
    minimum of (-n, parent), an aggregate with map-side combine, so no window
    has to sort an area's members.
    """
    members = df.select(code_of(df, identifier, crosswalk, code).alias(code), parent.alias(out))
    # One row per code before the join, however many rows a code has.
    per_code = (members.withColumn("n", F.lit(1)) if unique_ids
                else members.groupBy(code, out).agg(F.count("*").alias("n")))
    counts = (
        per_code.join(crosswalk.select(area, code), code)
        .groupBy(area, out).agg(F.sum("n").alias("n"))
    )
    # A missing parent sorts last among equals.
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(out).isNull().alias("gap"), F.col(out)))
    return counts.groupBy(area).agg(best.alias("best")).select(area, F.col(f"best.{out}").alias(out))


def crosswalk_summary(crosswalk: DataFrame, area: str = "code_amc", approximate: bool = False) -> DataFrame:
    """Number of mappings and of distinct areas."""
    areas = F.approx_count_distinct(area) if approximate else F.count_distinct(F.col(area))
    return crosswalk.agg(F.count("*").alias("mappings"), areas.alias("areas"))


def _check(df: DataFrame, name: str, n: Column, total: Column) -> DataFrame:
    return df.agg(n.cast("long").alias("n"), total.cast("long").alias("total")).select(
        F.lit(name).alias("check"), "n", "total"
    )


def quality_report(
    tables: Sequence[tuple[str, DataFrame, str]],
    crosswalk: DataFrame,
    panels: Sequence[tuple[str, DataFrame]] = (),
    area: str = "code_amc",
    code: str = "muni_code",
) -> DataFrame:
    """One row per check: unmatched rows, codes in several areas, panel sizes.

    ``tables`` holds (label, table, id column).
    """
    per_code = crosswalk.groupBy(code).agg(F.count("*").alias("times"))
    checks = [
        _check(per_code, "crosswalk: codes in several areas",
               F.coalesce(F.sum((F.col("times") > 1).cast("long")), F.lit(0)), F.count("*"))
    ]
    for label, table, identifier in tables:
        # Count per code before the join: one row per code, however hot.
        rows = (
            table.select(code_of(table, identifier, crosswalk, code).alias(code))
            .groupBy(code).agg(F.count("*").alias("rows"))
            .join(per_code, code, "left")
        )
        missing = F.sum(F.when(F.col("times").isNull(), F.col("rows")).otherwise(0))
        checks.append(_check(rows, f"{label}: rows without area",
                             F.coalesce(missing, F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))))
    for label, panel in panels:
        checks.append(_check(panel, f"{label}: rows", F.count("*"), F.count("*")))
    report = checks[0]
    for check in checks[1:]:
        report = report.unionByName(check)
    return report
