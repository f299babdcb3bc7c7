"""Long panels to wide ones and back."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspan.functions.guarded import field, quoted, ratio_sql, text_literal
from panelspan.operators.panels import SECTOR, Layout, PrefixLayout, denominators, layout_groups

WIDE_STATUS = (
    "n_total", "share_of_all_occupations", "share_free_within_group",
    "share_enslaved_within_group", "share_male_within_group", "share_female_within_group",
)
WIDE_PLAIN = (
    "n_total", "share_of_all_occupations", "share_male_within_group", "share_female_within_group",
)
LITERACY = "literacy_rate_population"


def pivot_panel(
    panel: DataFrame,
    ids: Sequence[str],
    groups: Sequence[str],
    measures: Sequence[str] = WIDE_STATUS,
    carried: Sequence[str] = (LITERACY,),
    check_unique: bool = True,
) -> DataFrame:
    """One row per id with columns ``{measure}_{group}``.

    Conditional aggregation over known groups: one shuffle on the ids, where
    the general pivot would need a pass to find the groups and a second
    shuffle.  Carried columns depend on the id alone.  Two rows for one
    (id, group) raise unless the check is turned off.
    """
    def cell(measure: str, group: str) -> Column:
        here = f"group_id = {text_literal(group)}"
        value = f"max(CASE WHEN {here} THEN {quoted(measure)} END)"
        if check_unique:
            message = text_literal(f"group {group} occurs twice for one id")
            value = f"CASE WHEN count_if({here}) > 1 THEN raise_error({message}) ELSE {value} END"
        return F.expr(value).alias(f"{measure}_{group}")

    cells = [cell(m, g) for m in measures for g in groups]
    return panel.groupBy(*ids).agg(*[F.max(c).alias(c) for c in carried], *cells)


def wide_panel(
    counts: DataFrame, ids: Sequence[str], layout: Layout, kinds: Sequence[str] = (SECTOR,)
) -> DataFrame:
    """The wide panel straight from the counts: equal to pivoting the long
    panel of the same table, but a narrow projection without any shuffle."""
    groups = layout_groups(counts.columns, layout, kinds)
    status = isinstance(layout, PrefixLayout)
    measures = WIDE_STATUS if status else WIDE_PLAIN
    base = denominators(counts, layout)
    kept = [field(i) for i in ids]
    listed = base.select(*kept, LITERACY, "occ_total", *[F.expr(g.as_struct()).alias(g.id) for g in groups])

    def value(group: str, measure: str) -> str:
        def n(who: str) -> str:
            if status and who in ("male", "female"):
                return f"({quoted(group)}.n_{who}_free + {quoted(group)}.n_{who}_enslaved)"
            return f"{quoted(group)}.n_{who}"

        if measure == "n_total":
            return n("total")
        if measure == "share_of_all_occupations":
            return ratio_sql(n("total"), "occ_total")
        return ratio_sql(n(measure.split("_")[1]), n("total"))

    cells = [F.expr(value(g.id, m)).alias(f"{m}_{g.id}") for m in measures for g in groups]
    return listed.select(*kept, LITERACY, *cells)


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns a frame lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], key: str, value: str) -> DataFrame:
    """Unpivot columns into (key, value) rows; narrow."""
    return df.unpivot(list(ids), list(columns), key, value)
