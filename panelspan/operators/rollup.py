"""Roll count columns up to parents, areas, prefixes and the whole nation.

All of these are plain grouped sums: partial aggregation shrinks every map
task's rows to one per key before the shuffle, so a key that holds a third of
the data costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspan.functions.guarded import field, group_total, portion
from panelspan.functions.text import id_prefix
from panelspan.operators.crosswalk import code_of
from panelspan.operators.quality import Watch

#: More groups than this and the totals are no longer treated as a dimension.
BROADCAST_GROUPS = 10_000


def rollup(df: DataFrame, keys: Sequence[str | Column], counts: Sequence[str]) -> DataFrame:
    """Sum every count column per key; all-missing sums to zero."""
    return df.groupBy(*keys).agg(*[group_total(c) for c in counts])


def rollup_by_crosswalk(
    df: DataFrame,
    identifier: str,
    crosswalk: DataFrame,
    counts: Sequence[str],
    area: str = "code_amc",
    code: str = "muni_code",
    unique_ids: bool = False,
    watch: Watch | None = None,
) -> DataFrame:
    """Sum counts per area through an (area, code) crosswalk.

    A code listed in several areas counts in each; unmatched codes drop out.
    Unless ids are known to be unique the counts are first summed per code, so
    the join sees one row per code however hot a code is.  The join carries no
    hint: the crosswalk grows with the geographies, so its size decides.
    ``watch`` observes the codes on their way: as ``rows`` their pairs with an
    area, as ``unmatched`` those without one.
    """
    coded = df.select(
        code_of(df, identifier, crosswalk, code).alias(code), *[field(c) for c in counts]
    )
    if not unique_ids:
        coded = rollup(coded.where(F.col(code).isNotNull()), [code], counts)
    if watch is None:
        return rollup(coded.join(crosswalk.select(area, code), code), [area], counts)
    joined = watch(coded.join(crosswalk.select(area, code), code, "left"), unmatched=F.col(area).isNull())
    return rollup(joined.where(F.col(area).isNotNull()), [area], counts)


def rollup_by_prefix(
    df: DataFrame, identifier: str, counts: Sequence[str], width: int = 2, key: str = "state_code"
) -> DataFrame:
    """Sum counts per leading digits of the id, over all rows."""
    return rollup(df, [id_prefix(field(identifier), width).alias(key)], counts)


NATIONAL_KEYS = ("group_type", "group_id")
# Share column -> local measure (its national one has a suffix).
STATUS_SHARES = {
    "share_of_national_occupations": "n_total",
    "share_free_of_national_group": "n_free",
    "share_enslaved_of_national_group": "n_enslaved",
    "share_male_of_national_group": "n_male",
    "share_female_of_national_group": "n_female",
    "literacy_rate_of_national_pop": "pop_literate",
    "enslaved_rate_of_national_pop": "pop_enslaved",
}
PLAIN_SHARES = {
    name: measure for name, measure in STATUS_SHARES.items()
    if measure in ("n_total", "n_male", "n_female", "pop_literate")
}


def national_totals(
    panel: DataFrame, measures: Sequence[str], level: str = "Municipality"
) -> DataFrame:
    """Totals per group over the rows of one level."""
    rows = panel.where(F.col("geography_level") == level)
    return rows.groupBy(*NATIONAL_KEYS).agg(
        *[group_total(m, f"{m}_national") for m in measures]
    )


def with_national_shares(
    panel: DataFrame,
    shares: Mapping[str, str] = STATUS_SHARES,
    level: str = "Municipality",
    group_count: int | None = None,
) -> DataFrame:
    """Add national totals and each row's share of them.

    ``group_count`` is the number of groups the panel's dictionary defines.
    Where it is given and small the totals are broadcast, so the panel itself
    is not shuffled.  Without that bound the join is left to the optimizer and
    AQE (which splits the few, very large group keys).
    """
    totals = national_totals(panel, list(shares.values()), level)
    if group_count is not None and group_count <= BROADCAST_GROUPS:
        totals = F.broadcast(totals)
    joined = panel.join(totals, list(NATIONAL_KEYS), "left")
    return joined.withColumns({
        name: portion(F.col(measure), F.col(f"{measure}_national"))
        for name, measure in shares.items()
    })
