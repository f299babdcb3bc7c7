"""Long panels: one row per geography and group, built in one narrow pass.

A *layout* knows how the counts are coded in column names.  It turns a wide
table into context columns and an array of group structs; ``inline`` then
fans each input row out to its groups.  No shuffle, no self-join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspan.functions.guarded import field as col
from panelspan.functions.guarded import quoted, ratio_sql, residual_sql, text_literal
from panelspan.operators.naming import exact_total, matched_total

OCCUPATION, SECTOR = "Occupation", "Sector"
SECTORS = ("agriculture", "manufacturing", "services")

# Counts of a panel row.
COUNTS = (
    "n_total", "n_free", "n_enslaved",
    "n_male_free", "n_female_free", "n_male_enslaved", "n_female_enslaved",
)
# Totals of the geography on each panel row.
CONTEXT = (
    "pop_total", "pop_free", "pop_enslaved", "pop_literate",
    "literacy_rate_population", "enslaved_rate_population",
    "occ_total", "occ_free", "occ_enslaved", "occ_male", "occ_female",
)


@dataclass(frozen=True)
class Group:
    """A named group of count columns."""

    id: str
    label: str
    sector: str
    patterns: tuple[str, ...]


@dataclass(frozen=True)
class GroupCounts:
    """One group of a layout with the expressions of its counts."""

    kind: str
    id: str
    label: str
    sector: str
    counts: Mapping[str, str]

    def as_struct(self) -> str:
        texts = {"group_type": self.kind, "group_id": self.id,
                 "group_label": self.label, "sector": self.sector}
        fields = [f"'{name}', {text_literal(value)}" for name, value in texts.items()]
        fields += [f"'{name}', {count}" for name, count in self.counts.items()]
        return f"named_struct({', '.join(fields)})"


def _sectors(*counts: Mapping[str, str]) -> list[GroupCounts]:
    return [GroupCounts(SECTOR, s, s.capitalize(), s, c) for s, c in zip(SECTORS, counts)]


@dataclass(frozen=True)
class PrefixLayout:
    """Counts coded as ``<prefix>_<category>`` (legal status and sex by prefix)."""

    total: tuple[str, ...]
    free: tuple[str, ...]
    enslaved: tuple[str, ...]
    male_free: tuple[str, ...]
    female_free: tuple[str, ...]
    male_enslaved: tuple[str, ...]
    female_enslaved: tuple[str, ...]
    population: Mapping[str, tuple[str, ...]]  # total / free / enslaved -> exact names
    literate: str
    broad: tuple[str, ...]
    not_working: tuple[str, ...]
    occupations: tuple[Group, ...]
    agriculture: tuple[str, ...]
    manufacturing: tuple[str, ...]

    @property
    def working(self) -> tuple[str, ...]:
        return tuple(p for p in self.broad if p not in self.not_working)

    @property
    def count_prefixes(self) -> tuple[str, ...]:
        every = (self.male_free, self.female_free, self.male_enslaved, self.female_enslaved,
                 self.free, self.enslaved, self.total)
        return tuple(p for prefixes in every for p in prefixes)

    def measures(self, names: Sequence[str], patterns: Sequence[str]) -> dict[str, str]:
        """The seven counts of one group of patterns."""
        by_measure = (self.total, self.free, self.enslaved, self.male_free,
                      self.female_free, self.male_enslaved, self.female_enslaved)
        return {m: matched_total(names, p, patterns) for m, p in zip(COUNTS, by_measure)}

    def context(self, names: Sequence[str]) -> dict[str, str]:
        working = self.measures(names, self.working)
        return {
            "pop_total": exact_total(names, self.population["total"]),
            "pop_free": exact_total(names, self.population["free"]),
            "pop_enslaved": exact_total(names, self.population["enslaved"]),
            "pop_literate": matched_total(names, self.total, [self.literate]),
            "occ_total": working["n_total"],
            "occ_free": working["n_free"],
            "occ_enslaved": working["n_enslaved"],
            "occ_male": f"{working['n_male_free']} + {working['n_male_enslaved']}",
            "occ_female": f"{working['n_female_free']} + {working['n_female_enslaved']}",
        }

    def occupation_groups(self, names: Sequence[str]) -> list[GroupCounts]:
        return [
            GroupCounts(OCCUPATION, g.id, g.label, g.sector, self.measures(names, g.patterns))
            for g in self.occupations
        ]

    def sector_groups(self, names: Sequence[str]) -> list[GroupCounts]:
        agriculture = self.measures(names, self.agriculture)
        manufacturing = self.measures(names, self.manufacturing)
        # The total and status residuals start from working groups, the sex
        # residuals from all broad groups; published figures depend on it.
        whole = self.measures(names, self.broad) | {
            "n_total": "occ_total",
            "n_free": "occ_free",
            "n_enslaved": "occ_enslaved",
        }
        services = {m: residual_sql(whole[m], agriculture[m], manufacturing[m]) for m in COUNTS}
        return _sectors(agriculture, manufacturing, services)


@dataclass(frozen=True)
class ExactLayout:
    """Counts in exactly named columns by sector and sex, without legal status."""

    population: str
    literate: str
    occupied: str
    occupied_male: str
    occupied_female: str
    agriculture: Mapping[str, tuple[str, ...]] = field(default_factory=dict)  # male / female
    manufacturing: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    def context(self, names: Sequence[str]) -> dict[str, str]:
        sources = {
            "pop_total": self.population, "pop_literate": self.literate, "occ_total": self.occupied,
            "occ_male": self.occupied_male, "occ_female": self.occupied_female,
        }
        return {name: f"cast({quoted(column)} as double)" for name, column in sources.items()}

    @staticmethod
    def measures(names: Sequence[str], by_sex: Mapping[str, Sequence[str]]) -> dict[str, str]:
        return {
            "n_total": exact_total(names, [*by_sex["male"], *by_sex["female"]]),
            "n_male": exact_total(names, by_sex["male"]),
            "n_female": exact_total(names, by_sex["female"]),
        }

    def sector_groups(self, names: Sequence[str]) -> list[GroupCounts]:
        agriculture = self.measures(names, self.agriculture)
        manufacturing = self.measures(names, self.manufacturing)
        whole = {"n_total": "occ_total", "n_male": "occ_male", "n_female": "occ_female"}
        services = {m: residual_sql(whole[m], agriculture[m], manufacturing[m]) for m in whole}
        return _sectors(agriculture, manufacturing, services)


Layout = PrefixLayout | ExactLayout


def denominators(df: DataFrame, layout: Layout) -> DataFrame:
    """Add population, literacy and occupation totals and the two rates."""
    context = layout.context(df.columns)
    base = df.selectExpr("*", *[f"{sql} AS {name}" for name, sql in context.items()])
    rates = {"literacy_rate_population": "pop_literate"}
    if isinstance(layout, PrefixLayout):
        rates["enslaved_rate_population"] = "pop_enslaved"
    return base.selectExpr("*", *[f"{ratio_sql(part, 'pop_total')} AS {name}" for name, part in rates.items()])


def layout_groups(names: Sequence[str], layout: Layout, kinds: Sequence[str]) -> list[GroupCounts]:
    groups: list[GroupCounts] = []
    if OCCUPATION in kinds and isinstance(layout, PrefixLayout):
        groups += layout.occupation_groups(names)
    if SECTOR in kinds:
        groups += layout.sector_groups(names)
    return groups


GAP = "cast(NULL as double)"


def _with_shares(panel: DataFrame, status: bool) -> DataFrame:
    if status:
        panel = panel.selectExpr("*", "n_male_free + n_male_enslaved AS n_male",
                                 "n_female_free + n_female_enslaved AS n_female")
        gaps: tuple[str, ...] = ()
    else:
        gaps = ("n_free", "n_enslaved", "pop_free", "pop_enslaved", "enslaved_rate_population",
                "occ_free", "occ_enslaved", "share_free_within_group", "share_enslaved_within_group")
    shares = {"share_of_all_occupations": ratio_sql("n_total", "occ_total")}
    for who in ("free", "enslaved", "male", "female"):
        if f"share_{who}_within_group" not in gaps:
            shares[f"share_{who}_within_group"] = ratio_sql(f"n_{who}", "n_total")
    # Literacy is not known per group in either census.
    gaps += ("n_literate_within_group", "share_literate_within_group")
    return panel.selectExpr(
        "*", *[f"{GAP} AS {name}" for name in gaps], *[f"{sql} AS {name}" for name, sql in shares.items()])


def group_panel(
    df: DataFrame, ids: Sequence[str], layout: Layout, kinds: Sequence[str] = (OCCUPATION, SECTOR)
) -> DataFrame:
    """Panel of all requested kinds of groups from one pass over the counts."""
    groups = layout_groups(df.columns, layout, kinds)
    base = denominators(df, layout)
    fanned = base.select(
        *[col(i) for i in ids],
        *[c for c in CONTEXT if c in base.columns],
        F.expr(f"inline(array({', '.join(g.as_struct() for g in groups)}))"),
    )
    return _with_shares(fanned, isinstance(layout, PrefixLayout))


def occupation_panel(df: DataFrame, ids: Sequence[str], layout: PrefixLayout) -> DataFrame:
    return group_panel(df, ids, layout, (OCCUPATION,))


def sector_panel(df: DataFrame, ids: Sequence[str], layout: Layout) -> DataFrame:
    return group_panel(df, ids, layout, (SECTOR,))


# Columns of the dashboard panel, in file order.
DASHBOARD = (
    "geography_level", "geography_id", "geography_name",
    "group_type", "group_id", "group_label", "sector",
    "n_total", "n_free", "n_enslaved", "n_male", "n_female",
    *CONTEXT,
    "share_of_all_occupations", "share_free_within_group", "share_enslaved_within_group",
    "share_male_within_group", "share_female_within_group",
    "n_literate_within_group", "share_literate_within_group",
)
# Shares that a dashboard shows as zero where they are missing.
STATUS_DEFAULTS = (
    "share_of_all_occupations", "share_free_within_group", "share_enslaved_within_group",
    "share_male_within_group", "share_female_within_group",
    "literacy_rate_population", "enslaved_rate_population",
)
# The same for layouts without legal status.
PLAIN_DEFAULTS = (
    "share_of_all_occupations", "share_male_within_group", "share_female_within_group",
    "literacy_rate_population",
)


@dataclass(frozen=True)
class Level:
    """How one geography level fills the common id and name columns."""

    name: str
    id: Column
    label: Column


def dashboard_panel(levels: Sequence[tuple[DataFrame, Level]], layout: Layout) -> DataFrame:
    """Stack levels into the fixed 30-column schema; undefined shares become 0.

    Layouts without legal status keep their status columns NULL.
    """
    tagged = [
        panel.withColumns({
            "geography_level": F.lit(level.name),
            "geography_id": level.id,
            "geography_name": level.label,
        }).select(*DASHBOARD)
        for panel, level in levels
    ]
    stacked = tagged[0]
    for other in tagged[1:]:
        stacked = stacked.unionByName(other)
    defaults = STATUS_DEFAULTS if isinstance(layout, PrefixLayout) else PLAIN_DEFAULTS
    return stacked.fillna(0.0, subset=list(defaults))


def empty_rows_dropped(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep rows where any of the columns is positive (missing counts as not)."""
    condition = F.lit(False)
    for name in columns:
        condition = condition | (col(name) > 0)
    return df.where(condition)

