"""Compare two periods: sector accounts per period, then change metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspan.functions.guarded import (
    absolute_shift,
    compound_growth,
    log_growth,
    log_ratio,
    logit_shift,
    ratio,
    ratio_sql,
    residual_sql,
)
from panelspan.operators.panels import ExactLayout, Layout

BEFORE, AFTER, YEARS = "1872", "1920", 48

# Variables each layout hands over to the comparison, without the suffix.
STATUS_VARIABLES = (
    "pop_total", "pop_enslaved", "pop_literate",
    "occ_total", "agr_total", "mfg_total", "serv_total",
    "enslaved_share", "enslaved_mfg_share", "enslaved_agr_share",
    "mfg_share", "agr_share", "serv_share", "non_agr_share", "literacy_rate",
)
PLAIN_VARIABLES = (
    "pop_total", "pop_literate", "occ_total", "agr_total", "mfg_total", "serv_total",
    "mfg_share", "agr_share", "serv_share", "non_agr_share",
    "mfg_agr_ratio", "literacy_rate", "mfg_percapita",
)
# The eleven outcomes, in the published order.
OUTCOMES = (
    "mfg_share_change_pp", "mfg_share_log_ratio", "mfg_share_cagr", "mfg_share_logit_change",
    "non_agr_share_change_pp", "mfg_agr_ratio_change", "structural_change_index",
    "agr_exit_share", "serv_share_change_pp", "literacy_rate_change_pp", "pop_growth_rate",
)


def _levels(names: Sequence[str], layout: Layout) -> dict[str, str]:
    context = layout.context(names)
    agriculture = layout.measures(names, layout.agriculture)
    manufacturing = layout.measures(names, layout.manufacturing)
    levels = {
        "pop_total": context["pop_total"],
        "pop_literate": context["pop_literate"],
        "occ_total": context["occ_total"],
        "agr_total": agriculture["n_total"],
        "mfg_total": manufacturing["n_total"],
    }
    if not isinstance(layout, ExactLayout):
        levels |= {
            "pop_enslaved": context["pop_enslaved"],
            "agr_enslaved": agriculture["n_enslaved"],
            "mfg_enslaved": manufacturing["n_enslaved"],
        }
    return levels


def sector_accounts(df: DataFrame, key: str, layout: Layout, period: str) -> DataFrame:
    """Key plus the period's variables, each with the period as suffix."""
    levels = df.selectExpr(key, *[f"{sql} AS {n}" for n, sql in _levels(df.columns, layout).items()])
    services = residual_sql("occ_total", "agr_total", "mfg_total")
    levels = levels.selectExpr("*", f"{services} AS serv_total")
    derived = {
        "mfg_share": ratio_sql("mfg_total", "occ_total"),
        "agr_share": ratio_sql("agr_total", "occ_total"),
        "serv_share": ratio_sql("serv_total", "occ_total"),
        # A missing agriculture share counts as fully agricultural.
        "non_agr_share": f"1 - coalesce({ratio_sql('agr_total', 'occ_total')}, 1D)",
        "literacy_rate": ratio_sql("pop_literate", "pop_total"),
    }
    if isinstance(layout, ExactLayout):
        kept = PLAIN_VARIABLES
        derived |= {
            "mfg_agr_ratio": ratio_sql("mfg_total", "agr_total"),
            "mfg_percapita": ratio_sql("mfg_total", "pop_total"),
        }
    else:
        kept = STATUS_VARIABLES
        derived |= {
            "enslaved_share": ratio_sql("pop_enslaved", "pop_total"),
            "enslaved_mfg_share": ratio_sql("mfg_enslaved", "mfg_total"),
            "enslaved_agr_share": ratio_sql("agr_enslaved", "agr_total"),
        }
    values = {name: derived.get(name, name) for name in kept}
    return levels.selectExpr(key, *[f"{sql} AS {name}_{period}" for name, sql in values.items()])


def change_metrics(
    df: DataFrame, before: str = BEFORE, after: str = AFTER, years: float = YEARS
) -> DataFrame:
    """Add the eleven outcomes and the baseline manufacturing/agriculture ratio."""
    def pair(name: str) -> tuple[Column, Column]:
        return F.col(f"{name}_{before}"), F.col(f"{name}_{after}")

    def difference(name: str) -> Column:
        old, new = pair(name)
        return new - old

    baseline_ratio = f"mfg_agr_ratio_{before}"
    agr_before, agr_after = pair("agr_share")
    metrics = {
        "mfg_share_change_pp": difference("mfg_share"),
        "mfg_share_log_ratio": log_ratio(*pair("mfg_share")),
        "mfg_share_cagr": compound_growth(*pair("mfg_share"), years),
        "mfg_share_logit_change": logit_shift(*pair("mfg_share")),
        "non_agr_share_change_pp": difference("non_agr_share"),
        "structural_change_index": absolute_shift(
            [pair("mfg_share"), pair("agr_share"), pair("serv_share")]
        ),
        "agr_exit_share": agr_before - agr_after,
        "serv_share_change_pp": difference("serv_share"),
        "literacy_rate_change_pp": difference("literacy_rate"),
        "pop_growth_rate": log_growth(*pair("pop_total"), years),
        baseline_ratio: ratio(F.col(f"mfg_total_{before}"), F.col(f"agr_total_{before}")),
    }
    return df.withColumns(metrics).withColumn("mfg_agr_ratio_change", difference("mfg_agr_ratio"))


def join_periods(
    first: DataFrame, second: DataFrame, key: str, missing_key_matches: bool = False
) -> DataFrame:
    """Inner join of two period tables on their common key.

    Both sides come out of a grouped sum on the key, so the plain join reuses
    that partitioning.  ``missing_key_matches`` pairs the two NULL keys too.
    """
    if not missing_key_matches:
        return first.join(second, key)
    left, right = first.alias("left"), second.alias("right")
    same = F.col(f"left.{key}").eqNullSafe(F.col(f"right.{key}"))
    other = [F.col(f"right.{c}") for c in second.columns if c != key]
    return left.join(right, same).select("left.*", *other)


def two_period_panel(
    first: tuple[DataFrame, Layout, str],
    second: tuple[DataFrame, Layout, str],
    key: str,
    years: float = YEARS,
    missing_key_matches: bool = False,
) -> DataFrame:
    """Accounts of both periods side by side with all change metrics.

    Each period is (counts already summed per key, layout, suffix).
    """
    (a, layout_a, before), (b, layout_b, after) = first, second
    joined = join_periods(
        sector_accounts(a, key, layout_a, before),
        sector_accounts(b, key, layout_b, after),
        key, missing_key_matches,
    )
    return change_metrics(joined, before, after, years)
