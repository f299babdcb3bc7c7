"""Classify count columns by the way they are named.

Only names are looked at, on the driver; the result is a list of columns that
goes into ordinary expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspan.functions.guarded import row_total, row_total_sql
from panelspan.functions.text import fold_name, folded


class NoMatchingColumn(ValueError):
    """A strict lookup found no column."""


def with_prefix(names: Iterable[str], prefixes: Iterable[str]) -> list[str]:
    """Columns whose folded name starts with one of the prefixes and ``_``."""
    heads = tuple(fold_name(p) + "_" for p in prefixes)
    return [n for n in names if fold_name(n).startswith(heads)]


def matching(
    names: Sequence[str], prefixes: Iterable[str], patterns: Iterable[str], strict: bool = False
) -> list[str]:
    """Columns with one of the prefixes that contain any of the patterns.

    Patterns are plain fragments that may sit anywhere in the folded name, so
    a short one can hit several columns: see :func:`match_report`.
    """
    wanted = [fold_name(p) for p in patterns]
    found = [n for n in with_prefix(names, prefixes) if any(w in fold_name(n) for w in wanted)]
    if strict and not found:
        raise NoMatchingColumn(f"no column for prefixes {list(prefixes)} and patterns {wanted}")
    return found


def match_report(
    names: Sequence[str], prefixes: Iterable[str], patterns: Iterable[str]
) -> dict[str, list[str]]:
    """Columns hit by each single pattern, to spot misses and double hits."""
    heads = tuple(prefixes)
    return {p: matching(names, heads, [p]) for p in patterns}


def present(names: Iterable[str], wanted: Iterable[str]) -> list[str]:
    """Exact raw names that exist, each once; absent ones are ignored."""
    have = set(names)
    return [w for w in dict.fromkeys(wanted) if w in have]


def starting_with(names: Iterable[str], stems: Iterable[str]) -> list[str]:
    """Columns whose raw name starts with one of the stems."""
    heads = tuple(stems)
    return [n for n in names if n.startswith(heads)]


def matched_total(names: Sequence[str], prefixes: Iterable[str], patterns: Iterable[str]) -> str:
    """SQL sum over the matching columns."""
    return row_total_sql(matching(names, prefixes, patterns))


def exact_total(names: Sequence[str], wanted: Iterable[str]) -> str:
    """SQL sum over exactly named columns."""
    return row_total_sql(present(names, wanted))


def non_empty(df: DataFrame, prefix: str) -> DataFrame:
    """Keep rows whose columns under a prefix sum to more than zero (any case).

    Apply it where the columns are read, not above a projection that computes
    them: the optimizer infers constraints from the sum, and their number grows
    quickly with aliases of its terms.
    """
    stem = prefix.lower()
    return df.where(row_total([c for c in df.columns if c.lower().startswith(stem)]) > 0)


def classify_values(
    df: DataFrame, column: str, dictionary: Mapping[str, Sequence[str]], out: str = "group_id"
) -> DataFrame:
    """The same matching on data values: one row per group a value belongs to.

    The dictionary is small configuration, so it becomes literals in a narrow
    expression: no join and no shuffle.  Rows that match no group are dropped.
    """
    value = folded(F.col(column))

    def hit(patterns: Sequence[str]) -> Column:
        literal = "|".join(re.escape(fold_name(p)) for p in patterns)
        return value.rlike(literal)

    hits = F.array(*[F.when(hit(patterns), F.lit(group)) for group, patterns in dictionary.items()])
    return df.withColumn(out, F.explode(F.array_compact(hits)))
