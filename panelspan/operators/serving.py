"""Views over the built panels: slices, metric views, top tables, comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspan.functions.text import count_text, percent_text, plain_text
from panelspan.operators.quantiles import QUARTILE_LABELS, QUARTILES, quantile_bins
from panelspan.operators.ranking import Ranked


@dataclass(frozen=True)
class Metric:
    """A selectable metric of a panel or of the comparison."""

    column: str
    label: str
    numerator: str | None = None
    denominator: str | None = None
    numerator_label: str | None = None
    denominator_label: str | None = None
    is_pct: bool = True
    diverging: bool = False


class UnknownMetric(KeyError):
    """The metric is not registered or the panel has no such column."""


def registered(registry: Mapping[str, Metric], name: str, df: DataFrame | None = None) -> Metric:
    if name not in registry:
        raise UnknownMetric(name)
    metric = registry[name]
    if df is not None:
        needed = [c for c in (metric.column, metric.numerator, metric.denominator) if c]
        missing = [c for c in needed if c not in df.columns]
        if missing:
            raise UnknownMetric(f"{name}: panel lacks {missing}")
    return metric


def panel_slice(
    panel: DataFrame, level: str, group_id: str | None = None, group_type: str | None = None
) -> DataFrame:
    """Equality filters; on a stored panel they prune folders and row groups."""
    wanted = {"geography_level": level, "group_type": group_type, "group_id": group_id}
    for name, value in wanted.items():
        if value is not None:
            panel = panel.where(F.col(name) == value)
    return panel


def slice_batch(panel: DataFrame, selections: DataFrame, name: str = "selection") -> DataFrame:
    """Rows of many slices at once, each with its selection's name.

    ``selections`` has ``name`` and the slice columns; level and type are
    required, a NULL group_id takes every group; unnamed selections are left out.  Both required columns are
    folders of the store: the join prunes them at run time by what the
    selections ask for.  Selections carry no hint: their measured size decides.
    """
    # naming the selections also tells the optimizer that they are few, which is what lets it prune folders by them
    have, want = panel.alias("have"), selections.where(F.col(name) > "").alias("want")
    same = (F.col("have.geography_level") == F.col("want.geography_level")) & (F.col("have.group_type") == F.col("want.group_type")) \
        & (F.col("want.group_id").isNull() | (F.col("have.group_id") == F.col("want.group_id")))
    return have.join(want, same).select(F.col(f"want.{name}").alias(name), "have.*")


def group_choices(panel: DataFrame, level: str, group_type: str | None = None) -> DataFrame:
    rows = panel_slice(panel, level, group_type=group_type)
    return rows.select("group_id", "group_label").distinct().orderBy("group_label", "group_id")


def on_map(rows: DataFrame, shapes: DataFrame, row_key: str, shape_key: str) -> DataFrame:
    """Inner join to the drawable geographies; rows without one disappear."""
    return shapes.join(rows, shapes[shape_key] == rows[row_key])


def metric_view(rows: DataFrame, metric: Metric) -> DataFrame:
    """Project the chosen metric into common columns."""
    added: dict[str, Column] = {
        "map_value": F.col(metric.column),
        "metric_label": F.lit(metric.label),
        "is_diverging": F.lit(metric.diverging),
        "is_pct": F.lit(metric.is_pct),
    }
    if metric.numerator and metric.denominator:
        added |= {
            "numerator": F.col(metric.numerator),
            "denominator": F.col(metric.denominator),
            "num_label": F.lit(metric.numerator_label),
            "den_label": F.lit(metric.denominator_label),
        }
    return rows.withColumns(added)


TOP = 15


def top_rows(view: DataFrame, tie_break: str, n: int = TOP, drop_missing: bool = False) -> DataFrame:
    """The n highest values; the report's own limit, taken without a full sort."""
    if drop_missing:
        view = view.where(F.col("map_value").isNotNull())
    return view.orderBy(F.col("map_value").desc_nulls_last(), F.col(tie_break)).limit(n)


def panel_top_table(view: DataFrame, name: str, tie_break: str, n: int = TOP, headings: Metric | None = None) -> DataFrame:
    """Formatted top table of a panel metric; ``headings`` names the count columns by that metric's labels."""
    above = headings.numerator_label if headings else "numerator"
    below = headings.denominator_label if headings else "denominator"
    return top_rows(view, tie_break, n).select(
        F.col(name).alias("geography"), percent_text(F.col("map_value")).alias("metric"),
        count_text(F.col("numerator")).alias(above), count_text(F.col("denominator")).alias(below),
    )


def regression_map(fits: DataFrame, shapes: DataFrame, outcome: str, row_key: str = "state_code", shape_key: str = "code") -> DataFrame:
    """Fits of one outcome for the drawable states, as a diverging view of their coefficients."""
    chosen = fits.where(F.col("y_metric") == outcome)
    return on_map(chosen, shapes, row_key, shape_key).withColumns({"map_value": F.col("coef"), "is_diverging": F.lit(True)})


def change_top_table(view: DataFrame, name: str, metric: Metric, n: int = TOP) -> DataFrame:
    """Formatted top table of a comparison metric; missing values are left out."""
    shown = percent_text if metric.is_pct else plain_text
    return top_rows(view, name, n, drop_missing=True).select(
        F.col(name).cast("string").alias("unit"), shown(F.col("map_value")).alias("metric")
    )


def metric_domain(view: DataFrame) -> DataFrame:
    """Value range for a scale; symmetric around zero for diverging metrics."""
    value = F.col("map_value")
    found = view.agg(
        F.max(F.abs(value)).alias("reach"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.coalesce(F.bool_or("is_diverging"), F.lit(False)).alias("diverging"),
    )
    diverging = F.col("diverging")
    return found.select(
        "diverging",
        F.when(diverging, -F.col("reach")).otherwise(F.col("low")).alias("low"),
        F.when(diverging, F.col("reach")).otherwise(F.col("high")).alias("high"),
    )


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def scatter_data(
    panel: DataFrame, exposure: str, outcome: str, names: DataFrame, key: str = "state_code",
    carried: Sequence[str] = ("code_amc",),
) -> DataFrame:
    """Complete (x, y) pairs with the group's name where one is known."""
    points = complete_cases(panel, [exposure, outcome]).select(
        *carried, key, F.col(exposure).alias("x"), F.col(outcome).alias("y")
    )
    return points.join(names.select(key, "state_name"), key, "left")


def names_from_fits(fits: DataFrame, outcome: str, key: str = "state_code") -> DataFrame:
    """Names of the groups that got a fit for this outcome."""
    return fits.where(F.col("y_metric") == outcome).select(key, "state_name")


@dataclass(frozen=True)
class Contrast:
    """A panel of the quartile comparison: label and column per sector."""

    label: str
    columns: Mapping[str, str]


def quartile_comparison(
    panel: DataFrame, exposure: str, required: Sequence[str], contrasts: Sequence[Contrast],
    labels: Sequence[str] = QUARTILE_LABELS,
) -> DataFrame:
    """Mean of each sector column per exposure bin, with the bin's row count.

    The panel is evaluated once, into rows stored in the exposure's order;
    breaks are rows at known ranks of it.  One grouped aggregation over the
    stored rows produces all means, which are then unpivoted from the few
    result rows.
    """
    wanted = dict.fromkeys([exposure, *(c for contrast in contrasts for c in contrast.columns.values())])
    ranked = Ranked(complete_cases(panel, [exposure, *required]).select(*wanted), exposure)
    breaks = panel.sparkSession.createDataFrame([ranked.quantiles(QUARTILES)], "n long, quantiles array<double>")
    binned = quantile_bins(ranked.rows, exposure, breaks, labels)
    means = binned.groupBy("quartile").agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"{i}_{sector}")
          for i, contrast in enumerate(contrasts) for sector, c in contrast.columns.items()],
    )
    cells = [
        F.struct(F.lit(contrast.label).alias("panel"), F.lit(sector).alias("sector"), F.col(f"{i}_{sector}").alias("mean_share"))
        for i, contrast in enumerate(contrasts) for sector in contrast.columns
    ]
    return means.select("quartile", "n", F.inline(F.array(*cells))).select("quartile", "n", "sector", "mean_share", "panel")
