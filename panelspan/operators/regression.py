"""Standardised regressions of change metrics on an exposure, from moments.

One shuffle reduces the data to a row of moments per (metric, group).  Group
fits, the pooled fit and the fixed-effects fit are closed forms over that
small table, so their cost does not depend on the size of the input.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspan.functions.guarded import ratio
from panelspan.functions.student_t import critical_value, two_sided_p

MIN_GROUP, MIN_POOLED = 5, 10
FIT_COLUMNS = ("coef", "se", "t_value", "p_value", "ci_lower", "ci_upper")


def pair_moments(df: DataFrame, exposure: str, outcomes: Sequence[str], group: str) -> DataFrame:
    """Moments per (y_metric, group) over rows where both values are known.

    The metrics fan out narrowly and are reduced map-side; sums of squares use
    Spark's mergeable central moments.  Sums of squares of a constant are set
    to exactly zero by comparing its extremes.
    """
    x, y = F.col("x"), F.col("y")
    long = (
        df.select(F.col(group).alias(group), F.col(exposure).alias("x"), *outcomes)
        .unpivot([group, "x"], list(outcomes), "y_metric", "y")
        .where(x.isNotNull() & y.isNotNull())
    )
    moments = long.groupBy("y_metric", group).agg(
        F.count("*").alias("n"),
        F.avg(x).alias("mx"), F.avg(y).alias("my"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"),
        F.min(x).alias("x_min"), F.max(x).alias("x_max"),
        F.min(y).alias("y_min"), F.max(y).alias("y_max"),
    )
    x_varies, y_varies = F.col("x_min") < F.col("x_max"), F.col("y_min") < F.col("y_max")
    return moments.withColumns({
        "sxx": F.when(x_varies, F.col("sxx")).otherwise(0.0),
        "syy": F.when(y_varies, F.col("syy")).otherwise(0.0),
        "sxy": F.when(x_varies & y_varies, F.col("sxy")).otherwise(0.0),
    })


def merged_moments(stored: Sequence[DataFrame], group: str) -> DataFrame:
    """Moments of all rows behind several moment tables, without those rows.

    Sums of squares add up with the squared distances of the parts' means from
    the common mean, which keeps their precision.  A constant is noticed by
    the extremes, as in ``pair_moments``.
    """
    every = reduce(DataFrame.unionByName, stored)
    n, both = F.col("n"), Window.partitionBy("y_metric", group)
    every = every.withColumns({
        f"g{v}": F.when(F.min(f"{v}_min").over(both) == F.max(f"{v}_max").over(both), F.col(f"m{v}"))
        .otherwise(F.sum(n * F.col(f"m{v}")).over(both) / F.sum(n).over(both)) for v in "xy"})
    dx, dy = F.col("mx") - F.col("gx"), F.col("my") - F.col("gy")
    return every.groupBy("y_metric", group).agg(
        F.sum(n).alias("n"), F.max("gx").alias("mx"), F.max("gy").alias("my"),
        F.sum(F.col("sxx") + n * dx * dx).alias("sxx"), F.sum(F.col("syy") + n * dy * dy).alias("syy"),
        F.sum(F.col("sxy") + n * dx * dy).alias("sxy"),
        F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"),
        F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"),
    )


def with_inference(fits: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Turn (coef, se, df) into t, p and a confidence interval.

    A perfect fit has se = 0: t is undefined and p is 0.
    """
    coef, se = F.col("coef"), F.col("se")
    staged = fits.withColumns({
        "t_value": F.when(se > 0, coef / se),
        "t_critical": critical_value("df", confidence),
    })
    return staged.withColumns({
        "p_value": F.when(se == 0, F.lit(0.0)).otherwise(two_sided_p("t_value", "df")),
        "ci_lower": coef - F.col("t_critical") * se,
        "ci_upper": coef + F.col("t_critical") * se,
    }).drop("t_critical", "df")


def _correlation_fit(n: Column, sxx: Column, syy: Column, sxy: Column) -> dict[str, Column]:
    """Slope of z-scores on z-scores: the correlation, with its standard error."""
    r = sxy / F.sqrt(sxx * syy)
    unexplained = F.greatest(1 - r * r, F.lit(0.0))
    return {"coef": r, "se": F.sqrt(unexplained / (n - 2)), "df": n - 2}


def group_fits(
    moments: DataFrame, group: str, minimum: int = MIN_GROUP, confidence: float = 0.95
) -> DataFrame:
    """One fit per (group, metric) with enough varying data."""
    n, sxx, syy, sxy = (F.col(c) for c in ("n", "sxx", "syy", "sxy"))
    usable = moments.where(
        F.col(group).isNotNull() & (n >= max(minimum, 3)) & (sxx > 0) & (syy > 0)
    )
    fits = usable.select(
        group, "y_metric", n.alias("n_amc"),
        *[c.alias(name) for name, c in _correlation_fit(n, sxx, syy, sxy).items()],
    )
    return with_inference(fits, confidence)


def combined_moments(moments: DataFrame, group: str) -> DataFrame:
    """Per metric: pooled moments (between and within groups) and within ones.

    Deviations are taken from the metric's grand mean rather than as a
    difference of large sums.  The mean comes from a window over the reduced
    rows, one per (metric, group), so the data behind them is read once.
    """
    known = moments.where(F.col(group).isNotNull())
    n, metric = F.col("n"), Window.partitionBy("y_metric")
    known = known.withColumns({
        "gx": F.sum(n * F.col("mx")).over(metric) / F.sum(n).over(metric),
        "gy": F.sum(n * F.col("my")).over(metric) / F.sum(n).over(metric),
    })
    dx, dy = F.col("mx") - F.col("gx"), F.col("my") - F.col("gy")
    totals = known.groupBy("y_metric").agg(
        F.sum(n).alias("n"), F.count("*").alias("groups"),
        F.sum("sxx").alias("wxx"), F.sum("syy").alias("wyy"), F.sum("sxy").alias("wxy"),
        F.sum(F.col("sxx") + n * dx * dx).alias("sxx"),
        F.sum(F.col("syy") + n * dy * dy).alias("syy"),
        F.sum(F.col("sxy") + n * dx * dy).alias("sxy"),
        F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"),
        F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"),
    )
    return totals.withColumns({
        "x_varies": F.col("x_min") < F.col("x_max"),
        "y_varies": F.col("y_min") < F.col("y_max"),
    })


POOLED, FIXED_EFFECTS = "pooled", "state_fe"


def national_fits(
    moments: DataFrame,
    group: str,
    minimum: int = MIN_POOLED,
    confidence: float = 0.95,
    models: Sequence[str] = (POOLED, FIXED_EFFECTS),
) -> DataFrame:
    """Pooled and fixed-effects fits of globally standardised values."""
    c = {name: F.col(name) for name in
         ("n", "groups", "wxx", "wyy", "wxy", "sxx", "syy", "sxy")}
    usable = combined_moments(moments, group).where(
        (c["n"] >= max(minimum, 3)) & F.col("x_varies") & F.col("y_varies")
    )
    rescale = F.sqrt(c["sxx"] / c["syy"])
    df = c["n"] - c["groups"] - 1
    # Exposure constant within every group: the effect is not identified, NULL.
    slope = ratio(c["wxy"], c["wxx"])
    left_over = F.greatest(c["wyy"] - c["wxy"] * slope, F.lit(0.0))
    within = {
        "coef": slope * rescale,
        "se": F.sqrt(ratio(ratio(left_over, df), c["wxx"])) * rescale,
        "df": df,
    }
    fits = {POOLED: _correlation_fit(c["n"], c["sxx"], c["syy"], c["sxy"]), FIXED_EFFECTS: within}
    rows = [
        F.struct(F.lit(model).alias("model"), *[
            value.cast("double").alias(name) for name, value in fits[model].items()
        ])
        for model in models
    ]
    stacked = usable.select("y_metric", c["n"].alias("n_obs"), F.inline(F.array(*rows)))
    return with_inference(stacked, confidence)


def forest_table(
    fits: DataFrame, within: Sequence[str], label: Column | None = None, level: float = 0.05
) -> DataFrame:
    """Significance flag, optional label and rank by coefficient.

    The window sorts *result* rows (one per fitted group), never data rows,
    all groups of a metric in one task.
    """
    order = Window.partitionBy(*within).orderBy(F.col("coef").asc_nulls_last(), *fits.columns[:2])
    out = fits.withColumns({
        "significant": F.col("p_value") < level,
        "position": F.row_number().over(order),
    })
    return out if label is None else out.withColumn("label", label)


def fitted_band(
    df: DataFrame, exposure: str, outcome: str, points: int = 80, confidence: float = 0.95
) -> DataFrame:
    """Straight-line fit with its confidence band at evenly spaced x values."""
    x, y = F.col(exposure), F.col(outcome)
    both = df.where(x.isNotNull() & y.isNotNull())
    m = both.agg(
        F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"),
        F.min(x).alias("low"), F.max(x).alias("high"),
    ).where((F.col("n") > 2) & (F.col("low") < F.col("high")))
    slope = F.col("sxy") / F.col("sxx")
    spread = F.greatest(F.col("syy") - F.col("sxy") * slope, F.lit(0.0)) / (F.col("n") - 2)
    line = m.withColumns({
        "slope": slope, "sigma": F.sqrt(spread),
        "t_critical": critical_value("(n - 2)", confidence),
        "step": (F.col("high") - F.col("low")) / (points - 1),
    }).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("low") + F.col("step") * F.col("point")
    off = at - F.col("mx")
    fit = F.col("my") + F.col("slope") * off
    se = F.col("sigma") * F.sqrt(1 / F.col("n") + off * off / F.col("sxx"))
    half = F.col("t_critical") * se
    return line.select(
        "point", at.alias("x"), fit.alias("fit"), se.alias("se"),
        (fit - half).alias("lower"), (fit + half).alias("upper"),
    )


def standardised(df: DataFrame, columns: Sequence[str], group: str | None = None,
                 suffix: str = "_std") -> DataFrame:
    """Add z-scores (sample deviation) of columns, overall or per group.

    Moments are aggregated and joined back, so a hot group is never sorted in
    one task; AQE splits it if the join has to shuffle.  A constant column
    gives NULL.
    """
    stats = [
        part for c in columns for part in (
            F.avg(c).alias(f"_mean_{c}"),
            F.when(F.min(c) < F.max(c), F.stddev_samp(c)).alias(f"_sd_{c}"),
        )
    ]
    if group is None:
        one_row = df.agg(F.struct(*stats).alias("s")).scalar()
        joined = df.withColumn("_s", one_row)
        source = {name: F.col(f"_s.{name}") for c in columns for name in (f"_mean_{c}", f"_sd_{c}")}
        dropped = ["_s"]
    else:
        table = df.groupBy(group).agg(*stats).withColumnRenamed(group, "_group")
        joined = df.join(table, F.col(group).eqNullSafe(F.col("_group")), "left")
        source = {name: F.col(name) for name in table.columns if name != "_group"}
        dropped = list(table.columns)
    scored = joined.withColumns({
        f"{c}{suffix}": ratio(F.col(c) - source[f"_mean_{c}"], source[f"_sd_{c}"])
        for c in columns
    })
    return scored.drop(*dropped)


def metric_labels(labels: Mapping[str, str], key: str = "y_metric") -> Column:
    """Label lookup over a small fixed registry, as a literal map."""
    pairs = [F.lit(part) for item in labels.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), F.col(key))
