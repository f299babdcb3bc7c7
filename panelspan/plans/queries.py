"""Registered queries: each operator on the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspan.functions.guarded import quoted
from panelspan.functions.text import folded, id_code
from panelspan.operators import compare, crosswalk as xw, dictionary, naming, panels, quantiles, regression, reshape, rollup, serving, sketches
from panelspan.operators.quality import FlowQuality
from panelspan.plans import census, driver_tables as b
from panelspan.sources import export, store
from panelspan.sources.stage import fresh_path, written
from panelspan.sources.tables import read_table

DIGITS = 6
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def tidy(df: DataFrame) -> DataFrame:
    """Round fractions for comparison; summation order moves their last bits.

    Plain arithmetic, half away from zero: ``round`` on doubles goes through
    decimals.  Adding zero turns a negative zero into zero.
    """
    def shown(f: T.StructField) -> str:
        name = quoted(f.name)
        if not isinstance(f.dataType, T.DoubleType):
            return name
        near = f"signum({name}) * floor(abs({name}) * 1e{DIGITS} + 0.5D) / 1e{DIGITS}"
        # from 1e9 on a double has no more than seven decimals; it keeps its value
        return f"if(abs({name}) < 1e9, {near}, {name}) + 0D AS {name}"

    return df.selectExpr(*[shown(f) for f in df.schema.fields])


# ---- counts and panels -----------------------------------------------------

@query
def wide_counts(spark, sf):
    return tidy(naming.non_empty(b.order_counts(spark, sf), "soma_g_"))


CONTEXT_ONLY = ("muni_id", *panels.CONTEXT)


@query
def denominators(spark, sf):
    return tidy(panels.denominators(b.order_counts(spark, sf), b.ORDER_LAYOUT).select(*CONTEXT_ONLY))


@query
def denominators_exact(spark, sf):
    df = panels.denominators(b.line_counts(spark, sf), b.LINE_LAYOUT)
    return tidy(df.select(*[c for c in CONTEXT_ONLY if c in df.columns]))


@query
def occupation_panel(spark, sf):
    return tidy(panels.occupation_panel(b.order_counts(spark, sf), ["muni_id"], b.ORDER_LAYOUT))


@query
def sector_panel(spark, sf):
    return tidy(panels.sector_panel(b.order_counts(spark, sf), ["muni_id"], b.ORDER_LAYOUT))


@query
def sector_panel_exact(spark, sf):
    return tidy(panels.sector_panel(b.line_counts(spark, sf), ["muni_id"], b.LINE_LAYOUT))


@query
def parent_rollup(spark, sf):
    located = b.located_orders(spark, sf)
    return tidy(rollup.rollup(located, list(b.STATE_IDS), b.count_columns(located, b.ORDER_LAYOUT)))


@query
def prefix_rollup(spark, sf):
    counts = b.order_counts(spark, sf)
    return tidy(rollup.rollup_by_prefix(counts, "muni_id", b.count_columns(counts, b.ORDER_LAYOUT)))


@query
def dashboard_panel(spark, sf):
    return tidy(b.order_dashboard(spark, sf))


@query
def dashboard_panel_exact(spark, sf):
    return tidy(b.line_dashboard(spark, sf))


PANEL_KEYS = ("geography_level", "geography_id", "group_type", "group_id")


@query
def national_share(spark, sf):
    shares = rollup.STATUS_SHARES
    return tidy(b.order_panel(spark, sf).select(
        *PANEL_KEYS, *[f"{m}_national" for m in shares.values()], *shares))


@query
def national_share_exact(spark, sf):
    shares = rollup.PLAIN_SHARES
    return tidy(b.line_panel(spark, sf).select(
        *PANEL_KEYS, *[f"{m}_national" for m in shares.values()], *shares))


@query
def sector_wide(spark, sf):
    panel = panels.sector_panel(b.order_counts(spark, sf), ["muni_id"], b.ORDER_LAYOUT)
    return tidy(reshape.pivot_panel(panel, ["muni_id"], panels.SECTORS))


@query
def sector_wide_exact(spark, sf):
    panel = panels.sector_panel(b.line_counts(spark, sf), ["muni_id"], b.LINE_LAYOUT)
    return tidy(reshape.pivot_panel(panel, ["muni_id"], panels.SECTORS, reshape.WIDE_PLAIN))


@query
def occupation_wide(spark, sf):
    return tidy(reshape.wide_panel(
        b.order_counts(spark, sf), ["muni_id"], b.ORDER_LAYOUT, (panels.OCCUPATION,)))


@query
def occupation_panel_full(spark, sf):
    """All 38 groups in seven prefixes, as wide as the first census."""
    return tidy(panels.occupation_panel(b.full_counts(spark, sf), ["muni_id"], b.FULL_LAYOUT))


@query
def occupation_wide_full(spark, sf):
    return tidy(reshape.wide_panel(b.full_counts(spark, sf), ["muni_id"], b.FULL_LAYOUT, (panels.OCCUPATION,)))


# ---- names -----------------------------------------------------------------

@query
def normalised_names(spark, sf):
    return read_table(spark, sf, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("doc_code"), folded(F.col("text")).alias("folded"))


# Groups of part types by fragments of their names; one type may be in two.
TYPE_GROUPS = {"sized": ("small", "medium", "large"), "priced": ("econo", "promo"), "regular": ("standard", "med")}


@query
def category_groups(spark, sf):
    """Pattern groups on data values, summed over the long fact."""
    lines = read_table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_quantity")
    # One row per (part, flag) before the join, so no part is hot in it.
    per_part = lines.groupBy("l_partkey", "l_returnflag").agg(F.sum("l_quantity").alias("quantity"))
    parts = naming.classify_values(
        read_table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", TYPE_GROUPS)
    joined = per_part.join(parts, per_part["l_partkey"] == parts["p_partkey"])
    return tidy(joined.groupBy("l_returnflag", "group_id").agg(F.sum("quantity").alias("n_total")))


@query
def category_dictionary(spark, sf):
    """Parts per word or brand that their description contains; the patterns are a table."""
    parts = read_table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("description"))
    names = read_table(spark, sf, "part", columns=["p_name", "p_brand"])
    patterns = names.select(F.explode(F.split("p_name", " ")).alias("pattern")).union(names.select("p_brand"))
    found = dictionary.contained(parts, "description", patterns, "pattern")
    per_value = parts.groupBy(F.col("description").alias("value")).agg(F.count("*").alias("parts"))
    return found.join(per_value, "value").groupBy("pattern").agg(F.sum("parts").alias("parts"), F.count("*").alias("descriptions"))


@query
def state_lookup(spark, sf):
    """Fixed state table joined to the customers' nations, unmatched kept."""
    states = census.states(spark, 1872)
    per_nation = read_table(spark, sf, "customer").groupBy(
        F.col("c_nationkey").alias("code_state")).agg(F.count("*").alias("customers"))
    return per_nation.join(F.broadcast(states), "code_state", "left")  # fixed 21 rows


# ---- crosswalk -------------------------------------------------------------

@query
def geography_match(spark, sf):
    """Customers against places known from orders: who is missing where."""
    known = b.order_counts(spark, sf).select("muni_id", "soma_g_almas")
    matched, lost = xw.attach_geography(b.customers(spark, sf), known, "muni_id", required="soma_g_almas")
    sides = [df.groupBy("name_state").agg(F.count("*").alias("n")).withColumn("side", F.lit(side))
             for side, df in (("matched", matched), ("unmatched", lost))]
    return reshape.stack(sides)


@query
def crosswalk_explode(spark, sf):
    return xw.explode_crosswalk(b.crosswalk_lists(spark, sf))


@query
def crosswalk_rollup(spark, sf):
    counts = b.order_counts(spark, sf)
    crosswalk = xw.explode_crosswalk(b.crosswalk_lists(spark, sf))
    return tidy(rollup.rollup_by_crosswalk(
        counts, "muni_id", crosswalk, b.count_columns(counts, b.ORDER_LAYOUT)))


@query
def crosswalk_cache(spark, sf):
    """The exploded crosswalk of a configuration: built by the first call, read by the second."""
    folder, settings = fresh_path(spark, "crosswalk-cache"), {"start": 1872, "end": 1920}
    census.area_crosswalk(spark, folder, lambda: b.crosswalk_lists(spark, sf), **settings)
    return census.area_crosswalk(spark, folder, lambda: b.crosswalk_lists(spark, sf).limit(0), **settings)


@query
def flow_quality(spark, sf):
    """What the jobs of the comparison flow counted on their way; a quarter of the customers has no area."""
    quality = FlowQuality()
    panel = b.area_panel(spark, sf, quality, "c_custkey % 4 <> 3")
    panel = written(quality.watch(panel, "areas", without_state=F.col("state_code").isNull()), "areas")
    moments = regression.pair_moments(panel, b.EXPOSURE, compare.OUTCOMES, "state_code")
    by_state = quality.watch(regression.group_fits(moments, "state_code"), "state models", significant=F.col("p_value") < 0.05)
    written(by_state, "state-models")
    written(quality.watch(regression.national_fits(moments, "state_code"), "national models"), "national-models")
    return quality.report(spark)


@query
def distinct_rollup(spark, sf):
    """Distinct parts sold per nation, region and in all, exactly, and whether merged sketches come close."""
    lines = read_table(spark, sf, "lineitem", columns=["l_partkey", "l_suppkey"]).distinct()
    nations = read_table(spark, sf, "nation", columns=["n_nationkey", "n_regionkey"])
    placed = lines.join(read_table(spark, sf, "supplier", columns=["s_suppkey", "s_nationkey"]), F.col("l_suppkey") == F.col("s_suppkey")) \
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    finest = written(sketches.distinct_sketches(placed, ["n_nationkey", "n_regionkey"], "l_partkey"), "sketches")
    keys = {"nation": F.col("n_nationkey").cast("string"), "region": F.col("n_regionkey").cast("string"), "all": F.lit("all")}
    exact = placed.select("l_partkey", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), c.alias("id")) for k, c in keys.items()])).alias("at")) \
        .groupBy("at.level", "at.id").agg(F.count_distinct("l_partkey").alias("parts"))
    merged = reshape.stack([
        sketches.estimated(sketches.merged_sketches(finest, [F.lit(k).alias("level"), c.alias("id")])) for k, c in keys.items()])
    near = F.abs(F.col("estimate") - F.col("parts")) <= F.greatest(F.col("parts") * sketches.error_bound(), F.lit(1))
    return exact.join(merged, ["level", "id"]).select("level", "id", "parts", near.alias("estimate_is_near"))


def _label_crosswalk(spark, sf):
    return read_table(spark, sf, "labels").select(
        F.col("quality").alias("code_amc"), F.col("doc_id").alias("muni_code"))


@query
def unmatched(spark, sf):
    """Documents no label covers, as municipalities without an area."""
    documents = read_table(spark, sf, "documents", columns=["doc_id", "lang", "source"])
    return xw.unmatched(documents, "doc_id", _label_crosswalk(spark, sf)).drop("muni_code")


@query
def quality_report(spark, sf):
    return xw.quality_report(
        [("documents", read_table(spark, sf, "documents"), "doc_id"),
         ("customers", read_table(spark, sf, "customer"), "c_custkey")],
        _label_crosswalk(spark, sf),
        [("areas", b.area_panel(spark, sf))],
    )


@query
def crosswalk_stats(spark, sf):
    return xw.crosswalk_summary(b.area_crosswalk(read_table(spark, sf, "customer")))


@query
def majority_state(spark, sf):
    return b.majority_states(read_table(spark, sf, "customer"))


# ---- comparison ------------------------------------------------------------

@query
def two_period_panel(spark, sf):
    return tidy(b.area_panel(spark, sf))


@query
def state_two_period(spark, sf):
    return tidy(b.prefix_panel(spark, sf))


@query
def missing_keys(spark, sf):
    """Two periods with a missing key in both, and names that fall back to the code where the lookup has none."""
    named = b.state_names(spark, sf).where("state_code % 4 <> 1")
    panel = b.keyed_periods(spark, sf).join(named, "state_code", "left")
    name = F.coalesce("state_name", F.concat(F.lit("Unit "), F.col("state_code")), F.lit("Unknown"))
    return tidy(panel.select("state_code", name.alias("geography_name"), f"pop_total_{b.BEFORE}", f"pop_total_{b.AFTER}", *compare.OUTCOMES))


# ---- regression ------------------------------------------------------------

@query
def state_regression(spark, sf):
    return tidy(regression.group_fits(b.moments(spark, sf), "state_code"))


def _national(spark, sf, models):
    return regression.national_fits(
        b.moments(spark, sf), "state_code", models=models)


@query
def pooled_regression(spark, sf):
    return tidy(_national(spark, sf, (regression.POOLED,)))


@query
def fe_regression(spark, sf):
    return tidy(_national(spark, sf, (regression.FIXED_EFFECTS,)))


@query
def regression_table(spark, sf):
    """State fits of every metric, named, flagged and ranked."""
    return _forest(spark, sf, b.moments(spark, sf))


def _forest(spark, sf, moments):
    fits = regression.group_fits(moments, "state_code")
    named = fits.join(b.state_names(spark, sf), "state_code", "left")
    label = F.format_string("%s (n=%d)", F.col("state_name"), F.col("n_amc"))
    table = regression.forest_table(named, ["y_metric"], label)
    return tidy(table.select("y_metric", "state_code", "label", "coef", "significant", "position"))


@query
def national_table(spark, sf):
    """Pooled and fixed-effects fits with metric labels, ranked per model."""
    fits = _national(spark, sf, (regression.POOLED, regression.FIXED_EFFECTS))
    labels = regression.metric_labels(census.OUTCOME_LABELS)
    # Two outcomes can be equal but for the last bits; rank what is shown.
    table = regression.forest_table(tidy(fits), ["model"], labels)
    return table.select("model", "y_metric", "label", "coef", "significant", "position")


@query
def regression_refresh(spark, sf):
    """As ``regression_table``, from stored moments of half the areas merged with those of the other half."""
    panel = written(b.area_panel(spark, sf).select("code_amc", "state_code", b.EXPOSURE, *compare.OUTCOMES), "areas")
    halves = [written(regression.pair_moments(panel.where(f"code_amc % 2 = {half}"), b.EXPOSURE, compare.OUTCOMES, "state_code"), "moments") for half in (0, 1)]
    return _forest(spark, sf, regression.merged_moments(halves, "state_code"))


@query
def scatter_data(spark, sf):
    panel = b.area_panel(spark, sf)
    return tidy(serving.scatter_data(panel, b.EXPOSURE, "mfg_share_log_ratio", b.state_names(spark, sf)))


@query
def scatter_fitted_names(spark, sf):
    """As above, but only states that got a fit for the metric have a name."""
    panel, outcome = b.area_panel(spark, sf), "mfg_share_log_ratio"
    fits = regression.group_fits(
        regression.pair_moments(panel, b.EXPOSURE, [outcome], "state_code"), "state_code")
    names = serving.names_from_fits(fits.join(b.state_names(spark, sf), "state_code", "left"), outcome)
    return tidy(serving.scatter_data(panel, b.EXPOSURE, outcome, names))


@query
def scatter_band(spark, sf):
    return tidy(regression.fitted_band(b.area_panel(spark, sf), b.EXPOSURE, "mfg_share_change_pp"))


@query
def standardised_values(spark, sf):
    """z-scores of account balances within each nation."""
    places = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return tidy(regression.standardised(places, ["c_acctbal"], "c_nationkey"))


@query
def quartile_breaks(spark, sf):
    found = quantiles.exact_quantiles(b.area_panel(spark, sf), b.EXPOSURE)
    return tidy(found.select("n", *[F.col("quantiles")[i].alias(f"q{i}") for i in range(5)]))


@query
def price_quantiles(spark, sf):
    """Exact quantiles over every line item."""
    probabilities = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
    lines = read_table(spark, sf, "lineitem", columns=["l_extendedprice"])
    found = quantiles.exact_quantiles(lines, "l_extendedprice", probabilities)
    return tidy(found.select("n", *[F.col("quantiles")[i].alias(f"q{i}") for i in range(len(probabilities))]))


@query
def quartile_comparison(spark, sf):
    return tidy(census.exposure_quartiles(b.area_panel(spark, sf), b.BEFORE, b.AFTER))


# ---- serving ---------------------------------------------------------------

@query
def panel_slice(spark, sf):
    """One metric of one group at state level, joined to the drawable states."""
    rows = serving.panel_slice(b.order_panel(spark, sf), "State", "medium", panels.OCCUPATION)
    metric = serving.registered(census.METRICS_1872, "share_of_national_occupations", rows)
    shapes = read_table(spark, sf, "nation").select(
        id_code(F.col("n_nationkey")).alias("code_state_chr"), F.col("n_regionkey").alias("shape"))
    view = serving.metric_view(serving.on_map(rows, shapes, "geography_id", "code_state_chr"), metric)
    return tidy(view.select(
        "code_state_chr", "shape", "geography_name", "map_value", "numerator", "denominator",
        "metric_label", "num_label", "den_label", "is_pct", "is_diverging"))


@query
def group_choices(spark, sf):
    return serving.group_choices(b.order_panel(spark, sf), "Municipality", panels.OCCUPATION)


@query
def top15_metric(spark, sf):
    rows = serving.panel_slice(b.order_panel(spark, sf), "Municipality", "manufacturing", panels.SECTOR)
    metric = serving.registered(census.METRICS_1872, "share_of_all_occupations", rows)
    return serving.panel_top_table(serving.metric_view(rows, metric), "geography_name", "geography_id")


def _change_view(spark, sf, name):
    panel = b.area_panel(spark, sf)
    metric = serving.registered(census.change_registry(b.BEFORE, b.AFTER), name, panel)
    return serving.metric_view(panel, metric), metric


@query
def top15_change(spark, sf):
    view, metric = _change_view(spark, sf, "mfg_share_log_ratio")
    return serving.change_top_table(view, "code_amc", metric)


@query
def top15_state_change(spark, sf):
    """The same table over states."""
    panel = b.prefix_panel(spark, sf)
    metric = serving.registered(census.change_registry(b.BEFORE, b.AFTER), "mfg_share_log_ratio", panel)
    return serving.change_top_table(serving.metric_view(panel, metric), "state_code", metric)


@query
def regression_map(spark, sf):
    """State coefficients of one outcome for the drawable states."""
    fits = regression.group_fits(b.moments(spark, sf), "state_code")
    shapes = read_table(spark, sf, "nation").where("n_nationkey <> 3").select(
        F.col("n_nationkey").cast("string").alias("code"), F.col("n_regionkey").alias("shape"))
    view = serving.regression_map(fits, shapes, "mfg_share_change_pp")
    return tidy(view.select("code", "shape", "y_metric", "n_amc", "map_value", "is_diverging"))


@query
def slice_batch(spark, sf):
    """Five slices of the stored panel at once, one per region."""
    path = fresh_path(spark, "panel-store")
    store.write_panel(b.order_panel(spark, sf), path)
    selections = read_table(spark, sf, "region").selectExpr(
        "r_name AS selection", "if(r_regionkey % 2 = 0, 'State', 'Municipality') AS geography_level",
        "if(r_regionkey < 3, 'Occupation', 'Sector') AS group_type",
        "CASE r_regionkey WHEN 0 THEN 'urgent' WHEN 1 THEN 'medium' WHEN 3 THEN 'manufacturing' END AS group_id")
    rows = serving.slice_batch(store.read_panel(spark, path), selections)
    return tidy(rows.select("selection", "geography_level", "group_type", "group_id", "geography_id", "n_total", "share_of_national_occupations"))


@query
def metric_domain(spark, sf):
    domains = [
        serving.metric_domain(_change_view(spark, sf, name)[0]).withColumn("metric", F.lit(name))
        for name in ("mfg_share_change_pp", f"literacy_rate_{b.AFTER}")
    ]
    return tidy(reshape.stack(domains))


# ---- sinks -----------------------------------------------------------------

@query
def short_names(spark, sf):
    return tidy(export.short_panel(b.order_panel(spark, sf), export.STATUS_MEASURES))


@query
def json_columns(spark, sf):
    """Columnar JSON documents of the comparison, read back into rows."""
    out = export.change_export(b.area_panel(spark, sf), ["code_amc", "state_code"], b.BEFORE, b.AFTER)
    documents = export.columnar_json(out, ["code_amc"], chunk_rows=100)
    return tidy(export.columns_back(documents, out.schema))


@query
def json_document(spark, sf):
    """One document of the comparison, written in stripes by many tasks, read back into rows."""
    out = export.change_export(b.area_panel(spark, sf), ["code_amc", "state_code"], b.BEFORE, b.AFTER)
    path = fresh_path(spark, "document")
    export.write_striped_json(out, path, ["code_amc"], chunk_rows=40)
    return tidy(export.striped_rows(spark, path, out.schema))


@query
def json_records(spark, sf):
    """Record JSON of the state fits, read back into rows."""
    fits = regression.group_fits(b.moments(spark, sf), "state_code").select(
        "state_code", "y_metric", "n_amc", *export.FIT_EXPORT)
    parsed = F.from_json("json", fits.schema)
    return tidy(export.record_json(fits).select(F.inline(F.array(parsed))))


@query
def panel_store(spark, sf):
    """The panel written to the store; a slice read back from it."""
    path = fresh_path(spark, "panel-store")
    store.write_panel(b.order_panel(spark, sf), path)
    rows = serving.panel_slice(store.read_panel(spark, path), "Municipality", "services", panels.SECTOR)
    return tidy(rows.select("geography_level", "group_type", "group_id", "geography_id", "n_total",
                            "share_of_all_occupations", "share_of_national_occupations"))


@query
def panel_store_update(spark, sf):
    """Counts of earlier orders stored, later ones added to the folders they touch; the sector panel of the result."""
    every, folder = b.orders(spark, sf), F.pmod("muni_id", F.lit(8)).alias("part")
    halves = [b.wide_orders(every.where(when)) for when in (f"o_orderdate < {b.CUT}", f"o_orderdate >= {b.CUT}")]
    first, second = [half.select("*", folder) for half in halves]
    path, counts = fresh_path(spark, "count-store"), [c for c in halves[0].columns if c != "muni_id"]
    store.write_panel(first, path, ["part"], ["muni_id"])
    store.update_counts(spark, path, second, ["muni_id"], "part", counts)
    return tidy(panels.sector_panel(store.read_panel(spark, path).drop("part"), ["muni_id"], b.ORDER_LAYOUT))
