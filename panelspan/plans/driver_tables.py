"""The census operators bound to the order tables.

Orders play the first census: a customer is a municipality, its nation the
state, order priority the occupation, order status the legal status, the
parity of the order key the sex.  Line items play the second kind of census
(exactly named columns): a supplier is a municipality, the line number the
sector, quantities are the counts.  Areas group customers by key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspan.functions.guarded import quoted
from panelspan.operators import compare, crosswalk as xw, naming, panels, regression, rollup
from panelspan.operators.panels import ExactLayout, Group, Level, PrefixLayout
from panelspan.operators.quality import FlowQuality
from panelspan.plans.census import LAYOUT_1872, sector_columns
from panelspan.sources.tables import read_table

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
AREAS = 300
BEFORE, AFTER, YEARS = "a", "b", 4

ORDER_LAYOUT = PrefixLayout(
    total=LAYOUT_1872.total, free=LAYOUT_1872.free, enslaved=LAYOUT_1872.enslaved,
    male_free=LAYOUT_1872.male_free, female_free=LAYOUT_1872.female_free,
    male_enslaved=LAYOUT_1872.male_enslaved, female_enslaved=LAYOUT_1872.female_enslaved,
    population=LAYOUT_1872.population, literate=LAYOUT_1872.literate,
    broad=("urgent", "high", "medium", "notspecified", "low"),
    not_working=("low",),
    occupations=(
        Group("urgent", "Urgent", "agriculture", ("urgent",)),
        Group("high", "High", "agriculture", ("high",)),
        Group("medium", "Medium", "manufacturing", ("medium",)),
        Group("not_specified", "Not specified", "services", ("not specified",)),
        Group("low", "Low", "services", ("low",)),
    ),
    agriculture=("urgent", "high"),
    manufacturing=("medium",),
)
LINE_LAYOUT = ExactLayout(
    population="popmun20", literate="popalf20", occupied="pia20",
    occupied_male="peasetth", occupied_female="peasettm",
    agriculture=sector_columns(1, 2), manufacturing=sector_columns(3, 5),
)
PERIOD_LAYOUT = ExactLayout(
    population="popmun20", literate="popalf20", occupied="pia20",
    occupied_male="peasetth", occupied_female="peasettm",
    agriculture=sector_columns(1, 5), manufacturing=sector_columns(6, 19),
)

FREE, ENSLAVED = "o_orderstatus IN ('F', 'P')", "o_orderstatus = 'O'"
MALE, FEMALE = "o_orderkey % 2 = 0", "o_orderkey % 2 = 1"
LITERATE = "o_totalprice > 250000"


def _count(name: str, *conditions: str) -> Column:
    return F.expr(f"cast(count_if({' AND '.join(conditions)}) as double) AS {quoted(name)}")


def wide_orders(orders: DataFrame, categories: Sequence[str] = PRIORITIES) -> DataFrame:
    """Wide counts per customer.

    The shuffle carries totals and the finest cells (priority x status x sex);
    free and enslaved columns are sums of cells after it.
    """
    cells = (
        ("h_livres", FREE, MALE), ("m_livres", FREE, FEMALE),
        ("h_escr", ENSLAVED, MALE), ("m_escr", ENSLAVED, FEMALE),
    )
    finest = orders.groupBy(F.col("o_custkey").alias("muni_id")).agg(
        _count("soma_g_almas", "true"), _count("soma_l_almas", FREE), _count("soma_e_almas", ENSLAVED),
        _count("soma_g_sabemlereescrever", LITERATE),
        *[_count(f"soma_g_{p}", f"o_orderpriority = '{p}'") for p in categories],
        *[_count(f"{prefix}_{p}", f"o_orderpriority = '{p}'", status, sex)
          for prefix, status, sex in cells for p in categories],
    )
    coarser = {"soma_l": ("h_livres", "m_livres"), "soma_e": ("h_escr", "m_escr")}
    return finest.selectExpr("*", *[
        " + ".join(quoted(f"{part}_{p}") for part in parts) + " AS " + quoted(f"{prefix}_{p}")
        for prefix, parts in coarser.items() for p in categories
    ])


def wide_lines(lines: DataFrame) -> DataFrame:
    """Wide quantities per supplier in exactly named sector columns."""
    def total(name: str, condition: str) -> Column:
        return F.expr(f"coalesce(sum(CASE WHEN {condition} THEN l_quantity END), 0D) AS {name}")

    men, women = "l_linestatus = 'F'", "l_linestatus = 'O'"
    return lines.groupBy(F.col("l_suppkey").alias("muni_id")).agg(
        F.sum("l_quantity").alias("popmun20"),
        total("popalf20", "l_discount > 0.05"),
        total("pia20", "l_returnflag IN ('A', 'N')"),
        F.sum("l_quantity").alias("peasettt"),
        total("peasetth", men), total("peasettm", women),
        *[total(f"peaset{k}{sex}", f"l_linenumber = {k} AND {who}")
          for k in range(1, 8) for sex, who in (("h", men), ("m", women))],
    )


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders")


def order_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per customer; a customer has a row only with at least one order."""
    return wide_orders(orders(spark, sf))


def line_counts(spark: SparkSession, sf: str) -> DataFrame:
    return panels.empty_rows_dropped(
        wide_lines(read_table(spark, sf, "lineitem")), ["peasettt", "popmun20"])


def _places(spark: SparkSession, sf: str, table: str, head: str) -> DataFrame:
    nation = read_table(spark, sf, "nation", columns=["n_nationkey", "n_name"])
    places = read_table(spark, sf, table).select(
        F.col(f"{head}_{'cust' if head == 'c' else 'supp'}key").alias("muni_id"),
        F.col(f"{head}_name").alias("municipio"), F.col(f"{head}_nationkey").alias("code_state"),
    )
    return places.join(nation, places["code_state"] == nation["n_nationkey"], "left").select(
        "muni_id", "municipio", "code_state",
        F.concat(F.lit("N"), F.col("code_state")).alias("abbrev_state"), F.col("n_name").alias("name_state"),
    )


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return _places(spark, sf, "customer", "c")


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return _places(spark, sf, "supplier", "s")


MUNI_IDS = ("muni_id", "municipio", "code_state", "abbrev_state", "name_state")
STATE_IDS = ("code_state", "abbrev_state", "name_state")


def located_orders(spark: SparkSession, sf: str) -> DataFrame:
    return xw.attach_geography(order_counts(spark, sf), customers(spark, sf), "muni_id")[0]


def located_lines(spark: SparkSession, sf: str) -> DataFrame:
    return xw.attach_geography(line_counts(spark, sf), suppliers(spark, sf), "muni_id")[0]


def count_columns(df: DataFrame, layout: panels.Layout) -> list[str]:
    if isinstance(layout, PrefixLayout):
        return naming.with_prefix(df.columns, layout.count_prefixes)
    return naming.starting_with(df.columns, ("peaset", "popmun20", "popalf20", "pia20"))


def _dashboard(located: DataFrame, layout: panels.Layout) -> DataFrame:
    by_state = rollup.rollup(located, list(STATE_IDS), count_columns(located, layout))
    return panels.dashboard_panel([
        (panels.group_panel(located, MUNI_IDS, layout),
         Level("Municipality", F.col("muni_id").cast("string"), F.col("municipio"))),
        (panels.group_panel(by_state, STATE_IDS, layout),
         Level("State", F.col("code_state").cast("string"), F.col("name_state"))),
    ], layout)


def order_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    return _dashboard(located_orders(spark, sf), ORDER_LAYOUT)


def line_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    return _dashboard(located_lines(spark, sf), LINE_LAYOUT)


def order_panel(spark: SparkSession, sf: str) -> DataFrame:
    groups = len(ORDER_LAYOUT.occupations) + len(panels.SECTORS)
    return rollup.with_national_shares(order_dashboard(spark, sf), group_count=groups)


def line_panel(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.with_national_shares(
        line_dashboard(spark, sf), rollup.PLAIN_SHARES, group_count=len(panels.SECTORS))


def area_crosswalk(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customer.select((key % AREAS).alias("code_amc"), key.alias("muni_code"))


def crosswalk_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Comma-separated code lists per area, several short lists for an area.

    A list covers one block of consecutive keys, so none holds more than
    a hundred codes however many customers there are.
    """
    key = F.col("c_custkey")
    return read_table(spark, sf, "customer").groupBy(
        (key % AREAS).alias("code_amc"), F.floor(key / (100 * AREAS)).alias("block")
    ).agg(F.concat_ws(", ", F.sort_array(F.collect_list(key.cast("string")))).alias("list_code_muni_2010"))


#: Every order lies in one period: before this date or from it on.
CUT = "timestamp_ntz '1998-01-01'"


def first_period(every: DataFrame) -> DataFrame:
    """Orders before the cut date in prefix-coded columns."""
    return wide_orders(every.where(f"o_orderdate < {CUT}"))


def second_period(every: DataFrame) -> DataFrame:
    """Orders from the cut date on in exactly named columns."""
    sectors = {1: "1-URGENT", 2: "2-HIGH", 6: "3-MEDIUM", 41: "4-NOT SPECIFIED"}
    later = every.where(f"o_orderdate >= {CUT}")
    working = "o_orderpriority <> '5-LOW'"
    return later.groupBy(F.col("o_custkey").alias("muni_id")).agg(
        _count("popmun20", "true"), _count("popalf20", LITERATE), _count("pia20", working),
        _count("peasetth", working, MALE), _count("peasettm", working, FEMALE),
        *[_count(f"peaset{k}{sex}", f"o_orderpriority = '{p}'", who)
          for k, p in sectors.items() for sex, who in (("h", MALE), ("m", FEMALE))],
    )


def _compared(first: DataFrame, second: DataFrame, key: str, missing_key_matches: bool = False) -> DataFrame:
    return compare.two_period_panel(
        (first, ORDER_LAYOUT, BEFORE), (second, PERIOD_LAYOUT, AFTER), key, YEARS, missing_key_matches)


def area_panel(spark: SparkSession, sf: str, quality: FlowQuality | None = None, places: str = "true") -> DataFrame:
    """Comparison of both periods per area, with the area's majority state.

    ``places`` limits the customers that have an area.
    """
    every, customer = orders(spark, sf), read_table(spark, sf, "customer").where(places)
    crosswalk = area_crosswalk(customer)
    a, b = first_period(every), second_period(every)
    watch = [quality.stage(f"{name} period: areas of codes") if quality else None for name in ("first", "second")]
    compared = _compared(
        rollup.rollup_by_crosswalk(a, "muni_id", crosswalk, count_columns(a, ORDER_LAYOUT), unique_ids=True, watch=watch[0]),
        rollup.rollup_by_crosswalk(b, "muni_id", crosswalk, count_columns(b, PERIOD_LAYOUT), unique_ids=True, watch=watch[1]),
        "code_amc",
    )
    return compared.join(majority_states(customer), "code_amc", "left")


def majority_states(customer: DataFrame) -> DataFrame:
    return xw.majority_parent(
        customer, "c_custkey", area_crosswalk(customer),
        F.col("c_nationkey").cast("string"), unique_ids=True)


def prefix_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Comparison per leading two digits of the customer key."""
    every = orders(spark, sf)
    a, b = first_period(every), second_period(every)
    return _compared(
        rollup.rollup_by_prefix(a, "muni_id", count_columns(a, ORDER_LAYOUT)),
        rollup.rollup_by_prefix(b, "muni_id", count_columns(b, PERIOD_LAYOUT)),
        "state_code", missing_key_matches=True,
    )


EXPOSURE = f"enslaved_share_{BEFORE}"


def keyed_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Comparison per last two digits of the customer key, one of which counts as missing in both periods."""
    every = orders(spark, sf)
    key = F.expr("nullif(cast(muni_id % 25 AS string), '7')").alias("state_code")
    a, b = first_period(every), second_period(every)
    return _compared(
        rollup.rollup(a, [key], count_columns(a, ORDER_LAYOUT)), rollup.rollup(b, [key], count_columns(b, PERIOD_LAYOUT)),
        "state_code", missing_key_matches=True,
    )


#: As many categories as the first census has occupations.
FULL = tuple(f"k{i:02}" for i in range(38))
FULL_LAYOUT = replace(
    ORDER_LAYOUT, broad=FULL, not_working=FULL[30:],
    occupations=tuple(Group(k, k, "agriculture" if i < 15 else "manufacturing" if i < 22 else "services", (k,)) for i, k in enumerate(FULL)),
    agriculture=FULL[:15], manufacturing=FULL[15:22],
)


def full_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Wide counts per customer in all 38 categories and seven prefixes: 266 columns besides the totals."""
    category = "concat('k', lpad(cast(cast(o_totalprice AS bigint) % 38 AS string), 2, '0'))"
    return wide_orders(orders(spark, sf).withColumn("o_orderpriority", F.expr(category)), FULL)


def moments(spark: SparkSession, sf: str) -> DataFrame:
    return regression.pair_moments(area_panel(spark, sf), EXPOSURE, compare.OUTCOMES, "state_code")


def state_names(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("state_code"), F.col("n_name").alias("state_name"))
