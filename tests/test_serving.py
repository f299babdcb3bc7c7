import pytest
from helpers import initial_plan, one, rows
from pyspark.sql import functions as F

from panelspan.operators import serving as sv
from panelspan.plans import census

PANEL = """SELECT * FROM VALUES
    ('Municipality', '1', 'Ana', 'Sector', 'services', 'Services', 0.5D, 1234D, 2468D),
    ('Municipality', '2', 'Bia', 'Sector', 'services', 'Services', NULL, NULL, 10D),
    ('Municipality', '3', 'Caa', 'Sector', 'services', 'Services', 0.5D, 1D, 2D),
    ('Municipality', '1', 'Ana', 'Occupation', 'judges', 'Juizes', 0.25D, 1D, 4D),
    ('State', '35', 'SP', 'Sector', 'services', 'Services', -0.75D, 3D, 4D)
    AS t(geography_level, geography_id, geography_name, group_type, group_id, group_label,
         share_of_all_occupations, n_total, occ_total)"""
METRIC = census.METRICS_1872["share_of_all_occupations"]


def test_registry_sizes_and_checks(spark):
    assert len(census.METRICS_1872) == 14 and len(census.METRICS_1920) == 8 and len(census.METRICS_CHANGE) == 22
    assert sum(m.diverging for m in census.METRICS_CHANGE.values()) == 9
    panel = spark.sql(PANEL)
    assert sv.registered(census.METRICS_1872, METRIC.column, panel) == METRIC
    with pytest.raises(sv.UnknownMetric):
        sv.registered(census.METRICS_1872, "nope")
    with pytest.raises(sv.UnknownMetric):
        sv.registered(census.METRICS_1872, "share_free_within_group", panel)


def test_top_table_formats_and_orders(spark):
    view = sv.metric_view(sv.panel_slice(spark.sql(PANEL), "Municipality", "services", "Sector"), METRIC)
    assert rows(sv.panel_top_table(view, "geography_name", "geography_id")) == [
        ("Ana", "50.0%", "1,234", "2,468"), ("Caa", "50.0%", "1", "2"), ("Bia", "No data", "No data", "10")]
    many = spark.range(100).withColumn("map_value", F.rand(1))
    text = initial_plan(sv.top_rows(many, "id"))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_change_table_leaves_missing_out(spark):
    metric = census.METRICS_CHANGE["mfg_share_log_ratio"]
    df = spark.sql("SELECT * FROM VALUES (1L, 0.12346D), (2L, NULL), (3L, -2D) AS t(code_amc, mfg_share_log_ratio)")
    assert rows(sv.change_top_table(sv.metric_view(df, metric), "code_amc", metric)) == [("1", "0.1235"), ("3", "-2")]


def test_choices(spark):
    panel = spark.sql(PANEL)
    assert rows(sv.group_choices(panel, "Municipality")) == [("judges", "Juizes"), ("services", "Services")]
    assert rows(sv.group_choices(panel, "Municipality", "Sector")) == [("services", "Services")]


def test_rows_without_a_shape_disappear(spark):
    shapes = spark.sql("SELECT * FROM VALUES ('1', 'g1'), ('9', 'g9') AS t(code, geometry)")
    panel = sv.panel_slice(spark.sql(PANEL), "Municipality", "services")
    assert [r.geometry for r in sv.on_map(panel, shapes, "geography_id", "code").collect()] == ["g1"]


def test_domain(spark):
    view = sv.metric_view(spark.sql(PANEL), METRIC)
    assert tuple(one(sv.metric_domain(view))) == (False, -0.75, 0.5)
    import dataclasses

    diverging = sv.metric_view(spark.sql(PANEL), dataclasses.replace(METRIC, diverging=True))
    assert tuple(one(sv.metric_domain(diverging))) == (True, -0.75, 0.75)


def test_scatter_names(spark):
    panel = spark.sql("SELECT * FROM VALUES (1, '13', 1D, 2D), (2, '15', 1D, NULL), (3, '21', 2D, 3D) "
                      "AS t(code_amc, state_code, x, y)")
    names = spark.sql("SELECT '13' AS state_code, 'Amazonas' AS state_name")
    out = sv.scatter_data(panel, "x", "y", names)
    assert sorted(rows(out.select("code_amc", "state_name"))) == [(1, "Amazonas"), (3, None)]


def test_quartile_comparison(spark):
    df = spark.range(8).selectExpr(
        "cast(id as double) AS enslaved_share_1872", "cast(id as double) AS agr_share_1872",
        "1D AS mfg_share_1872", "2D AS serv_share_1872", "cast(id + 1 as double) AS agr_share_1920",
        "0.5D AS mfg_share_change_pp", "if(id = 7, NULL, 0.25D) AS serv_share_change_pp")
    out = {(r.quartile, r.panel, r.sector): (r.n, r.mean_share) for r in census.exposure_quartiles(df).collect()}
    assert len(out) == 4 * 2 * 3
    base, change = (c.label for c in census.contrasts())
    # Seven complete cases, breaks at 1.5, 3 and 4.5.
    assert out["Q1 (lowest)", base, "Agriculture"] == (2, 0.5)
    assert out["Q4 (highest)", base, "Agriculture"] == (2, 5.5)
    assert out["Q2", change, "Agriculture"] == (2, 1.0)
    assert sum(out[q, base, "Services"][0] for q in {k[0] for k in out}) == 7
