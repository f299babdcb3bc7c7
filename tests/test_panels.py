import pytest
from helpers import initial_plan, rows
from pyspark.sql import functions as F

from panelspan.operators import naming, panels, reshape, rollup
from panelspan.operators.panels import ExactLayout, Group, Level, PrefixLayout
from panelspan.plans.census import LAYOUT_1872, LAYOUT_1920, OCCUPATIONS

SMALL = PrefixLayout(
    **{f: getattr(LAYOUT_1872, f) for f in (
        "total", "free", "enslaved", "male_free", "female_free", "male_enslaved", "female_enslaved",
        "population", "literate", "broad", "not_working")},
    occupations=(Group("metals", "Metals", "manufacturing", ("emmetais",)),
                 Group("farmers", "Farmers", "agriculture", ("lavradores",)),
                 Group("idle", "Idle", "services", ("semprofissao",))),
    agriculture=("lavradores",), manufacturing=("emmetais",),
)
COLUMNS = [
    "soma_g_almas", "soma_l_almas", "soma_e_almas", "soma_g_sabemlereescrever",
    "Soma_G_Em Metáis", "soma_g_lavradores", "soma_g_profagric", "soma_g_profmanuaisemec", "soma_g_semprofissao",
    "soma_l_profagric", "soma_e_profagric", "soma_l_emmetais", "soma_e_emmetais",
    "h_livres_profagric", "h_livres_semprofissao", "f_livres_semprofissao", "h_escr_emmetais",
]


@pytest.fixture(scope="module")
def wide(spark):
    data = [
        # id, population and literacy, then counts in the order above
        (1, 100.0, 80.0, 20.0, 30.0, 5.0, 10.0, 20.0, 10.0, 50.0, 12.0, 8.0, 3.0, 2.0, 9.0, 4.0, 6.0, 2.0),
        (2, *[None] * 17),
        (3, *[0.0] * 17),
        (4, 10.0, 10.0, None, 1.0, 30.0, 9.0, 5.0, None, 3.0, 5.0, None, 7.0, None, 5.0, 0.0, 0.0, None),
    ]
    return spark.createDataFrame(data, "id long, " + ", ".join(f"`{c}` double" for c in COLUMNS))


def by_group(df, *columns):
    return {(r["id"], r["group_id"]): tuple(r[c] for c in columns) for r in df.collect()}


def test_matching_folds_names_and_prefixes():
    names = ["Soma_G_Em Metáis", "soma_l_emmetais", "soma_g_outro", "xsoma_g_emmetais", "soma_gx_emmetais"]
    assert naming.matching(names, ["soma_g"], ["em metais"]) == ["Soma_G_Em Metáis"]
    assert naming.matching(names, ["soma_g", "soma_l"], ["emmet", "outro"]) == names[:3]
    assert naming.match_report(names, ["soma_g"], ["emmetais", "nada"]) == {"emmetais": names[:1], "nada": []}
    with pytest.raises(naming.NoMatchingColumn):
        naming.matching(names, ["soma_g"], ["nada"], strict=True)


def test_exact_names_are_raw():
    assert naming.present(["a", "B", "c"], ["b", "c", "c", "x"]) == ["c"]


def test_alternate_spellings_add_up(spark):
    df = spark.sql("SELECT 1D AS soma_e_x, 2D AS soma_escr_x, 4D AS soma_g_x")
    assert rows(df.select(F.expr(naming.matched_total(df.columns, LAYOUT_1872.enslaved, ["x"])))) == [(3.0,)]


def test_dictionary_sizes():
    assert len(OCCUPATIONS) == 38 and len({g.id for g in OCCUPATIONS}) == 38
    assert len(LAYOUT_1920.manufacturing["male"]) == 14 and LAYOUT_1920.agriculture["female"][0] == "peaset1m"
    assert set(LAYOUT_1872.working) == set(LAYOUT_1872.broad) - {"semprofissao"}


def test_non_empty_rows(wide):
    assert sorted(r.id for r in naming.non_empty(wide, "SOMA_G_").collect()) == [1, 4]


def test_denominators(wide):
    out = {r["id"]: r for r in panels.denominators(wide, SMALL).collect()}
    first = out[1]
    assert (first.pop_total, first.pop_literate, first.occ_total) == (100.0, 30.0, 30.0)
    assert first.literacy_rate_population == 0.3 and first.enslaved_rate_population == 0.2
    assert (first.occ_free, first.occ_enslaved, first.occ_male, first.occ_female) == (12.0, 8.0, 9.0, 0.0)
    assert out[2].pop_total == 0.0 and out[2].literacy_rate_population is None
    assert out[4].pop_enslaved == 0.0


def test_occupation_panel(wide):
    panel = panels.occupation_panel(wide, ["id"], SMALL)
    assert panel.count() == 4 * 3
    got = by_group(panel, "n_total", "n_enslaved", "share_of_all_occupations", "share_literate_within_group")
    assert got[1, "metals"] == (5.0, 2.0, 5 / 30, None)
    # Without profession is left out of its own denominator.
    assert got[1, "idle"][2] == 50 / 30
    assert got[2, "metals"] == (0.0, 0.0, None, None)


def test_panel_needs_no_shuffle(wide):
    text = initial_plan(panels.group_panel(wide, ["id"], SMALL))
    assert "Exchange" not in text and "Join" not in text and "Generate" in text


def test_services_are_a_clamped_residual(wide):
    got = by_group(panels.sector_panel(wide, ["id"], SMALL), "n_total", "n_male", "n_female")
    # Total: working groups minus sectors; sexes: all broad groups, so they exceed it.
    assert got[1, "services"] == (15.0, 9.0 + 4.0, 6.0)
    assert got[4, "services"] == (0.0, 5.0, 0.0)  # 5 - 9 - 30 is clamped
    assert got[1, "agriculture"][0] == 10.0 and got[1, "manufacturing"][0] == 5.0


EXACT = ExactLayout("pop", "lit", "occ", "men", "women",
                    {"male": ("a_h", "gone_h"), "female": ("a_m",)}, {"male": ("b_h",), "female": ("b_m",)})


def test_exact_layout(spark):
    df = spark.sql("""SELECT * FROM VALUES
        (1, 100D, 25D, 40D, 30D, 10D, 5D, 1D, 10D, 2D),
        (2, 100D, NULL, NULL, 30D, 10D, 5D, NULL, 10D, 2D),
        (3, 10D, 1D, 12D, 4D, 5D, 6D, 1D, 5D, 3D)
        AS t(id, pop, lit, occ, men, women, a_h, a_m, b_h, b_m)""")
    panel = panels.sector_panel(df, ["id"], EXACT)
    got = by_group(panel, "n_total", "n_male", "n_female", "n_free", "share_of_all_occupations", "enslaved_rate_population")
    assert got[1, "agriculture"] == (6.0, 5.0, 1.0, None, 0.15, None)
    assert got[1, "services"] == (22.0, 15.0, 7.0, None, 0.55, None)
    assert got[2, "services"] == (None, 15.0, 8.0, None, None, None)  # unknown total stays unknown
    assert got[3, "services"][:3] == (0.0, 0.0, 1.0)  # clamped one by one
    assert panel.count() == 9


def test_rollup_preserves_totals_and_missing(spark):
    df = spark.sql("SELECT * FROM VALUES ('x', 1D, NULL), ('x', 2D, NULL), ('y', NULL, 4D) AS t(k, `a b`, c)")
    assert sorted(rows(rollup.rollup(df, ["k"], ["a b", "c"]))) == [("x", 3.0, 0.0), ("y", 0.0, 4.0)]


def test_dashboard_and_national_shares(wide):
    muni = panels.group_panel(wide, ["id"], SMALL)
    state = panels.group_panel(rollup.rollup(wide, [F.lit("s").alias("st")], COLUMNS), ["st"], SMALL)
    panel = panels.dashboard_panel([
        (muni, Level("Municipality", F.col("id").cast("string"), F.lit("m"))),
        (state, Level("State", F.col("st"), F.col("st"))),
    ], SMALL)
    assert panel.columns == list(panels.DASHBOARD) and len(panel.columns) == 30
    shared = rollup.with_national_shares(panel, group_count=6).cache()
    cells = {(r.geography_level, r.geography_id, r.group_id): r for r in shared.collect()}
    assert len(cells) == 4 * 6 + 6
    assert cells["Municipality", "2", "metals"].share_of_all_occupations == 0.0  # undefined becomes 0
    assert cells["Municipality", "1", "metals"].share_of_national_occupations == 5 / 35
    # Residuals are clamped per geography: the state is not the sum of its parts.
    total = cells["Municipality", "1", "services"].n_total_national
    assert total == 15.0 and cells["State", "s", "services"].n_total == 0.0
    # Both join forms agree.
    plain = rollup.with_national_shares(panel)
    assert sorted(map(str, plain.collect())) == sorted(map(str, shared.collect()))


def test_national_join_does_not_shuffle_the_panel(wide):
    panel = panels.dashboard_panel([
        (panels.group_panel(wide, ["id"], SMALL), Level("Municipality", F.col("id").cast("string"), F.lit("m")))], SMALL)
    text = initial_plan(rollup.with_national_shares(panel, group_count=6))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert text.count("Exchange hashpartitioning") == 1  # the totals' own aggregation


def test_pivot_equals_direct_wide_panel(wide):
    kinds = (panels.OCCUPATION, panels.SECTOR)
    ids = [g.id for g in SMALL.occupations] + list(panels.SECTORS)
    pivoted = reshape.pivot_panel(panels.group_panel(wide, ["id"], SMALL), ["id"], ids)
    direct = reshape.wide_panel(wide, ["id"], SMALL, kinds)
    assert set(pivoted.columns) == set(direct.columns) and len(direct.columns) == 2 + 6 * 6
    columns = sorted(direct.columns)
    assert sorted(map(str, pivoted.select(columns).collect())) == sorted(map(str, direct.select(columns).collect()))
    assert "Exchange" not in initial_plan(direct)
    assert initial_plan(pivoted).count("Exchange") == 1


def test_pivot_refuses_duplicates(wide):
    panel = panels.sector_panel(wide, ["id"], SMALL)
    with pytest.raises(Exception, match="occurs twice"):
        reshape.pivot_panel(panel.unionByName(panel), ["id"], panels.SECTORS).collect()


def test_pivot_and_unpivot_are_inverse(wide):
    panel = panels.sector_panel(wide, ["id"], SMALL).select("id", "group_id", "n_total", "literacy_rate_population")
    pivoted = reshape.pivot_panel(panel, ["id"], panels.SECTORS, ["n_total"])
    renamed = pivoted.select("id", *[F.col(f"n_total_{s}").alias(s) for s in panels.SECTORS])
    back = reshape.to_long(renamed, ["id"], list(panels.SECTORS), "group_id", "n_total")
    assert sorted(rows(back)) == sorted(rows(panel.select("id", "group_id", "n_total")))


def test_values_can_be_in_several_groups(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'São Médio'), (2, 'grande'), (3, NULL) AS t(id, kind)")
    out = naming.classify_values(df, "kind", {"mid": ("medio",), "any": ("sao", "grande")})
    assert sorted(rows(out.select("id", "group_id"))) == [(1, "any"), (1, "mid"), (2, "any")]
    assert "Join" not in initial_plan(out)
