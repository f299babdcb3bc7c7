"""Census configuration and the end-to-end flows for both census years."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspan.functions.text import id_code, id_prefix
from panelspan.operators import compare, crosswalk as xw, naming, panels, regression, reshape, rollup
from panelspan.operators.panels import ExactLayout, Group, Level, PrefixLayout
from panelspan.operators.quality import FlowQuality
from panelspan.operators.serving import Contrast, Metric, quartile_comparison
from panelspan.sources import export, store
from panelspan.sources.tables import lookup_table, reuse_or_build

# --------------------------------------------------------------------------
# Name prefixes, patterns and dictionaries of the 1872 tables.
# --------------------------------------------------------------------------
OCCUPATIONS = (
    Group("secular_religious", "Seculares religiosos", "services", ("secularesreligiosos",)),
    Group("regular_religious_men", "Homens religiosos regulares", "services", ("homensreligregular",)),
    Group("regular_religious_women", "Mulheres religiosas regulares", "services", ("mulheresreligregular",)),
    Group("judges", "Juizes", "services", ("juizes",)),
    Group("lawyers", "Advogados", "services", ("advogados",)),
    Group("notaries_scribes", "Notarios e escrivaes", "services", ("notarioseescrivaes",)),
    Group("procurators", "Procuradores", "services", ("procuradores",)),
    Group("justice_officers", "Oficiais de justica", "services", ("oficiaisdejustica",)),
    Group("physicians", "Medicos", "services", ("medicos",)),
    Group("surgeons", "Cirurgioes", "services", ("cirurgioes",)),
    Group("pharmacists", "Farmaceuticos", "services", ("farmaceuticos",)),
    Group("midwives", "Parteiros", "services", ("parteiros",)),
    Group("teachers_letters", "Professores e homens de letras", "services", ("professoresehomensdelet",)),
    Group("public_employees", "Empregados publicos", "services", ("empregadospublicos",)),
    Group("artists", "Artistas", "services", ("artistas",)),
    Group("military", "Militares", "services", ("militares",)),
    Group("maritime", "Maritimos", "services", ("maritimos",)),
    Group("fishermen", "Pescadores", "agriculture", ("pescadores",)),
    Group("capitalists_owners", "Capitalistas e proprietarios", "services", ("capitalistasepropriet",)),
    Group("manufacturers", "Manufatureiros e fabricantes", "manufacturing", ("manufatureirosefabrican",)),
    Group("merchants_bookkeepers", "Comerciantes, guarda-livros e caixeiros", "services",
          ("comerciantesguardalivro",)),
    Group("seamstresses", "Costureiras", "services", ("costureiras",)),
    Group("stonemasons_miners", "Canteiros, calceteiros e mineiros", "agriculture",
          ("canteiroscalcoteirosmin",)),
    Group("metals", "Em metais", "manufacturing", ("emmetais",)),
    Group("wood", "Em madeiras", "manufacturing", ("emmadeiras",)),
    Group("textiles", "Em tecidos", "manufacturing", ("emtecidos",)),
    Group("buildings", "De edificacoes", "manufacturing", ("deedificac",)),
    Group("leather_skins", "Em couros e peles", "manufacturing", ("emcourosepeles",)),
    Group("dyeing", "Em tinturaria", "manufacturing", ("emtinturaria",)),
    Group("clothing", "De vestuarios", "manufacturing", ("devestuarios",)),
    Group("hats", "De chapeus", "manufacturing", ("dechapeus",)),
    Group("footwear", "De calcado", "manufacturing", ("decalcado",)),
    Group("farmers", "Lavradores", "agriculture", ("lavradores",)),
    Group("stockbreeders", "Criadores", "agriculture", ("criadores",)),
    Group("servants_day_laborers", "Criados e jornaleiros", "services", ("criadosejornaleiros",)),
    Group("domestic_service", "Servico domestico", "services", ("servicodomestico",)),
    Group("other_occupations", "Outras ocupacoes", "services", ("outrasocupacoes",)),
    Group("without_profession", "Sem profissao", "services", ("semprofissao",)),
)
LAYOUT_1872 = PrefixLayout(
    total=("soma_g",),
    free=("soma_l",),
    enslaved=("soma_e", "soma_escr", "soma_escrv"),
    male_free=("h_livres",),
    female_free=("m_livres", "f_livres"),
    male_enslaved=("h_escr", "h_escrv"),
    female_enslaved=("m_escr", "m_escrv"),
    population={
        "total": ("soma_g_almas",),
        "free": ("soma_l_almas",),
        "enslaved": ("soma_e_almas", "soma_escr_almas", "soma_escrv_almas"),
    },
    literate="sabemlereescrever",
    broad=("profliberais", "outrasocupacoes", "profindustriaisecomerci", "profmanuaisemec",
           "profagric", "semprofissao"),
    not_working=("semprofissao",),
    occupations=OCCUPATIONS,
    agriculture=("lavradores", "criadores", "canteiroscalcoteirosmin", "pescadores"),
    manufacturing=("manufatureirosefabrican", "emmetais", "emmadeiras", "emtecidos", "deedificac",
                   "emcourosepeles", "emtinturaria", "devestuarios", "dechapeus", "decalcado"),
)


def sector_columns(first: int, last: int) -> dict[str, tuple[str, ...]]:
    """Employment columns of consecutive 1920 sectors, men (h) and women (m)."""
    numbers = range(first, last + 1)
    return {"male": tuple(f"peaset{k}h" for k in numbers),
            "female": tuple(f"peaset{k}m" for k in numbers)}


# Column names and sector numbers of the 1920 tables.
LAYOUT_1920 = ExactLayout(
    population="popmun20", literate="popalf20", occupied="pia20",
    occupied_male="peasetth", occupied_female="peasettm",
    agriculture=sector_columns(1, 5), manufacturing=sector_columns(6, 19),
)
PANEL_STEMS_1920 = ("peaset", "popmun20", "popalf20", "piaalf20", "pibhal20", "piehal20", "pia20")
COMPARED_STEMS_1920 = ("peaset", "popmun20", "popalf20", "piaalf20", "pia20")
NON_EMPTY_1920 = ("peasettt", "popmun20")

# States as published (name, code, abbreviation), 1872.
STATES_1872 = (
    ("Amazonas", 13, "AM"), ("Pará", 15, "PA"), ("Maranhão", 21, "MA"), ("Piauhy", 22, "PI"),
    ("Ceará", 23, "CE"), ("Rio Grande do Norte", 24, "RN"), ("Parahyba", 25, "PB"),
    ("Pernambuco", 26, "PE"), ("Alagôas", 27, "AL"), ("Sergipe", 28, "SE"), ("Bahia", 29, "BA"),
    ("Município neutro", 30, "MN"), ("Minas Geraes", 31, "MG"), ("Espirito Santo", 32, "ES"),
    ("Rio de Janeiro", 33, "RJ"), ("São Paulo", 35, "SP"), ("Paraná", 41, "PR"),
    ("Santa Catharina", 42, "SC"), ("Rio Grande do Sul", 43, "RS"), ("Matto Grosso", 51, "MT"),
    ("Goyaz", 52, "GO"),
)
# States as published (name, code, abbreviation), 1920.
STATES_1920 = (
    ("Território do Acre", 12, "AC"), ("Amazonas", 13, "AM"), ("Pará", 15, "PA"),
    ("Maranhão", 21, "MA"), ("Piauhy", 22, "PI"), ("Ceará", 23, "CE"),
    ("Rio Grande do Norte", 24, "RN"), ("Parahyba do Norte", 25, "PB"), ("Pernambuco", 26, "PE"),
    ("Alagôas", 27, "AL"), ("Sergipe", 28, "SE"), ("Bahia", 29, "BA"),
    ("Districto Federal", 30, "DF"), ("Minas Geraes", 31, "MG"), ("Espirito Santo", 32, "ES"),
    ("Rio de Janeiro", 33, "RJ"), ("São Paulo", 35, "SP"), ("Paraná", 41, "PR"),
    ("Santa Catharina", 42, "SC"), ("Rio Grande do Sul", 43, "RS"), ("Matto Grosso", 51, "MT"),
    ("Goyaz", 52, "GO"),
)
# States of the comparison (code, name).
COMPARED_STATES = (
    ("13", "Amazonas"), ("15", "Para"), ("21", "Maranhao"), ("22", "Piauhy"), ("23", "Ceara"),
    ("24", "Rio Grande do Norte"), ("25", "Parahyba"), ("26", "Pernambuco"), ("27", "Alagoas"),
    ("28", "Sergipe"), ("29", "Bahia"), ("30", "Municipio Neutro"), ("31", "Minas Geraes"),
    ("32", "Espirito Santo"), ("33", "Rio de Janeiro"), ("35", "Sao Paulo"), ("41", "Parana"),
    ("42", "Santa Catharina"), ("43", "Rio Grande do Sul"), ("51", "Matto Grosso"), ("52", "Goyaz"),
)

# Labels of the eleven outcomes.
OUTCOME_LABELS = {
    "mfg_share_change_pp": "Mfg share change (pp)",
    "mfg_share_log_ratio": "Mfg share log ratio",
    "mfg_share_cagr": "Mfg share CAGR",
    "mfg_share_logit_change": "Mfg share logit change",
    "non_agr_share_change_pp": "Non-agr share change (pp)",
    "mfg_agr_ratio_change": "Mfg/agr ratio change",
    "structural_change_index": "Structural change index",
    "agr_exit_share": "Agr exit share",
    "serv_share_change_pp": "Services share change (pp)",
    "literacy_rate_change_pp": "Literacy rate change (pp)",
    "pop_growth_rate": "Pop growth rate",
}
EXPOSURE = "enslaved_share_1872"


def _panel_metrics() -> dict[str, Metric]:
    # Column, label, numerator, denominator and their labels.
    rows = (
        ("share_of_all_occupations", "Share of occupations", "n_total", "occ_total",
         "Total in group", "Total occupations"),
        ("share_free_within_group", "Free share within group", "n_free", "n_total",
         "Free in group", "Total in group"),
        ("share_enslaved_within_group", "Enslaved share within group", "n_enslaved", "n_total",
         "Enslaved in group", "Total in group"),
        ("share_male_within_group", "Male share within group", "n_male", "n_total",
         "Male in group", "Total in group"),
        ("share_female_within_group", "Female share within group", "n_female", "n_total",
         "Female in group", "Total in group"),
        ("literacy_rate_population", "Population literacy rate", "pop_literate", "pop_total",
         "Literate population", "Total population"),
        ("enslaved_rate_population", "Enslaved population rate", "pop_enslaved", "pop_total",
         "Enslaved population", "Total population"),
        ("share_of_national_occupations", "Share of national occupations", "n_total", "n_total_national",
         "Total in group", "National total in group"),
        ("share_free_of_national_group", "Free share of national group", "n_free", "n_free_national",
         "Free in group", "National free in group"),
        ("share_enslaved_of_national_group", "Enslaved share of national group", "n_enslaved",
         "n_enslaved_national", "Enslaved in group", "National enslaved in group"),
        ("share_male_of_national_group", "Male share of national group", "n_male", "n_male_national",
         "Male in group", "National male in group"),
        ("share_female_of_national_group", "Female share of national group", "n_female",
         "n_female_national", "Female in group", "National female in group"),
        ("literacy_rate_of_national_pop", "Literacy rate of national population", "pop_literate",
         "pop_literate_national", "Literate population", "National literate population"),
        ("enslaved_rate_of_national_pop", "Enslaved rate of national population", "pop_enslaved",
         "pop_enslaved_national", "Enslaved population", "National enslaved population"),
    )
    return {row[0]: Metric(*row) for row in rows}


METRICS_1872 = _panel_metrics()
METRICS_1920 = {
    name: metric for name, metric in METRICS_1872.items()
    if "free" not in name and "enslaved" not in name
}
def change_registry(before: str = "1872", after: str = "1920") -> dict[str, Metric]:
    """Metrics of the comparison for a pair of period suffixes."""
    # Column, label, shown as percent, diverging scale.
    rows = (
        (f"mfg_share_{after}", f"Mfg share {after} (level)", True, False),
        (f"agr_share_{after}", f"Agr share {after} (level)", True, False),
        (f"non_agr_share_{after}", f"Non-agr share {after} (level)", True, False),
        (f"mfg_agr_ratio_{after}", f"Mfg/agr ratio {after}", False, False),
        (f"literacy_rate_{after}", f"Literacy rate {after}", True, False),
        (f"mfg_percapita_{after}", f"Mfg per capita {after}", False, False),
        ("mfg_share_change_pp", "Mfg share change (pp)", True, True),
        ("mfg_share_log_ratio", "Mfg share log ratio", False, True),
        ("mfg_share_cagr", "Mfg share CAGR", False, True),
        ("mfg_share_logit_change", "Mfg share logit change", False, True),
        ("non_agr_share_change_pp", "Non-agr share change (pp)", True, True),
        ("mfg_agr_ratio_change", "Mfg/agr ratio change", False, True),
        ("structural_change_index", "Structural change index", False, False),
        ("agr_exit_share", "Agr exit share", True, True),
        ("serv_share_change_pp", "Services share change (pp)", True, True),
        ("literacy_rate_change_pp", "Literacy rate change (pp)", True, True),
        ("pop_growth_rate", "Pop growth rate (annual)", False, False),
        (f"enslaved_share_{before}", f"Enslaved share {before} (X)", True, False),
        (f"enslaved_mfg_share_{before}", f"Enslaved mfg share {before} (X)", True, False),
        (f"enslaved_agr_share_{before}", f"Enslaved agr share {before} (X)", True, False),
        (f"mfg_share_{before}", f"Mfg share {before} (baseline)", True, False),
        (f"literacy_rate_{before}", f"Literacy rate {before} (baseline)", True, False),
    )
    return {name: Metric(name, label, is_pct=pct, diverging=div) for name, label, pct, div in rows}


METRICS_CHANGE = change_registry()


def contrasts(before: str = "1872", after: str = "1920") -> tuple[Contrast, Contrast]:
    """The two panels of the quartile comparison."""
    sectors = {"Agriculture": "agr", "Manufacturing": "mfg", "Services": "serv"}
    return (
        Contrast(f"{before} sector shares (baseline)",
                 {label: f"{s}_share_{before}" for label, s in sectors.items()}),
        Contrast(f"{before}-{after} sector share change (pp)",
                 {label: f"{s}_share_change_pp" for label, s in sectors.items()}),
    )


def exposure_quartiles(panel: DataFrame, before: str = "1872", after: str = "1920") -> DataFrame:
    """Sector composition and change by quartile of the exposure."""
    cases = panel.withColumn(
        "agr_share_change_pp", F.col(f"agr_share_{after}") - F.col(f"agr_share_{before}")
    )
    required = ("mfg_share_change_pp", "serv_share_change_pp")
    return quartile_comparison(cases, f"enslaved_share_{before}", required, contrasts(before, after))


def states(spark: SparkSession, year: int) -> DataFrame:
    """Name, code and abbreviation of each state in a census year."""
    rows = STATES_1920 if year == 1920 else STATES_1872
    return lookup_table(spark, rows, "name_state string, code_state int, abbrev_state string")


def compared_states(spark: SparkSession) -> DataFrame:
    """State code and plain name used in the comparison."""
    return lookup_table(spark, COMPARED_STATES, "state_code string, state_name string")


@dataclass(frozen=True)
class CensusPlan:
    """What one census year's panels are built from."""

    layout: panels.Layout
    code: str        # id column of the lookup and of the panel
    name: str        # name column of the table

    @property
    def status(self) -> bool:
        return isinstance(self.layout, PrefixLayout)

    def counts(self, names: list[str]) -> list[str]:
        if self.status:
            return naming.with_prefix(names, self.layout.count_prefixes)
        return naming.starting_with(names, PANEL_STEMS_1920)


PLAN_1872 = CensusPlan(LAYOUT_1872, "code_muni_1872", "municipio")
PLAN_1920 = CensusPlan(LAYOUT_1920, "code_muni_1920", "nommun20")
STATE_IDS = ("code_state", "abbrev_state", "name_state")


def census_panels(
    table: DataFrame, lookup: DataFrame, plan: CensusPlan, quality: FlowQuality | None = None, year: str = "",
) -> dict[str, DataFrame]:
    """All panels of one census: long, wide and the dashboard with national shares.

    ``table`` is the wide census table, ``lookup`` one row per municipality:
    ``plan.code``, name_muni_map, code_state, abbrev_state, name_state.
    """
    with_code = table.withColumn(plan.code, id_code(F.col("muni_malha_id")))
    matched, lost = xw.attach_geography(with_code, lookup, plan.code)
    if plan.status:
        kept = naming.non_empty(matched, LAYOUT_1872.total[0] + "_")
    else:
        kept = panels.empty_rows_dropped(matched, [c for c in NON_EMPTY_1920 if c in matched.columns])
    muni_ids = [plan.code, plan.name, "name_muni_map", *STATE_IDS]
    kept_once = kept                        # one of the tables made from it counts its rows
    if quality:
        lost = xw.attach_geography(with_code, lookup, plan.code, watch=quality.stage(f"census {year}: geography"))[1]
        kept_once = quality.watch(kept, f"census {year}: kept")
    by_state = rollup.rollup(kept, list(STATE_IDS), plan.counts(table.columns))

    muni = panels.group_panel(kept, muni_ids, plan.layout)
    state = panels.group_panel(by_state, STATE_IDS, plan.layout)
    dashboard = panels.dashboard_panel([
        (muni, Level("Municipality", F.col(plan.code), F.coalesce(plan.name, "name_muni_map"))),
        (state, Level("State", F.col("code_state").cast("string"), F.col("name_state"))),
    ], plan.layout)
    shares = rollup.STATUS_SHARES if plan.status else rollup.PLAIN_SHARES
    groups = len(OCCUPATIONS) + len(panels.SECTORS)
    out = {
        "unmatched": lost.select(plan.code, plan.name),
        "dashboard_panel": rollup.with_national_shares(dashboard, shares, group_count=groups),
        "mun_sector_wide": reshape.wide_panel(kept_once, muni_ids, plan.layout),
        "state_sector_wide": reshape.wide_panel(by_state, STATE_IDS, plan.layout),
    }
    if plan.status:
        occupation = (panels.OCCUPATION,)
        out["mun_occupation_wide"] = reshape.wide_panel(kept, muni_ids, plan.layout, occupation)
        out["state_occupation_wide"] = reshape.wide_panel(by_state, STATE_IDS, plan.layout, occupation)
    return out


def comparison_panels(
    census_1872: DataFrame, census_1920: DataFrame, crosswalk: DataFrame, quality: FlowQuality | None = None,
) -> dict[str, DataFrame]:
    """Comparable-area and state panels with all change metrics."""
    counts_1872 = naming.with_prefix(census_1872.columns, LAYOUT_1872.count_prefixes)
    counts_1920 = naming.starting_with(census_1920.columns, COMPARED_STEMS_1920)
    ident = "muni_malha_id"
    watch = {year: quality.stage(f"comparison {year}: areas of codes") if quality else None for year in ("1872", "1920")}
    areas = compare.two_period_panel(
        (rollup.rollup_by_crosswalk(census_1872, ident, crosswalk, counts_1872, watch=watch["1872"]), LAYOUT_1872, "1872"),
        (rollup.rollup_by_crosswalk(census_1920, ident, crosswalk, counts_1920, watch=watch["1920"]), LAYOUT_1920, "1920"),
        "code_amc",
    )
    parents = xw.majority_parent(census_1872, ident, crosswalk, id_prefix(F.col(ident)))
    by_state = compare.two_period_panel(
        (rollup.rollup_by_prefix(census_1872, ident, counts_1872), LAYOUT_1872, "1872"),
        (rollup.rollup_by_prefix(census_1920, ident, counts_1920), LAYOUT_1920, "1920"),
        "state_code", missing_key_matches=True,
    )
    return {
        "transformation_panel": areas.join(parents, "code_amc", "left"),
        "state_transformation_panel": by_state,
    }


def regression_tables(panel: DataFrame, names: DataFrame) -> dict[str, DataFrame]:
    """Per-state and national fits of every outcome on the exposure."""
    moments = regression.pair_moments(panel, EXPOSURE, compare.OUTCOMES, "state_code")
    by_state = regression.group_fits(moments, "state_code").join(
        F.broadcast(names), "state_code", "left"  # fixed 21-row lookup
    )
    national = regression.national_fits(moments, "state_code")
    return {"regression_results": by_state, "regression_results_national": national}


def area_crosswalk(spark: SparkSession, folder: str, raw: Callable[[], DataFrame], **settings: object) -> DataFrame:
    """Exploded crosswalk of these settings (such as start and end year), built from code lists at the first call only."""
    return reuse_or_build(spark, folder, "crosswalk", settings, lambda: xw.explode_crosswalk(raw()))


def build_all(
    spark: SparkSession, census_1872: DataFrame, census_1920: DataFrame,
    lookup_1872: DataFrame, lookup_1920: DataFrame, crosswalk: DataFrame | Callable[[], DataFrame], out: str,
) -> dict[str, str]:
    """Run both flows and store every table under ``out``; returns the paths.

    ``crosswalk`` is exploded, or a function that gives its code lists: then
    the exploded table is kept under ``out`` and reused by later builds.
    Later stages read the stored comparison panel, so lineage is cut by a
    written table and a lost executor never repeats the whole flow.  The table
    ``flow_quality`` holds what was counted on the way.
    """
    paths: dict[str, str] = {}
    quality = FlowQuality()

    def keep(name: str, df: DataFrame) -> DataFrame:
        paths[name] = f"{out.rstrip('/')}/{name}"
        store.write_panel(quality.watch(df, f"table {name}"), paths[name])
        return store.read_panel(spark, paths[name])

    if not isinstance(crosswalk, DataFrame):
        crosswalk = area_crosswalk(spark, out.rstrip("/"), crosswalk, start=1872, end=1920)
    for suffix, table, lookup, plan, year in (
        ("", census_1872, lookup_1872, PLAN_1872, "1872"), ("_1920", census_1920, lookup_1920, PLAN_1920, "1920"),
    ):
        for name, df in census_panels(table, lookup, plan, quality, year).items():
            keep(name + suffix, df)
    panels_ = comparison_panels(census_1872, census_1920, crosswalk, quality)
    compared = {n: keep(n, df) for n, df in panels_.items()}
    for name, df in regression_tables(compared["transformation_panel"], compared_states(spark)).items():
        keep(name, df)
    report = quality.report(spark)
    paths["flow_quality"] = f"{out.rstrip('/')}/flow_quality"
    store.write_panel(report, paths["flow_quality"])
    return paths


def export_all(spark: SparkSession, paths: dict[str, str], out: str, layout: str = export.DOCUMENT) -> None:
    """JSON exports of the stored tables.

    The published files are one document each, which one task writes; with
    ``export.STRIPES`` many tasks write the columnar ones, with
    ``export.CHUNKS`` all are lines of bounded length.
    """
    records = export.DOCUMENT if layout == export.DOCUMENT else export.CHUNKS
    read = {name: store.read_panel(spark, path) for name, path in paths.items()}
    key = ["geography_level", "geography_id", "group_type", "group_id"]
    short = {long: name for name, long in export.SHORT_NAMES.items()}
    order = [short[k] for k in key]
    base = out.rstrip("/")
    export.write_columnar_json(
        export.short_panel(read["dashboard_panel"], export.STATUS_MEASURES), f"{base}/panel_1872.json", order, layout=layout)
    export.write_columnar_json(
        export.short_panel(read["dashboard_panel_1920"], export.PLAIN_MEASURES), f"{base}/panel_1920.json", order, layout=layout)
    export.write_columnar_json(
        export.change_export(read["transformation_panel"], ["code_amc", "state_code"]),
        f"{base}/transformation_amc.json", ["code_amc"], layout=layout)
    named = read["state_transformation_panel"].join(F.broadcast(compared_states(spark)), "state_code", "left")
    export.write_columnar_json(
        export.change_export(named, ["state_code", "state_name"]),
        f"{base}/transformation_state.json", ["state_code"], layout=layout)
    export.write_record_json(
        read["regression_results"].select("state_code", "state_name", "y_metric", "n_amc", *export.FIT_EXPORT),
        f"{base}/regression_state.json", ["y_metric", "state_code"], layout=records)
    export.write_record_json(
        read["regression_results_national"].select("model", "y_metric", "n_obs", *export.FIT_EXPORT),
        f"{base}/regression_national.json", ["y_metric", "model"], layout=records)
