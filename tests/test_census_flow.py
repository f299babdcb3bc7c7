"""Both census years end to end on small synthetic tables."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from panelspan.plans import census as c

random.seed(1)
PREFIXES = ("soma_g", "soma_l", "soma_e", "h_livres", "m_livres", "h_escr", "m_escr")
NAMES = ("almas", "sabemlereescrever", *dict.fromkeys(
    [*c.LAYOUT_1872.broad, *(g.patterns[0] for g in c.OCCUPATIONS)]))
IDS = [state * 100_000 + i for state in (13, 15, 29, 31, 35) for i in range(8)]
BROAD = set(c.LAYOUT_1872.broad)
BIG = ("popmun20", "pia20", "peasetth", "peasettm")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("flow"))
    wide = [f"{p}_{n}" for p in PREFIXES for n in NAMES]
    first = spark.createDataFrame(
        # Broad groups are large enough to leave services a residual.
        [(float(i), f"m{i}", *[float(random.randint(0, 50) + (300 if n.split("_")[-1] in BROAD else 0))
                               for n in wide]) for i in IDS],
        "muni_malha_id double, municipio string, " + ", ".join(f"{n} double" for n in wide))
    later = ["popmun20", "popalf20", "pia20", "peasettt", "peasetth", "peasettm",
             *[f"peaset{k}{s}" for k in range(1, 23) for s in "hm"]]
    second = spark.createDataFrame(
        [(i, f"m{i}", *[float(random.randint(0, 50) + (900 if n in BIG else 0)) for n in later])
         for i in [*IDS, 1200001]],
        "muni_malha_id long, nommun20 string, " + ", ".join(f"{n} double" for n in later))
    tables = {}
    for name, df in (("first", first), ("second", second)):
        df.write.parquet(f"{base}/{name}")
        tables[name] = spark.read.parquet(f"{base}/{name}")

    def lookup(code, year):
        codes = tables["second"].select(F.col("muni_malha_id").cast("string").alias(code),
                                        F.col("nommun20").alias("name_muni_map"))
        coded = codes.where(F.col(code) != "1300000").withColumn("code_state", F.substring(code, 1, 2).cast("int"))
        return coded.join(c.states(spark, year), "code_state").select(
            code, "name_muni_map", "code_state", "abbrev_state", "name_state")

    crosswalk = tables["second"].select(
        F.floor(F.col("muni_malha_id") / 2).alias("code_amc"),
        F.col("muni_malha_id").cast("string").alias("muni_code"))
    lists = crosswalk.where("muni_code <> '1300001'").groupBy("code_amc").agg(F.concat_ws(", ", F.collect_list("muni_code")).alias("list_code_muni_2010"))
    paths = c.build_all(spark, tables["first"], tables["second"], lookup("code_muni_1872", 1872),
                        lookup("code_muni_1920", 1920), lambda: lists, f"{base}/build")
    c.export_all(spark, paths, f"{base}/docs")
    return {name: spark.read.parquet(path) for name, path in paths.items()}, f"{base}/docs", base


def test_sizes(stored):
    tables, _, _ = stored
    assert {n: (df.count(), len(df.columns)) for n, df in tables.items()} == {
        "unmatched": (1, 2), "dashboard_panel": ((39 + 5) * 41, 44),
        "mun_sector_wide": (39, 6 + 1 + 18), "state_sector_wide": (5, 3 + 1 + 18),
        "mun_occupation_wide": (39, 6 + 1 + 6 * 38), "state_occupation_wide": (5, 3 + 1 + 6 * 38),
        "unmatched_1920": (1, 2), "dashboard_panel_1920": ((40 + 6) * 3, 38),
        "mun_sector_wide_1920": (40, 6 + 1 + 12), "state_sector_wide_1920": (6, 3 + 1 + 12),
        "transformation_panel": (20, 42), "state_transformation_panel": (5, 41),
        "regression_results": (0, 10), "regression_results_national": (22, 9), "flow_quality": (24, 3),
    }


def test_quality_of_the_flow(stored):
    tables, _, _ = stored
    counts = {(r.stage, r.measure): r.n for r in tables["flow_quality"].collect()}
    assert counts["census 1872: geography", "rows"] == 40 and counts["census 1872: geography", "unmatched"] == 1
    assert counts["census 1872: kept", "rows"] == 39 and counts["census 1920: kept", "rows"] == 40
    assert counts["comparison 1872: areas of codes", "unmatched"] == 1 and counts["comparison 1872: areas of codes", "rows"] == 40
    assert counts["comparison 1920: areas of codes", "rows"] == 41
    for name, df in tables.items():
        if name != "flow_quality":
            assert counts[f"table {name}", "rows"] == df.count(), name


def test_crosswalk_is_built_once(spark, tmp_path):
    built = []

    def raw():
        built.append(1)
        return spark.createDataFrame([(1, "a, b"), (2, "c")], "code_amc long, list_code_muni_2010 string")

    for start, times in ((1872, 1), (1872, 1), (1900, 2)):
        assert c.area_crosswalk(spark, str(tmp_path), raw, start=start, end=1920).count() == 3 and len(built) == times


def test_state_universes_differ(stored):
    """Panels drop unmatched rows, the comparison uses every row by id prefix."""
    tables, _, _ = stored
    panel = tables["dashboard_panel"].where("geography_level = 'State' AND geography_id = '13'")
    (matched,) = {r.pop_total for r in panel.collect()}
    every = tables["state_transformation_panel"].where("state_code = '13'").first().pop_total_1872
    assert matched < every


def test_exports(stored):
    _, docs, _ = stored

    def document(name):
        (part,) = [p for p in os.listdir(f"{docs}/{name}") if p.startswith("part-")]
        return json.loads(open(f"{docs}/{name}/{part}", encoding="utf-8").read())

    state = document("transformation_state.json")
    assert len(state) == 27 and state["state_code"] == ["13", "15", "29", "31", "35"]
    assert state["state_name"][1] == "Para"
    panel = document("panel_1872.json")
    assert len(panel) == 41 and {len(v) for v in panel.values()} == {44 * 41}
    assert len(document("panel_1920.json")) == 26
    fits = document("regression_national.json")
    assert len(fits) == 22 and set(fits[0]) == {
        "model", "y_metric", "n_obs", "coef", "se", "ci_lower", "ci_upper", "p_value"}


def test_state_tables(spark):
    assert c.states(spark, 1872).count() == 21 and c.states(spark, 1920).count() == 22
    renamed = {r.code_state: r.name_state for r in c.states(spark, 1920).collect()}
    assert renamed[30] == "Districto Federal" and renamed[12] == "Território do Acre"
    names = {r.state_code: r.state_name for r in c.compared_states(spark).collect()}
    assert names["30"] == "Municipio Neutro" and names["27"] == "Alagoas" and names["35"] == "Sao Paulo"
