import pytest
from helpers import one, rows
from pyspark.sql import functions as F

from panelspan.operators import compare
from panelspan.operators.panels import ExactLayout
from panelspan.plans.census import LAYOUT_1872

# Published state figures, 1872 and 1920, six decimals.
INPUTS = ("mfg_share_1872", "agr_share_1872", "serv_share_1872", "literacy_rate_1872",
          "mfg_share_1920", "agr_share_1920", "serv_share_1920", "non_agr_share_1920",
          "mfg_agr_ratio_1920", "literacy_rate_1920")
OUTPUTS = ("mfg_share_change_pp", "mfg_share_log_ratio", "mfg_share_cagr", "mfg_share_logit_change",
           "non_agr_share_change_pp", "mfg_agr_ratio_change", "structural_change_index",
           "agr_exit_share", "serv_share_change_pp", "literacy_rate_change_pp")
PUBLISHED = {
    "13": ((0.088089, 0.379311, 0.5326, 0.132147, 0.04596, 0.456907, 0.497133, 0.543093, 0.100589, 0.266033),
           (-0.042129, -0.65058, -0.013462, -0.695743, -0.077596, -0.131645, 0.155191, -0.077596, -0.035467,
            0.133885)),
    "30": ((0.098246, 0.10864, 0.793114, 0.3618, 0.196255, 0.038977, 0.764768, 0.961023, 5.035123, 0.618903),
           (0.098009, 0.691939, 0.01452, 0.806999, 0.069663, 4.130797, 0.196018, 0.069663, -0.028346, 0.257102)),
    "35": ((0.05662, 0.599673, 0.343707, 0.168592, 0.086761, 0.33396, 0.579279, 0.66604, 0.259794, 0.298243),
           (0.030141, 0.426792, 0.008931, 0.459264, 0.265713, 0.165376, 0.531425, 0.265713, 0.235572, 0.129651)),
}


def test_published_states(spark):
    data = [(code, *inputs) for code, (inputs, _) in PUBLISHED.items()]
    df = spark.createDataFrame(data, "state_code string, " + ", ".join(f"{c} double" for c in INPUTS)).withColumns({
        "mfg_total_1872": F.col("mfg_share_1872"), "agr_total_1872": F.col("agr_share_1872"),
        "non_agr_share_1872": 1 - F.col("agr_share_1872"),
        "pop_total_1872": F.lit(1.0), "pop_total_1920": F.lit(2.0),
    })
    for row in compare.change_metrics(df).collect():
        for name, expected in zip(OUTPUTS, PUBLISHED[row.state_code][1]):
            assert row[name] == pytest.approx(expected, abs=2e-5), name
        assert row.pop_growth_rate == pytest.approx(0.0144405661, abs=1e-9)


LATER = ExactLayout("pop", "lit", "occ", "occ", "occ", {"male": ("agr",), "female": ()}, {"male": ("mfg",), "female": ()})


def accounts(spark):
    first = spark.sql("""SELECT * FROM VALUES
        ('x', 100D, 40D, 30D, 50D, 20D, 10D, 8D, 4D), ('y', 0D, 0D, 0D, 0D, 0D, 0D, 0D, 0D),
        (NULL, 10D, 1D, 1D, 9D, 4D, 8D, 1D, 1D)
        AS t(k, soma_g_almas, soma_e_almas, soma_g_sabemlereescrever, soma_g_profagric, soma_g_lavradores,
             soma_g_emmetais, soma_e_lavradores, soma_e_emmetais)""")
    second = spark.sql("""SELECT * FROM VALUES ('x', 200D, 90D, 60D, 10D, 30D), ('y', 5D, 1D, NULL, 1D, 1D),
        ('z', 1D, 1D, 1D, 1D, 1D), (NULL, 2D, 1D, 2D, 1D, 1D) AS t(k, pop, lit, occ, agr, mfg)""")
    return first, second


def test_accounts(spark):
    first, _ = accounts(spark)
    out = {r.k: r for r in compare.sector_accounts(first, "k", LAYOUT_1872, "1872").collect()}
    x = out["x"]
    assert (x.enslaved_share_1872, x.enslaved_agr_share_1872, x.enslaved_mfg_share_1872) == (0.4, 0.4, 0.4)
    assert (x.mfg_share_1872, x.agr_share_1872, x.serv_share_1872) == (0.2, 0.4, 0.4)
    assert out["y"].agr_share_1872 is None and out["y"].non_agr_share_1872 == 0.0
    assert out[None].serv_total_1872 == 0.0  # 9 - 4 - 8 is clamped
    assert len(x) == 1 + 15


def test_two_periods(spark):
    first, second = accounts(spark)
    args = ((first, LAYOUT_1872, "1872"), (second, LATER, "1920"), "k")
    panel = compare.two_period_panel(*args)
    assert len(panel.columns) == 1 + 15 + 13 + 12
    got = {r.k: r for r in panel.collect()}
    assert set(got) == {"x", "y"}
    assert got["x"].structural_change_index == pytest.approx(abs(.5 - .2) + abs(10 / 60 - .4) + abs(20 / 60 - .4))
    assert got["y"].mfg_share_log_ratio is None and got["y"].pop_growth_rate is None
    assert got["y"].mfg_share_change_pp is None and got["y"].non_agr_share_change_pp == 0.0
    null_safe = compare.two_period_panel(*args, missing_key_matches=True)
    assert {r.k for r in null_safe.collect()} == {"x", "y", None}
    assert set(null_safe.columns) == set(panel.columns)


def test_shares_sum_to_one_when_not_clamped(spark):
    first, _ = accounts(spark)
    df = compare.sector_accounts(first, "k", LAYOUT_1872, "a").where("k = 'x'")
    assert one(df.select(F.col("mfg_share_a") + F.col("agr_share_a") + F.col("serv_share_a")))[0] == pytest.approx(1.0)


def test_joining_rollups_needs_no_further_shuffle(spark):
    from panelspan.operators.rollup import rollup

    first, second = accounts(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = rollup(first, ["k"], first.columns[1:])
        b = rollup(second, ["k"], second.columns[1:])
        panel = compare.two_period_panel((a, LAYOUT_1872, "1872"), (b, LATER, "1920"), "k")
        text = panel._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" in text
        assert len(rows(panel)) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
