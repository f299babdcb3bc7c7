import numpy as np
import pytest
from helpers import initial_plan, one, rows
from pyspark.sql import functions as F

from panelspan.operators import regression as reg


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    data = []
    for state in range(6):
        for _ in range(25 + state):
            x = float(rng.normal(state * 0.3, 1))
            y = None if rng.random() < 0.1 else float(0.4 * x + state * 0.2 + rng.normal())
            data.append((str(state), x, y, float(rng.normal())))
    data += [(None, 1.0, 2.0, 3.0), ("6", 5.0, 1.0, None)]
    return spark.createDataFrame(data, "state_code string, x double, y double, z double"), data


def z(values):
    return (values - values.mean()) / values.std(ddof=1)


def least_squares(design, y):
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    left = y - design @ beta
    df = len(y) - design.shape[1]
    se = np.sqrt(left @ left / df * np.diag(np.linalg.inv(design.T @ design)))
    return beta, se, df


def test_group_fits_equal_least_squares(spark, sample):
    df, data = sample
    fits = {(r.state_code, r.y_metric): r for r in
            reg.group_fits(reg.pair_moments(df, "x", ["y", "z"], "state_code"), "state_code").collect()}
    assert set(fits) == {(str(s), m) for s in range(6) for m in "yz"}
    for (state, metric), fit in fits.items():
        pairs = np.array([(r[1], r[2 + "yz".index(metric)]) for r in data
                          if r[0] == state and r[2 + "yz".index(metric)] is not None])
        x, y = z(pairs[:, 0]), z(pairs[:, 1])
        beta, se, _ = least_squares(np.column_stack([np.ones_like(x), x]), y)
        assert fit.n_amc == len(x)
        assert fit.coef == pytest.approx(beta[1], abs=1e-12) and fit.se == pytest.approx(se[1], abs=1e-12)
        assert fit.t_value == pytest.approx(beta[1] / se[1], abs=1e-9)
        assert (fit.ci_lower + fit.ci_upper) / 2 == pytest.approx(fit.coef)


def test_national_fits_equal_dummy_regression(spark, sample):
    df, data = sample
    fits = {(r.model, r.y_metric): r for r in reg.national_fits(
        reg.pair_moments(df, "x", ["y", "z"], "state_code"), "state_code").collect()}
    for i, metric in enumerate("yz"):
        kept = [r for r in data if r[0] is not None and r[2 + i] is not None]
        x, y = z(np.array([r[1] for r in kept])), z(np.array([r[2 + i] for r in kept]))
        states = sorted({r[0] for r in kept})
        dummies = np.array([[float(r[0] == s) for s in states] for r in kept])
        beta, se, _ = least_squares(np.column_stack([np.ones_like(x), x]), y)
        pooled = fits["pooled", metric]
        assert (pooled.coef, pooled.se) == (pytest.approx(beta[1], abs=1e-12), pytest.approx(se[1], abs=1e-12))
        beta, se, _ = least_squares(np.column_stack([x, dummies]), y)
        within = fits["state_fe", metric]
        assert (within.coef, within.se) == (pytest.approx(beta[0], abs=1e-12), pytest.approx(se[0], abs=1e-12))
        assert within.n_obs == pooled.n_obs == len(kept)


# Published pooled fits over 462 areas, four decimals.
PUBLISHED = (
    # coef, se, ci_lower, ci_upper, p
    (0.1353, 0.0462, 0.0446, 0.2261, 0.0036), (0.0472, 0.0466, -0.0444, 0.1387, 0.3118),
    (-0.1919, 0.0458, -0.2818, -0.102, 0.0), (-0.1117, 0.0463, -0.2028, -0.0207, 0.0163),
)


def test_published_pooled_inference(spark):
    df = spark.createDataFrame([(r[0], i) for i, r in enumerate(PUBLISHED)], "coef double, i int").withColumns({
        "se": F.sqrt((1 - F.col("coef") ** 2) / 460), "df": F.lit(460)})
    for row in reg.with_inference(df).collect():
        expected = PUBLISHED[row.i]
        for got, want in zip((row.coef, row.se, row.ci_lower, row.ci_upper, row.p_value), expected):
            assert got == pytest.approx(want, abs=5e-4)


def test_gates(spark):
    def block(state, pairs):
        return [(state, *p) for p in pairs]

    line = [(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (4.0, 3.0), (5.0, 6.0)]
    data = (block("n4", line[:4]) + block("n5", line) + block("xconst", [(0.1, y) for _, y in line])
            + block("yconst", [(x, 0.1) for x, _ in line])
            + block("nulls", [*line[:4], (None, 1.0), (1.0, None)])
            + block("exact", [(x, 2 * x) for x, _ in line]))
    df = spark.createDataFrame(data, "state_code string, x double, y double")
    fits = {r.state_code: r for r in reg.group_fits(
        reg.pair_moments(df, "x", ["y"], "state_code"), "state_code").collect()}
    assert set(fits) == {"n5", "exact"}
    perfect = fits["exact"]
    assert perfect.coef == pytest.approx(1.0) and perfect.p_value == pytest.approx(0.0, abs=1e-9)


def test_unidentified_fixed_effects_are_missing(spark):
    data = [(str(s), float(s), float(s * i % 5)) for s in range(4) for i in range(4)]
    df = spark.createDataFrame(data, "state_code string, x double, y double")
    fits = {r.model: r for r in reg.national_fits(
        reg.pair_moments(df, "x", ["y"], "state_code"), "state_code").collect()}
    assert fits["state_fe"].coef is None and fits["state_fe"].p_value is None
    assert fits["pooled"].coef is not None


def test_constant_exposure_gives_no_national_fit(spark):
    df = spark.range(40).select((F.col("id") % 3).cast("string").alias("state_code"), F.lit(0.1).alias("x"),
                                F.col("id").cast("double").alias("y"))
    assert rows(reg.national_fits(reg.pair_moments(df, "x", ["y"], "state_code"), "state_code")) == []


def test_one_state_fixed_effects_equal_pooled(spark, sample):
    df = sample[0].where("state_code = '3'")
    fits = {r.model: r for r in reg.national_fits(
        reg.pair_moments(df, "x", ["z"], "state_code"), "state_code").collect()}
    assert fits["state_fe"].coef == pytest.approx(fits["pooled"].coef)
    assert fits["state_fe"].se == pytest.approx(fits["pooled"].se)


def test_data_is_shuffled_once(spark, sample):
    moments = reg.pair_moments(sample[0], "x", ["y", "z"], "state_code")
    assert initial_plan(moments).count("Exchange hashpartitioning") == 1
    assert initial_plan(reg.group_fits(moments, "state_code")).count("Exchange") == 1


def test_forest_table_ranks_by_coefficient(spark):
    fits = spark.sql("SELECT * FROM VALUES ('a', 'm', 0.3D, 0.2D), ('b', 'm', -1D, 0.01D), ('c', 'm', NULL, NULL) "
                     "AS t(state_code, y_metric, coef, p_value)")
    out = {r.state_code: r for r in reg.forest_table(fits, ["y_metric"]).collect()}
    assert [(out[s].position, out[s].significant) for s in "bac"] == [(1, True), (2, False), (3, None)]


def test_band(spark, sample):
    df = sample[0].where("state_code = '2'")
    pairs = np.array([(r.x, r.z) for r in df.collect()])
    x, y = pairs[:, 0], pairs[:, 1]
    slope, intercept = np.polyfit(x, y, 1)
    band = {r.point: r for r in reg.fitted_band(df, "x", "z", points=5).collect()}
    assert len(band) == 5 and band[0].x == x.min() and band[4].x == pytest.approx(x.max())
    sigma = np.sqrt(((y - intercept - slope * x) ** 2).sum() / (len(x) - 2))
    for r in band.values():
        assert r.fit == pytest.approx(intercept + slope * r.x)
        se = sigma * np.sqrt(1 / len(x) + (r.x - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum())
        assert r.se == pytest.approx(se) and r.lower < r.fit < r.upper


def test_standardised(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 1D), ('a', 3D), ('b', 2D), ('b', 2D), (NULL, 1D), (NULL, 2D) AS t(k, v)")
    out = sorted(rows(reg.standardised(df, ["v"], "k")), key=str)
    assert out[0][2] == pytest.approx(-(0.5 ** 0.5)) and out[2][2] is None and out[4][2] is not None
    whole = reg.standardised(df, ["v"])
    moments = one(whole.agg(F.avg("v_std"), F.stddev_samp("v_std")))
    assert moments[0] == pytest.approx(0.0, abs=1e-12) and moments[1] == pytest.approx(1.0)
