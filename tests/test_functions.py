import math

import pytest
from helpers import one, rows
from pyspark.sql import functions as F

from panelspan.functions import guarded as g
from panelspan.functions import text
from panelspan.functions.student_t import critical_value, two_sided_p


def near(value, expected, tolerance=1e-12):
    return value == pytest.approx(expected, abs=tolerance)


def test_ratio_needs_a_positive_known_denominator(spark):
    df = spark.sql("SELECT * FROM VALUES (1D, 2D), (1D, 0D), (1D, -2D), (NULL, 2D), (1D, NULL) AS t(a, b)")
    assert [r[0] for r in rows(df.select(g.ratio(F.col("a"), F.col("b"))))] == [0.5, None, None, None, None]


def test_row_total_counts_missing_as_zero(spark):
    df = spark.sql("SELECT * FROM VALUES (1D, 2D), (NULL, 2D), (NULL, NULL) AS t(a, `b c`)")
    assert [r[0] for r in rows(df.select(g.row_total(["a", "b c"])))] == [3.0, 2.0, 0.0]
    assert [r[0] for r in rows(df.select(g.row_total([])))] == [0.0, 0.0, 0.0]


def test_group_total_of_missing_is_zero(spark):
    df = spark.sql("SELECT * FROM VALUES ('x', CAST(NULL AS DOUBLE)), ('x', NULL), ('y', 3D) AS t(k, v)")
    assert sorted(rows(df.groupBy("k").agg(g.group_total("v")))) == [("x", 0.0), ("y", 3.0)]


def test_clamps_keep_missing(spark):
    df = spark.sql("SELECT * FROM VALUES (-1D), (2D), (NULL) AS t(x)")
    assert [r[0] for r in rows(df.select(g.floor_at_zero(F.col("x"))))] == [0.0, 2.0, None]
    assert [r[0] for r in rows(df.select(F.expr(g.residual_sql("x", "1D"))))] == [0.0, 1.0, None]


def test_portion_turns_undefined_into_zero(spark):
    df = spark.sql("SELECT * FROM VALUES (0D, 0D), (1D, 4D), (NULL, 4D), (1D, NULL) AS t(a, b)")
    assert [r[0] for r in rows(df.select(g.portion(F.col("a"), F.col("b"))))] == [0.0, 0.25, 0.0, 0.0]


def test_filter_drops_unknown(spark):
    from panelspan.operators.panels import empty_rows_dropped

    df = spark.sql("SELECT * FROM VALUES (1, 0D, NULL), (2, NULL, NULL), (3, NULL, 1D), (4, 0D, 0D) AS t(id, a, b)")
    assert [r[0] for r in rows(empty_rows_dropped(df, ["a", "b"]))] == [3]


def test_growth_and_logit_guards(spark):
    df = spark.sql("SELECT * FROM VALUES (0.2D, 0.4D), (0D, 0.4D), (0.2D, 0D), (NULL, 0.4D), (0.2D, 1D) AS t(a, b)")
    a, b = F.col("a"), F.col("b")
    out = rows(df.select(g.log_ratio(a, b), g.compound_growth(a, b, 48), g.log_growth(a, b, 48), g.logit_shift(a, b)))
    assert near(out[0][0], math.log(2)) and near(out[0][1], 2 ** (1 / 48) - 1)
    assert near(out[0][2], math.log(2) / 48) and near(out[0][3], math.log(0.4 / 0.6) - math.log(0.2 / 0.8))
    assert out[1] == out[2] == out[3] == (None, None, None, None)
    assert out[4][0] is not None and out[4][3] is None


def test_logit_is_clamped(spark):
    df = spark.sql("SELECT * FROM VALUES (0D), (1D), (0.5D), (NULL) AS t(p)")
    out = [r[0] for r in rows(df.select(g.logit(F.col("p"))))]
    limit = math.log((1 - 1e-8) / 1e-8)
    assert near(out[0], -limit, 1e-6) and near(out[1], limit, 1e-6) and near(out[2], 0.0) and out[3] is None


def test_absolute_shift_needs_every_value(spark):
    df = spark.sql("SELECT * FROM VALUES (0.2D, 0.5D, 0.1D, 0D), (NULL, 0.5D, 0.1D, 0D) AS t(a, b, c, d)")
    pairs = [(F.col("a"), F.col("b")), (F.col("c"), F.col("d"))]
    out = [r[0] for r in rows(df.select(g.absolute_shift(pairs)))]
    assert near(out[0], 0.4) and out[1] is None


def test_ids_keep_their_digits(spark):
    df = spark.sql("SELECT * FROM VALUES (15001070D), (1500107D), (NULL) AS t(id)")
    assert rows(df.select(text.id_code(F.col("id")), text.id_prefix(F.col("id")))) == [
        ("15001070", "15"), ("1500107", "15"), (None, None)]


NAMES = ["Soma_G_Em Metáis", "São Paulo", "Straße", "Œuvre_1", "ÀÉÎÕÜç", "a-b.c d", "Ñandú", "ĳs©", "tab\tnul\x00end\x7f", "плюс1 日本_x", "", "K\u212a", "İx"]


def test_names_fold_alike_on_driver_and_executors(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    assert [r[0] for r in rows(df.select(text.folded(F.col("n"))))] == [text.fold_name(n) for n in NAMES]
    assert text.fold_name(NAMES[0]) == "soma_g_emmetais"
    assert text.fold_name("Straße") == "strasse"


def test_display_formats(spark):
    df = spark.sql("SELECT * FROM VALUES (0.1234D), (0.0025D), (NULL), (12.5D), (-0.00001D), (1234567.5D) AS t(x)")
    out = rows(df.select(text.percent_text(F.col("x")), text.count_text(F.col("x")), text.plain_text(F.col("x"))))
    assert [r[0] for r in out[:5]] == ["12.3%", "0.2%", "No data", "1 250.0%", "0.0%"]
    assert [r[1] for r in out] == ["0", "0", "No data", "12", "0", "1,234,568"]
    assert [r[2] for r in out] == ["0.1234", "0.0025", None, "12.5", "0", "1234567.5"]


def test_plain_numbers_take_the_shorter_form(spark):
    shown = {0.0001: "1e-04", -0.0003: "-3e-04", 100000.0: "1e+05", 0.0012: "0.0012", 123456.0: "123456", 1000.0: "1000", 0.0: "0",
             10.0: "10", -2.5: "-2.5", 1.5e13: "1.5e+13", 0.00004: "0", -200000.0: "-2e+05", 100.5: "100.5"}
    df = spark.createDataFrame([(x,) for x in shown], "x double")
    assert rows(df.select(text.plain_text(F.col("x")))) == [(s,) for s in shown.values()]


def test_digraphs_and_wide_letters_fold(spark):
    df = spark.createDataFrame([("ǆǈŉ",), ("Ａｂ＿９",)], "n string")
    assert rows(df.select(text.folded(F.col("n")))) == [("dzljn",), ("ab_9",)]
    assert [text.fold_name(n) for n in ("ǆǈŉ", "Ａｂ＿９")] == ["dzljn", "ab_9"]


T_TABLE = [  # t, df, two-sided p
    (2.0, 10, 0.0733880348), (2.228138852, 10, 0.05), (12.7062047362, 1, 0.05), (0.0, 5, 1.0),
    (1.96, 600_000, 0.0499962), (-3.182446305, 3, 0.05), (2.62589052, 100, 0.01),
]


def test_two_sided_p_matches_tables(spark):
    df = spark.createDataFrame(T_TABLE, "t double, df int, p double")
    for got, expected in rows(df.select(two_sided_p("t", "df"), "p")):
        assert near(got, expected, 1e-6)


def test_p_is_missing_where_undefined(spark):
    df = spark.sql("SELECT * FROM VALUES (CAST(NULL AS DOUBLE), 4), (1D, 0), (1D, NULL) AS t(t, df)")
    assert [r[0] for r in rows(df.select(two_sided_p("t", "df")))] == [None, None, None]
    assert [r[0] for r in rows(df.select(critical_value("df")))][1:] == [None, None]


def test_critical_values_match_tables(spark):
    table = [(1, 12.7062047), (2, 4.3026527), (3, 3.1824463), (10, 2.2281389), (30, 2.0422725),
             (460, 1.9651345), (600_000, 1.9599679)]
    df = spark.createDataFrame(table, "df int, c double")
    for got, expected in rows(df.select(critical_value("df"), "c")):
        assert near(got, expected, 5e-7)
    assert near(one(spark.sql("SELECT 1 AS df").select(critical_value("df", 0.999)))[0], 636.6192, 1e-3)


@pytest.mark.parametrize("confidence", [0.5, 0.9, 0.999, 0.99999])
def test_critical_value_inverts_p(spark, confidence):
    every = spark.range(1, 60).union(spark.range(60, 5000, 97))
    df = every.withColumnRenamed("id", "df").withColumn("t", critical_value("df", confidence))
    for (p,) in rows(df.select(two_sided_p("t", "df"))):
        assert p == pytest.approx(1 - confidence, rel=1e-7)


def test_many_degrees_of_freedom_approach_the_normal_tail(spark):
    from math import erfc, sqrt
    from statistics import NormalDist

    df = spark.sql("SELECT pow(10D, id) AS df, 1.96D AS t FROM range(6, 15)")
    for d, p, c in df.select("df", two_sided_p("t", "df"), critical_value("df")).collect():
        # first-order term of the expansion in 1 / df
        z, q = 1.96, NormalDist().inv_cdf(0.975)
        density = NormalDist().pdf(z)
        assert abs(p - (erfc(z / sqrt(2)) + density * (z**3 + z) / (2 * d))) < 1e-9
        assert abs(c - (q + (q**3 + q) / (4 * d))) < 1e-9
