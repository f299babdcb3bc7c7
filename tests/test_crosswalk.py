from helpers import initial_plan, one, rows
from pyspark.sql import functions as F

from panelspan.functions.text import id_prefix
from panelspan.operators import crosswalk as xw
from panelspan.operators import rollup

RAW = "SELECT * FROM VALUES ('A', '11, 12,13'), ('B', NULL), ('C', '13 ,21') AS t(code_amc, list_code_muni_2010)"
TABLE = """SELECT * FROM VALUES (11D, 1D, NULL), (12D, 2D, 5D), (13D, 4D, NULL), (99D, 8D, 1D), (NULL, 16D, 1D)
           AS t(muni_malha_id, n, m)"""


def crosswalk(spark):
    return xw.explode_crosswalk(spark.sql(RAW))


def test_lists_explode_trimmed(spark):
    out = crosswalk(spark)
    assert sorted(rows(out)) == [("A", "11"), ("A", "12"), ("A", "13"), ("C", "13"), ("C", "21")]
    assert "Exchange" not in initial_plan(out)


def test_rollup_counts_a_code_in_each_of_its_areas(spark):
    table = spark.sql(TABLE)
    for unique in (False, True):
        out = rollup.rollup_by_crosswalk(table, "muni_malha_id", crosswalk(spark), ["n", "m"], unique_ids=unique)
        assert sorted(rows(out)) == [("A", 7.0, 5.0), ("C", 4.0, 0.0)]


def test_rollup_survives_a_hot_code(spark):
    # One code holds nearly all rows; it is summed before the join.
    table = spark.range(20_000).select(F.when(F.col("id") < 19_000, 13).otherwise(F.col("id") % 3 + 11)
                                       .cast("double").alias("muni_malha_id"), F.lit(1.0).alias("n"))
    out = dict(rows(rollup.rollup_by_crosswalk(table, "muni_malha_id", crosswalk(spark), ["n"])))
    hot = table.where("muni_malha_id = 13").count()
    assert out == {"A": 20_000.0, "C": float(hot)}


def test_long_ids_join_long_codes_unchanged(spark):
    table = spark.sql("SELECT 11L AS id, 2D AS n UNION ALL SELECT 12L, 3D")
    areas = spark.sql("SELECT 'A' AS code_amc, 11L AS muni_code")
    assert rows(rollup.rollup_by_crosswalk(table, "id", areas, ["n"])) == [("A", 2.0)]


def test_unmatched_and_inner_are_complementary(spark):
    table, areas = spark.sql(TABLE), crosswalk(spark)
    lost = xw.unmatched(table, "muni_malha_id", areas)
    assert sorted(r.n for r in lost.collect()) == [8.0, 16.0]
    codes = areas.select("muni_code").distinct()
    kept = table.withColumn("muni_code", xw.code_of(table, "muni_malha_id", areas)).join(codes, "muni_code", "left_semi")
    assert kept.count() + lost.count() == table.count()


def test_attach_geography(spark):
    table = spark.sql("SELECT * FROM VALUES ('1', 5), ('2', 6) AS t(code, n)")
    lookup = spark.sql("SELECT * FROM VALUES ('1', 35), ('3', 31) AS t(code, code_state)")
    matched, lost = xw.attach_geography(table, lookup, "code")
    assert rows(matched) == [("1", 5, 35)] and rows(lost) == [("2", 6, None)]


def test_majority_ties_go_to_the_lowest_state(spark):
    table = spark.sql("""SELECT * FROM VALUES (3501, 1), (3502, 1), (3101, 1), (3102, 1), (2901, 2), (3503, 3)
                         AS t(id, x)""")
    areas = spark.sql("""SELECT * FROM VALUES ('T', '3501'), ('T', '3502'), ('T', '3101'), ('T', '3102'),
                         ('U', '2901'), ('U', '3501'), ('U', '3502'), ('V', '9999') AS t(code_amc, muni_code)""")
    for unique in (False, True):
        out = xw.majority_parent(table, "id", areas, id_prefix(F.col("id")), unique_ids=unique)
        assert sorted(rows(out)) == [("T", "31"), ("U", "35")]
        assert "Window" not in initial_plan(out)


def test_quality_report(spark):
    report = xw.quality_report([("census", spark.sql(TABLE), "muni_malha_id")], crosswalk(spark),
                               [("panel", spark.range(7))])
    assert {r.check: (r.n, r.total) for r in report.collect()} == {
        "crosswalk: codes in several areas": (1, 4),
        "census: rows without area": (2, 5),
        "panel: rows": (7, 7),
    }


def test_summary(spark):
    assert tuple(one(xw.crosswalk_summary(crosswalk(spark)))) == (5, 2)
    assert tuple(one(xw.crosswalk_summary(crosswalk(spark), approximate=True))) == (5, 2)


def test_prefix_rollup_keeps_missing_ids(spark):
    out = rollup.rollup_by_prefix(spark.sql(TABLE), "muni_malha_id", ["n"], width=1)
    assert sorted(rows(out), key=str) == [("1", 7.0), ("9", 8.0), (None, 16.0)]
