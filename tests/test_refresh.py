"""Results kept up to date from stored parts, dictionaries as tables, many slices at once."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from panelspan.operators import dictionary, regression, serving, sketches
from panelspan.operators.quality import FlowQuality
from panelspan.sources import store


def test_merged_moments_are_those_of_all_rows(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), 1e6 + rng.gauss(0, 1), rng.gauss(0, 1), 0.1) for _ in range(300)] + [("one", 0.3, 0.1, 0.1)] * 7
    df = spark.createDataFrame(data, "g string, x double, y double, z double")
    parts = [regression.pair_moments(df.where(F.pmod(F.xxhash64("y", "x"), F.lit(3)) == k), "x", ["y", "z"], "g") for k in range(3)]
    whole = {(r.y_metric, r.g): r for r in regression.pair_moments(df, "x", ["y", "z"], "g").collect()}
    merged = {(r.y_metric, r.g): r for r in regression.merged_moments(parts, "g").collect()}
    assert whole.keys() == merged.keys()
    for key, r in whole.items():
        numbers = {k: v for k, v in r.asDict().items() if k not in ("y_metric", "g")}
        assert {k: merged[key][k] for k in numbers} == pytest.approx(numbers, rel=1e-7, abs=1e-9)
    assert merged["y", "one"].sxx == 0.0 and merged["z", "a"].syy == 0.0 and merged["z", "a"].my == 0.1


def test_sketches_merge_upward_within_their_bound(spark):
    df = spark.range(60_000).select((F.col("id") % 30_011).alias("v"), (F.col("id") % 7).alias("unit"), F.lit(None).cast("long").alias("gap"))
    finest = sketches.distinct_sketches(df, ["unit"], "v")
    exact = {r.unit: r.n for r in df.groupBy("unit").agg(F.count_distinct("v").alias("n")).collect()}
    near = lambda estimate, n: abs(estimate - n) <= max(1, n * sketches.error_bound())
    assert all(near(r.estimate, exact[r.unit]) for r in sketches.estimated(finest).collect())
    (whole,) = sketches.estimated(sketches.merged_sketches(finest, [F.lit("all").alias("id")])).collect()
    assert near(whole.estimate, 30_011) and sum(exact.values()) > 40_000
    assert [r.estimate for r in sketches.estimated(sketches.distinct_sketches(df, ["unit"], "gap")).collect()] == [0] * 7
    assert sketches.error_bound(16) < sketches.error_bound(14)


def test_dictionary_finds_what_contains_finds(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    values = [text(rng.randint(0, 12)) for _ in range(80)] + [None, "", "aaaa"]
    patterns = [text(rng.randint(1, 5)) for _ in range(60)] + [None, "", "a", "zzz", "aaaa", "aaaaa"]
    found = dictionary.contained(
        spark.createDataFrame([(v, 1) for v in values], "value string, gram int"), "value",
        spark.createDataFrame([(p,) for p in patterns], "pattern string"), "pattern")
    assert sorted(rows(found)) == sorted({(v, p) for v in values if v for p in patterns if p and p in v})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "zzz" not in plan


def test_batch_of_slices_prunes_folders(spark, tmp_path):
    panel = spark.range(4000).selectExpr(
        "if(id % 10 = 0, 'State', 'Municipality') AS geography_level", "if(id % 2 = 0, 'Occupation', 'Sector') AS group_type",
        "concat('g', id % 5) AS group_id", "cast(id AS string) AS geography_id", "id AS n")
    path = str(tmp_path / "store")
    store.write_panel(panel, path)
    selections = spark.createDataFrame(
        [("one", "State", "Occupation", "g0"), ("all", "State", "Occupation", None), ("none", "State", "Sector", "g1"), ("", "Municipality", "Sector", "g1")],
        "selection string, geography_level string, group_type string, group_id string")
    selections.write.parquet(str(tmp_path / "selections"))
    found = serving.slice_batch(store.read_panel(spark, path), spark.read.parquet(str(tmp_path / "selections")))
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    counted = dict(rows(found.groupBy("selection").count()))
    assert counted == {"one": 400, "all": 400}


def test_observed_counts_need_no_job(spark, tmp_path):
    quality = FlowQuality()
    df = quality.watch(spark.range(10), "first", even=F.col("id") % 2 == 0)
    quality.stage("second")(df.where("id > 6"), high=F.col("id") > 8).write.parquet(str(tmp_path / "t"))
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    report = quality.report(spark)
    assert len(tracker.getJobIdsForGroup(None)) == before
    assert rows(report) == [("first", "rows", 10), ("first", "even", 5), ("second", "rows", 3), ("second", "high", 1)]
