import math
import struct

import numpy as np
import pandas as pd
import pytest
from helpers import one, rows
from pyspark.sql import functions as F

from panelspan.operators import quantiles as q
from panelspan.operators.ranking import Ranked


def found(df, column, probabilities=q.QUARTILES, **options):
    row = one(q.exact_quantiles(df, column, probabilities, **options))
    return row.n, row.quantiles


def test_small_sample(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 9.0, 10.0, 20.0, None)], "v double")
    assert found(df, "v") == (6, [1.0, 2.5, 6.5, 9.75, 20.0])
    assert found(df.where("v IS NULL"), "v") == (0, None)
    assert found(df.where("v = 4"), "v") == (1, [4.0] * 5)


SHAPES = ["normal", "ties", "hot", "skewed", "narrow"]


def shaped(shape):
    rng = np.random.default_rng(5)
    return {
        "normal": rng.normal(size=60_000), "ties": rng.integers(0, 50, 60_000).astype(float),
        "hot": np.where(rng.random(60_000) < 0.4, 7.0, rng.normal(7, 3, 60_000)),
        "skewed": rng.pareto(0.5, 60_000), "narrow": 1 + rng.integers(0, 5000, 60_000) * 2.0**-52,
    }[shape]


@pytest.mark.parametrize("direct", [1 << 20, 100, 0])
@pytest.mark.parametrize("shape", SHAPES)
def test_selection_is_exact_on_larger_data(spark, monkeypatch, shape, direct):
    # Few rows resolved at once make all levels do the work.
    monkeypatch.setattr(q, "DIRECT", direct)
    values = shaped(shape)
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(7)
    probabilities = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
    n, got = found(df, "v", probabilities)
    assert n == 60_000
    assert got == pytest.approx(np.quantile(values, probabilities).tolist(), rel=1e-15)


def bits_of(value):
    if value != value:
        return 2**63 - 1
    bits = struct.unpack("<q", struct.pack("<d", abs(value)))[0]
    return -bits if value < 0 else bits


def test_bits_keep_the_order_of_doubles(spark):
    rng = np.random.default_rng(2)
    any_bits = [struct.unpack("<d", struct.pack("<q", int(b)))[0] for b in rng.integers(-2**63, 2**63 - 1, 20_000)]
    powers = [2.0**e * f for e in range(-1074, 1024) for f in (1.0, 1 + 2**-52, 1 - 2**-53) if 2.0**e * f < math.inf]
    values = [*any_bits, *powers, *[-p for p in powers], 0.0, -0.0, math.inf, -math.inf, math.nan, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308]
    got = q.with_bits(spark.createDataFrame([(v,) for v in values], "v double")).collect()
    assert len(got) == len(values) and all(r.bits == bits_of(r.v) for r in got)
    assert all(q.double_of(r.bits) == r.v for r in got if r.v == r.v)


@pytest.mark.parametrize("direct", [1 << 20, 0])
def test_special_values_have_their_place(spark, monkeypatch, direct):
    monkeypatch.setattr(q, "DIRECT", direct)
    values = [-math.inf, -1e-310, -0.0, 0.0, 3.0, 1e308, math.inf, math.nan, math.nan]
    n, got = q.order_statistics(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), range(9))
    assert n == 9 and [got[i] for i in range(7)] == values[:7] and got[7] != got[7] and got[8] != got[8]


def test_later_scans_filter_at_the_source(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "v")
    spark.range(50_000).select((F.col("id") / 7).alias("v")).write.parquet(path)
    plans, collect = [], type(spark.range(1)).collect

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return collect(df)

    monkeypatch.setattr(type(spark.range(1)), "collect", seen)
    n, _ = found(spark.read.parquet(path), "v")
    assert n == 50_000 and len(plans) <= 3 + 1 and "GreaterThanOrEqual(v" in plans[1]


@pytest.mark.parametrize("shape", SHAPES)
def test_ranks_and_quantiles_of_stored_order(spark, shape):
    values = shaped(shape)
    df = spark.createDataFrame(pd.DataFrame({"v": values, "id": np.arange(len(values))})).repartition(5)
    ranked = Ranked(df, "v")
    n, got = ranked.quantiles((0.0, 0.1, 0.5, 0.9, 1.0))
    assert n == 60_000 and got == pytest.approx(np.quantile(values, (0.0, 0.1, 0.5, 0.9, 1.0)).tolist(), rel=1e-15)
    rows = ranked.with_rank().toPandas().sort_values("rank")
    assert (rows["rank"].to_numpy() == np.arange(1, n + 1)).all() and (np.diff(rows["v"]) >= 0).all()
    assert sorted(rows["id"]) == list(range(n))


def test_one_value_is_spread_over_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = Ranked(spark.range(40_000).select(F.lit(3.5).alias("v"), "id"), "v")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert ranked.rows.select("_part").distinct().count() > 4
    assert ranked.quantiles((0.5,)) == (40_000, [3.5])


def test_ranks_of_small_and_empty_tables(spark):
    df = spark.createDataFrame([(2.0,), (None,), (1.0,)], "v double")
    assert Ranked(df, "v").quantiles((0.0, 0.5, 1.0)) == (2, [1.0, 1.5, 2.0])
    assert Ranked(df.where("v > 5"), "v").quantiles((0.5,)) == (0, None)


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 9.0, 10.0, 20.0)], "v double")
    out = dict(rows(q.quantile_bins(df, "v", q.exact_quantiles(df, "v"))))
    assert [out[v] for v in (1.0, 2.0, 4.0, 9.0, 10.0, 20.0)] == [
        "Q1 (lowest)", "Q1 (lowest)", "Q2", "Q3", "Q4 (highest)", "Q4 (highest)"]


def test_equal_breaks_raise(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 1.0, 1.0, 2.0, 3.0)], "v double")
    with pytest.raises(Exception, match="not unique"):
        q.quantile_bins(df, "v", q.exact_quantiles(df, "v")).collect()


def test_values_outside_the_breaks_have_no_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 9)], "v double")
    more = df.union(spark.createDataFrame([(99.0,), (None,)], "v double"))
    out = dict(rows(q.quantile_bins(more, "v", q.exact_quantiles(df, "v"))))
    assert out[99.0] is None and out[None] is None and out[8.0] == "Q4 (highest)"


def test_approximate_option(spark):
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("v"))
    row = one(q.approximate_quantiles(df, "v"))
    assert row.n == 1000 and row.quantiles[2] == pytest.approx(500, abs=2)
