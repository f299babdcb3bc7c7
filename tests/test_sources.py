import json
import os
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from helpers import rows
from pyspark.sql import functions as F

from panelspan.operators.serving import panel_slice
from panelspan.sources import export, store
from panelspan.sources.tables import lookup_table, publish, read_table, reuse_or_build


def lines(path):
    names = sorted(n for n in os.listdir(path) if n.startswith("part-"))
    return [line for n in names for line in open(f"{path}/{n}", encoding="utf-8").read().splitlines()]


DATA = "SELECT * FROM VALUES ('b', 1, 0.12345678D, true), ('a', 2, NULL, NULL), ('c', NULL, 3D, false) AS t(k, n, v, f)"


def test_tables_by_year(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/census1872.parquet")
    assert read_table(spark, str(tmp_path), "census", 1872).count() == 3
    assert read_table(spark, f"{tmp_path}/", "census1872", columns=["id"]).columns == ["id"]


def test_lookup_has_the_given_schema(spark):
    df = lookup_table(spark, [("Pará", 15)], "name_state string, code_state int")
    assert df.dtypes == [("name_state", "string"), ("code_state", "int")]


def test_build_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(4)

    for config, times in (({"a": 1}, 1), ({"a": 1}, 1), ({"a": 2}, 2)):
        assert reuse_or_build(spark, str(tmp_path), "crosswalk", config, build).count() == 4
        assert len(built) == times


def test_a_failed_build_leaves_nothing_behind(spark, tmp_path):
    with pytest.raises(Exception):
        reuse_or_build(spark, str(tmp_path), "t", {}, lambda: spark.range(4).select(F.raise_error(F.lit("broken")).alias("x")))
    assert reuse_or_build(spark, str(tmp_path), "t", {}, lambda: spark.range(4)).count() == 4


def test_one_of_two_builders_wins(spark, tmp_path):
    """Both find nothing, both build; the second to finish reads what the first published."""
    ready = threading.Barrier(2)

    def build(n):
        def frame():
            ready.wait(60)
            return spark.range(n)
        return reuse_or_build(spark, str(tmp_path), "t", {"a": 1}, frame).count()

    with ThreadPoolExecutor(2) as pool:
        found = list(pool.map(build, (4, 5)))
    assert found[0] == found[1] and found[0] in (4, 5)
    assert len(os.listdir(tmp_path)) == 1
    assert len(os.listdir(tmp_path / os.listdir(tmp_path)[0])) > 1 and not any(n.startswith(".t") for n in os.listdir(tmp_path / os.listdir(tmp_path)[0]))


def test_publishing_never_replaces(spark, tmp_path):
    for n in (1, 2):
        spark.range(n).write.parquet(f"{tmp_path}/aside{n}")
    assert publish(spark, f"{tmp_path}/aside1", f"{tmp_path}/t") and not publish(spark, f"{tmp_path}/aside2", f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1 and os.listdir(tmp_path) == ["t"]
    with pytest.raises(Exception):
        publish(spark, f"{tmp_path}/missing", f"{tmp_path}/other")


def test_update_rewrites_touched_folders_only(spark, tmp_path):
    path = str(tmp_path / "counts")
    first = spark.range(20).selectExpr("id", "id % 4 AS part", "1D AS n", "if(id = 1, NULL, 2D) AS `m-x y`")
    store.write_panel(first, path, ["part"], ["id"])
    before = {p: os.listdir(f"{path}/{p}") for p in os.listdir(path) if p.startswith("part=")}
    more = spark.createDataFrame([(1, 1, 5.0, 7.0), (1, 1, 1.0, 1.0), (101, 1, 3.0, 4.0)], "id long, part long, n double, `m-x y` double")
    store.update_counts(spark, path, more, ["id"], "part", ["n", "m-x y"])
    after = {p: os.listdir(f"{path}/{p}") for p in os.listdir(path) if p.startswith("part=")}
    assert {p for p in after if after[p] != before.get(p)} == {"part=1"}
    found = {r.id: (r.n, r["m-x y"]) for r in store.read_panel(spark, path).collect()}
    assert len(found) == 21 and found[1] == (7.0, 8.0) and found[101] == (3.0, 4.0) and found[5] == (1.0, 2.0)
    store.update_counts(spark, path, more.limit(0), ["id"], "part", ["n", "m-x y"])
    assert store.read_panel(spark, path).count() == 21


def test_columnar_document_keeps_places(spark, tmp_path):
    path = f"{tmp_path}/panel.json"
    export.write_columnar_json(spark.sql(DATA), path, ["k"], layout=export.DOCUMENT)
    (document,) = lines(path)
    assert json.loads(document) == {
        "k": ["a", "b", "c"], "n": [2, 1, None], "v": [None, 0.123457, 3.0], "f": [None, "true", "false"]}


def test_striped_document_is_written_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "document")
    df = spark.range(5000).selectExpr("id * 7919 % 5000 AS id", "if(id % 3 = 0, NULL, cast(id AS string)) AS `a b`", "id / 7 AS v").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        export.write_columnar_json(df, path, ["id"], chunk_rows=64, layout=export.STRIPES)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    manifest = sorted((json.loads(line) for line in lines(f"{path}/manifest")), key=lambda m: m["column"])
    assert [m["name"] for m in manifest] == ["id", "a b", "v"] and {m["values"] for m in manifest} == {5000}
    document = {m["name"]: [v for line in lines(f"{path}/stripes/column={m['column']}") for v in json.loads(line)["values"]] for m in manifest}
    assert document["id"] == list(range(5000)) and document["a b"].count(None) == 1667
    assert sum(len([n for n in os.listdir(f"{path}/stripes/{c}") if n.startswith("part-")]) for c in os.listdir(f"{path}/stripes") if c.startswith("column=")) > 4
    back = export.striped_rows(spark, path, df.schema)
    want = {r.id: (r["a b"], round(r.v, 6)) for r in df.collect()}
    assert {r.id: (r["a b"], r.v) for r in back.collect()} == want
    assert [(document["a b"][i], document["v"][i]) for i in (0, 17, 4999)] == [want[i] for i in (0, 17, 4999)]
    export.write_columnar_json(df.limit(0), path + "0", ["id"], layout=export.STRIPES)
    assert export.striped_rows(spark, path + "0", df.schema).count() == 0


def test_columnar_chunks_hold_every_row_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"), (F.col("id") % 3).alias("m"))
    docs = export.columnar_json(df, ["id"], chunk_rows=64, partitions=3).orderBy("part", "chunk").collect()
    parsed = [json.loads(d.json) for d in docs]
    assert all(len(d["id"]) <= 64 and len(d["m"]) == len(d["id"]) for d in parsed)
    assert [i for d in parsed for i in d["id"]] == list(range(1000))


def test_columnar_round_trip(spark):
    df = spark.sql("SELECT * FROM VALUES ('b', 0.5D), ('a', NULL), (NULL, 2D) AS t(k, v)")
    back = export.columns_back(export.columnar_json(df, ["k"]), df.schema)
    assert sorted(rows(back), key=str) == sorted(rows(df), key=str)


def test_half_even_rounding(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 0.0000005D), (2, 0.0000015D), (3, 1234567.1234565D) AS t(i, v)")
    assert [r[1] for r in rows(export.rounded(df))][:2] == [0.0, 0.000002]


def test_records(spark, tmp_path):
    path = f"{tmp_path}/records.json"
    export.write_record_json(spark.sql(DATA), path, ["k"])
    (document,) = lines(path)
    assert json.loads(document) == [
        {"k": "a", "n": 2, "v": None, "f": None}, {"k": "b", "n": 1, "v": 0.123457, "f": True},
        {"k": "c", "n": None, "v": 3.0, "f": False}]
    export.write_record_lines(spark.sql(DATA), f"{tmp_path}/lines")
    assert sorted(json.loads(x)["k"] for x in lines(f"{tmp_path}/lines")) == ["a", "b", "c"]
    assert all("v" in json.loads(x) for x in lines(f"{tmp_path}/lines"))


def test_store_prunes_slices(spark, tmp_path):
    panel = spark.range(100).select(
        F.when(F.col("id") < 90, "Municipality").otherwise("State").alias("geography_level"),
        F.col("id").cast("string").alias("geography_id"), F.lit("Sector").alias("group_type"),
        F.when(F.col("id") % 2 == 0, "services").otherwise("agriculture").alias("group_id"), F.col("id").alias("n"))
    path = f"{tmp_path}/panel"
    store.write_panel(panel, path)
    assert {d for d in os.listdir(path) if "=" in d} == {"geography_level=Municipality", "geography_level=State"}
    back = store.read_panel(spark, path)
    assert sorted(rows(back.select(panel.columns))) == sorted(rows(panel))
    part = panel_slice(back, "State", "services", "Sector")
    text = part._jdf.queryExecution().executedPlan().toString()
    assert part.count() == 5
    assert "geography_level" in text.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "EqualTo(group_id,services)" in text


def test_export_projections(spark):
    assert len(export.SHORT_NAMES) + len(export.STATUS_MEASURES) == 6 + 35
    assert len(export.PLAIN_MEASURES) == 20 and len(export.change_columns()) + 2 == 27


def test_shared_folder_is_the_sessions(spark):
    from panelspan.session import shared_folder

    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    beside = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_panelspan"
    assert shared_folder(spark) == (named.rstrip("/") if named else beside)


@pytest.mark.parametrize("value", ["it's", "back\\slash"])
def test_labels_survive_sql_text(spark, value):
    from panelspan.functions.guarded import text_literal

    assert rows(spark.sql(f"SELECT {text_literal(value)}")) == [(value,)]
