"""JSON exports: an array per column, or an array of row objects.

A panel of any size is cut into chunks of bounded length along a total order;
each chunk is one JSON object (columnar) or one array (records).  A small
panel is a single chunk, that is, exactly one document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspan.functions.guarded import field
from panelspan.sources.stage import written

CHUNK_ROWS = 50_000
_JSON = {"ignoreNullFields": "false"}


def rounded(df: DataFrame, digits: int = 6, text_others: bool = True) -> DataFrame:
    """Round fractions half to even; other non-numbers become text."""
    def shown(f: T.StructField) -> Column:
        value = field(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.bround(value.cast("double"), digits).alias(f.name)
        if text_others and not isinstance(f.dataType, T.NumericType):
            return value.cast("string").alias(f.name)
        return value

    return df.select(*[shown(f) for f in df.schema.fields])


def _chunks(df: DataFrame, order_by: Sequence[str], rows: int, partitions: int | None) -> DataFrame:
    """Rows with (part, chunk, place) along a total order.

    The remaining columns break ties, so rows that still compare equal are
    identical and a recomputed task numbers them the same way.
    """
    order = [field(c) for c in (*order_by, *[c for c in df.columns if c not in order_by])]
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    numbered = ranged.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    return numbered.select(
        F.struct(*[field(c) for c in df.columns]).alias("row"),
        F.shiftright("_at", 33).alias("part"),
        F.floor(place / rows).alias("chunk"), place.alias("place"),
    )


def _ordered_rows() -> Column:
    """Chunk's rows in order; whole structs, as a list of a column drops NULLs."""
    kept = F.array_sort(F.collect_list(F.struct("place", "row")))
    return F.transform(kept, lambda item: item["row"])


def columnar_json(
    df: DataFrame, order_by: Sequence[str], chunk_rows: int = CHUNK_ROWS,
    partitions: int | None = None, digits: int = 6,
) -> DataFrame:
    """(part, chunk, json): per chunk one object with an array per column."""
    out = rounded(df, digits)
    grouped = _chunks(out, order_by, chunk_rows, partitions).groupBy("part", "chunk").agg(
        _ordered_rows().alias("rows")
    )
    arrays = [F.transform("rows", _getter(c)).alias(c) for c in out.columns]
    return grouped.select("part", "chunk", F.to_json(F.struct(*arrays), _JSON).alias("json"))


def _getter(name: str):
    return lambda row: row.getField(name)


def record_json(df: DataFrame, digits: int = 6) -> DataFrame:
    """One row object per line; nothing is grouped, so any size works."""
    out = rounded(df, digits, text_others=False)
    return out.select(F.to_json(F.struct(*[field(c) for c in out.columns]), _JSON).alias("json"))


def record_arrays(
    df: DataFrame, order_by: Sequence[str], chunk_rows: int = CHUNK_ROWS,
    partitions: int | None = None, digits: int = 6,
) -> DataFrame:
    """(part, chunk, json): per chunk one array of row objects."""
    out = rounded(df, digits, text_others=False)
    grouped = _chunks(out, order_by, chunk_rows, partitions).groupBy("part", "chunk").agg(
        _ordered_rows().alias("rows")
    )
    return grouped.select("part", "chunk", F.to_json("rows", _JSON).alias("json"))


DOCUMENT, CHUNKS, STRIPES = "document", "chunks", "stripes"


def _layout(layout: str, chunk_rows: int) -> tuple[int, int | None]:
    """Rows of a chunk and range partitions.  One document holds everything and is built by one task."""
    if layout not in (DOCUMENT, CHUNKS):
        raise ValueError(f"layout is {DOCUMENT!r} or {CHUNKS!r}, not {layout!r}")
    return (2**31 - 1, 1) if layout == DOCUMENT else (chunk_rows, None)


def write_columnar_json(
    df: DataFrame, path: str, order_by: Sequence[str], chunk_rows: int = CHUNK_ROWS, layout: str = CHUNKS
) -> None:
    """Text files in panel order: columnar documents of bounded length, one per line, a document in stripes, or a single document."""
    if layout == STRIPES:
        write_striped_json(df, path, order_by, chunk_rows)
        return
    documents = columnar_json(df, order_by, *_layout(layout, chunk_rows))
    documents.sort("part", "chunk").select("json").write.mode("overwrite").text(path)


def write_record_json(
    df: DataFrame, path: str, order_by: Sequence[str], chunk_rows: int = CHUNK_ROWS, layout: str = CHUNKS
) -> None:
    """Text files in panel order: record arrays of bounded length, one per line, or a single array."""
    documents = record_arrays(df, order_by, *_layout(layout, chunk_rows))
    documents.sort("part", "chunk").select("json").write.mode("overwrite").text(path)


def write_record_lines(df: DataFrame, path: str, digits: int = 6) -> None:
    """JSON lines with NULL fields kept."""
    rounded(df, digits, text_others=False).write.mode("overwrite").option(
        "ignoreNullFields", "false").json(path)


def columns_back(documents: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows again from columnar documents (text columns stay text)."""
    arrays = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in schema.fields])
    parsed = documents.select(F.from_json("json", arrays).alias("d"))
    zipped = F.arrays_zip(*[F.col(f"d.{f.name}") for f in schema.fields])
    return parsed.select(F.inline(zipped))


# Short names of the exported key columns.
SHORT_NAMES = {
    "gl": "geography_level", "gid": "geography_id", "gn": "geography_name",
    "gt": "group_type", "grid": "group_id", "glab": "group_label",
}
# Exported measures, in file order, without legal status.
PLAIN_MEASURES = (
    "n_total", "n_male", "n_female",
    "pop_total", "pop_literate", "literacy_rate_population",
    "occ_total", "occ_male", "occ_female",
    "share_of_all_occupations", "share_male_within_group", "share_female_within_group",
    "n_total_national", "n_male_national", "n_female_national", "pop_literate_national",
    "share_of_national_occupations", "share_male_of_national_group",
    "share_female_of_national_group", "literacy_rate_of_national_pop",
)
# Exported measures, in file order, with legal status.
STATUS_MEASURES = (
    "n_total", "n_free", "n_enslaved", "n_male", "n_female",
    "pop_total", "pop_free", "pop_enslaved", "pop_literate",
    "literacy_rate_population", "enslaved_rate_population",
    "occ_total", "occ_free", "occ_enslaved", "occ_male", "occ_female",
    "share_of_all_occupations", "share_free_within_group", "share_enslaved_within_group",
    "share_male_within_group", "share_female_within_group",
    "n_total_national", "n_free_national", "n_enslaved_national", "n_male_national",
    "n_female_national", "pop_literate_national", "pop_enslaved_national",
    "share_of_national_occupations", "share_free_of_national_group",
    "share_enslaved_of_national_group", "share_male_of_national_group",
    "share_female_of_national_group", "literacy_rate_of_national_pop",
    "enslaved_rate_of_national_pop",
)
# Exported columns of a fit.
FIT_EXPORT = ("coef", "se", "ci_lower", "ci_upper", "p_value")


def short_panel(panel: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Export projection with short key names."""
    return panel.select(*[F.col(long).alias(short) for short, long in SHORT_NAMES.items()], *measures)


def change_columns(before: str = "1872", after: str = "1920") -> list[str]:
    # Exported columns of the comparison, in file order.
    return [
        f"mfg_share_{after}", f"agr_share_{after}", f"non_agr_share_{after}", f"mfg_agr_ratio_{after}",
        f"literacy_rate_{after}", f"mfg_percapita_{after}",
        "mfg_share_change_pp", "mfg_share_log_ratio", "mfg_share_cagr", "mfg_share_logit_change",
        "non_agr_share_change_pp", "mfg_agr_ratio_change", "structural_change_index",
        "agr_exit_share", "serv_share_change_pp", "literacy_rate_change_pp", "pop_growth_rate",
        f"enslaved_share_{before}", f"enslaved_mfg_share_{before}", f"enslaved_agr_share_{before}",
        f"mfg_share_{before}", f"literacy_rate_{before}", f"agr_share_{before}",
        f"serv_share_{before}", f"serv_share_{after}",
    ]


def change_export(panel: DataFrame, keys: Sequence[str], before: str = "1872", after: str = "1920") -> DataFrame:
    texts = [F.col(k).cast("string").alias(k) for k in keys]
    return panel.select(*texts, *change_columns(before, after))


# ---- documents in stripes ---------------------------------------------------

def write_striped_json(
    df: DataFrame, path: str, order_by: Sequence[str], chunk_rows: int = CHUNK_ROWS, digits: int = 6,
) -> None:
    """One columnar document written by many tasks: its columns in stripes, and a manifest that joins them.

    ``path/stripes/column=<k>`` holds column k as text lines in panel order
    over the files by name and the lines within them; a line is an object with
    the stripe's number and its values.  ``path/manifest`` has a line per
    column: its number and name, its stripes and values.  It is written last,
    so a document without one is unfinished.  No task holds more than its range
    of the rows.
    """
    out = rounded(df, digits)
    chunks = written(_chunks(out, order_by, chunk_rows, None).groupBy("part", "chunk").agg(_ordered_rows().alias("rows")), "stripes")
    stripe = (F.shiftleft(F.col("part"), 32) + F.col("chunk")).alias("stripe")
    cells = [F.struct(F.lit(k).alias("column"), F.to_json(F.struct(stripe, F.transform("rows", _getter(c)).alias("values")), _JSON).alias("value"))
             for k, c in enumerate(out.columns)]
    stripes = chunks.select("part", "chunk", F.inline(F.array(*cells)))
    ordered = stripes.repartitionByRange("column", "part", "chunk").sortWithinPartitions("column", "part", "chunk")
    ordered.select("column", "value").write.mode("overwrite").partitionBy("column").text(f"{path}/stripes")
    columns = F.array(*[F.struct(F.lit(k).alias("column"), F.lit(c).alias("name")) for k, c in enumerate(out.columns)])
    sizes = chunks.agg(F.count("*").alias("stripes"), F.coalesce(F.sum(F.size("rows")), F.lit(0)).alias("values"))
    sizes.select(F.inline(columns), "stripes", "values").sort("column").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def striped_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a striped document, in parallel: the stripes of one number belong together."""
    manifest = spark.read.json(f"{path}/manifest").collect()
    if not any(r["values"] for r in manifest):                     # no rows, no folders per column
        return spark.createDataFrame([], schema)
    names = {r["name"]: r["column"] for r in manifest}
    lines = spark.read.text(f"{path}/stripes")
    number = F.get_json_object("value", "$.stripe").cast("long")
    columns = [F.max(F.when(F.col("column") == names[f.name], F.col("value"))).alias(f.name) for f in schema.fields]
    wide = lines.groupBy(number.alias("_stripe")).agg(*columns)
    parsed = [F.from_json(field(f.name), T.StructType([T.StructField("values", T.ArrayType(f.dataType))]))["values"].alias(f.name) for f in schema.fields]
    return wide.select(F.arrays_zip(*parsed).alias("rows")).select(F.inline("rows"))
