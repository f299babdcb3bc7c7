"""Panel store: partitioned Parquet that later jobs read selectively."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspan.functions.guarded import field
from panelspan.sources.stage import written

PARTITIONS = ("geography_level", "group_type")
SORTED_BY = ("group_id", "geography_id")
#: Partitions named one by one in an update's filter.
MOST_TOUCHED = 1000


def write_panel(
    df: DataFrame, path: str, partitions: Sequence[str] = PARTITIONS, sort_by: Sequence[str] = SORTED_BY
) -> None:
    """Write in folders per slice column, sorted for row-group pruning.

    The rebalance hint gathers a folder's rows into few files and lets AQE
    split a folder that holds most of the data.
    """
    keys = [c for c in partitions if c in df.columns]
    order = [c for c in sort_by if c in df.columns]
    out = df.hint("rebalance", *keys) if keys else df
    if keys or order:
        out = out.sortWithinPartitions(*keys, *order)
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def update_counts(
    spark: SparkSession, path: str, more: DataFrame, keys: Sequence[str], partition: str, counts: Sequence[str],
) -> None:
    """Add count rows to a stored table of counts, rewriting only the partitions they fall into.

    ``partition`` is the folder column and must follow from ``keys``.  Sums are
    written aside first, then their folders are replaced (dynamic partition
    overwrite); folders without new rows are not read and not touched.
    """
    old = read_panel(spark, path)
    touched = [r[0] for r in more.select(partition).distinct().limit(MOST_TOUCHED + 1).collect()]
    if len(touched) <= MOST_TOUCHED:       # a literal list prunes folders; beyond it the join does
        old = old.where(F.col(partition).isin(touched))
    else:
        old = old.join(more.select(partition).distinct(), partition, "left_semi")
    columns = [partition, *keys, *counts]
    summed = old.select(*columns).unionByName(more.select(*columns)).groupBy(partition, *keys).agg(*[F.sum(field(c)).alias(c) for c in counts])
    fresh = written(summed, "store-update")
    fresh.hint("rebalance", partition).sortWithinPartitions(partition, *keys).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
