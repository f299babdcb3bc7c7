"""Named tables, fixed lookups and build-once tables."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from panelspan.sources.stage import file_system


def read_table(
    spark: SparkSession, base: str, table: str, year: int | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Parquet table ``<base>/<table><year>.parquet``; columns prune at the scan."""
    name = table if year is None else f"{table}{year}"
    df = spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_jdbc_table(
    spark: SparkSession, url: str, table: str, year: int | None = None,
    partition_column: str | None = None, bounds: tuple[int, int] | None = None,
    partitions: int = 64, options: Mapping[str, str] | None = None,
) -> DataFrame:
    """The same named table from a database, read in parallel key ranges.

    Needs the database's JDBC driver on the class path.
    """
    name = table if year is None else f"{table}{year}"
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if partition_column and bounds:
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]), numPartitions=str(partitions),
        )
    return reader.options(**(options or {})).load()


def lookup_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Small fixed table given in configuration, with an explicit schema."""
    return spark.createDataFrame(list(rows), schema)


def publish(spark: SparkSession, aside: str, path: str) -> bool:
    """Rename a finished folder to its public name; False if another builder was first.

    The rename never replaces or enters an existing folder, so exactly one of
    several concurrent builders wins and readers see whole tables only.  It is
    atomic on HDFS and local disks; stores without an atomic rename need a
    table format in front of them.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    system, source = file_system(spark, aside)
    target = jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), system.getConf())
    try:
        context.rename(source, target, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as error:
        if not system.exists(target):
            raise
        if "FileAlreadyExists" not in error.java_exception.getClass().getName() and "is not empty" not in str(error.java_exception.getMessage()):
            raise
        system.delete(source, True)
        return False
    return True


def reuse_or_build(
    spark: SparkSession, folder: str, name: str, config: Mapping[str, Any], build: Callable[[], DataFrame]
) -> DataFrame:
    """Stored table if there is one for this configuration, else build and publish it.

    The configuration is part of the folder name, so a change of settings never
    picks up a stale table.  A builder writes aside and renames, so a table is
    there whole or not at all; whoever comes second drops its own copy and
    reads the first.  A build that failed leaves nothing under the name.
    """
    digest = hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{folder.rstrip('/')}/{name}-{digest}"
    system, target = file_system(spark, path)
    if not system.exists(target):
        aside = f"{folder.rstrip('/')}/.{name}-{digest}-{uuid.uuid4().hex}"
        system.deleteOnExit(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(aside))      # in case the build fails
        build().write.parquet(aside)
        publish(spark, aside, path)
    return spark.read.parquet(path)
