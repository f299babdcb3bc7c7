"""Intermediate tables in the shared folder: written once, read by several jobs, removed with the application."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from panelspan.session import shared_folder


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path objects for ``path``."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused folder in the shared one, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    system, target = file_system(spark, path)
    system.deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` evaluated once into Parquet and read back; a lost executor repeats its running tasks only."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
