"""Session defaults and the shared working folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings the operators are designed around.  None of them sizes the
#: cluster; shuffle partition counts stay with the caller (AQE coalesces
#: and splits them at run time).
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Wide count tables make whole-stage methods longer than the 8000 bytecodes
    # HotSpot compiles; past that the split, compiled projections are faster.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add :data:`RECOMMENDED` to a session builder."""
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or one beside the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_panelspan"
    return folder.rstrip("/")
