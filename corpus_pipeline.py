"""From raw documents to packed training sequences: five stages, each written as Parquet and reread by the next.

Language identification drops documents without a language, line deduplication removes lines that resemble an earlier
line, near-duplicate detection keeps one document of each group, decontamination cuts benchmark passages out, and
packing lays the rest out in sequences.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelspan.llm import common, decontaminate, langid, line_dedup, minhash, packing


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.removed(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id), ("line_dedup", lines), ("near_dedup", near_dedup), ("decontaminate", decontamination), ("packing", pack),
]

#: Language profiles, n-gram hashes and token ids have no SQL form; the stages are tested one by one by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.staged(stage(spark, docs, sf_dir), name)
        if hasattr(before, "_staged"):
            common.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
