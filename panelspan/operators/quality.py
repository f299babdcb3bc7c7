"""Counts of a flow, observed while its own jobs run.

Rows kept, rows without an area and fitted models are counted by Spark's
observed metrics: they ride on the jobs that write the flow's tables, so a
quality report costs no scan of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

Watch = Callable[..., DataFrame]


class FlowQuality:
    """Collects observed counts of the stages of one flow.

    A watched frame counts in the first action that runs it to the end; write
    it (or what follows from it) before asking for the report.
    """

    def __init__(self) -> None:
        self._stages: list[tuple[str, list[str], Observation]] = []

    def watch(self, df: DataFrame, stage: str, **conditions: Column) -> DataFrame:
        """``df``, with its rows counted, and the rows for which each condition holds."""
        seen = Observation(f"{stage}-{uuid.uuid4().hex}")
        self._stages.append((stage, ["rows", *conditions], seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(name) for name, c in conditions.items()])

    def stage(self, name: str) -> Watch:
        """``watch`` with the stage's name filled in, for operators that take a watcher."""
        return lambda df, **conditions: self.watch(df, name, **conditions)

    def report(self, spark: SparkSession) -> DataFrame:
        """(stage, measure, n), one row per observed count."""
        rows = [(stage, measure, seen.get.get(measure, 0)) for stage, measures, seen in self._stages for measure in measures]
        return spark.createDataFrame(rows, "stage string, measure string, n long")
