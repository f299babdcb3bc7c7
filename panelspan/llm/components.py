"""Connected components of an edge table, by least labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspan.llm import common


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of ``edges`` (a, b).

    A round gives each node the least label among its own and its neighbours' and then that label's label, so chains
    halve.  Each round is written to the shared folder.  Only counts reach the driver.
    """
    both = common.staged(edges.where("a is not null and b is not null and a <> b").selectExpr("inline(array(struct(a, b), struct(b as a, a as b)))").distinct(), "edges")
    labels = held = common.staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("least"))
        jump = labels.select(F.col("node").alias("least"), F.col("component").alias("further"))
        after = hooked.join(jump, "least").select("node", F.least("least", "further").alias("component"), (F.least("least", "further") < F.col("component")).alias("moved"))
        before, held = held, common.staged(after, "labels")
        common.drop(before)
        labels = held.select("node", "component")
        if not held.where("moved").limit(1).count():
            common.drop(both)
            return labels
