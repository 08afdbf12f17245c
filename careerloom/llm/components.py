"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerloom.llm.shared import shared_table


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the component's smallest node.

    Each round a node takes the smallest label around it, then the label of its
    label, so a path of length n needs about log n rounds.  Every round is
    written to the shared folder; only a count of changes reaches the driver.
    """
    both = shared_table(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(F.col(b), F.col(a))).distinct(), "edges")
    labels = shared_table(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("root").alias("label")), "other").groupBy("node").agg(F.min("label").alias("label"))
        lower = labels.join(near, "node").select("node", F.col("root").alias("before"), F.least("root", "label").alias("step"))
        jumped = lower.join(labels.select(F.col("node").alias("step"), F.col("root").alias("jump")), "step", "left")
        following = shared_table(jumped.select("node", "before", F.least("step", F.coalesce("jump", "step")).alias("root")), "labels")
        if following.where(F.col("before") != F.col("root")).isEmpty():
            return following.select("node", "root")
        labels = following.select("node", "root")
