"""Connected components of an edge table by label passing with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demur.llm.registry import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each node of ``edges`` (``a, b``) is connected to.

    Each round takes the smallest label among a node's neighbours and then the label's own label, so long
    chains halve by round. A round's labels are written once; nothing is gathered on the driver but the
    count of changes.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.expr("least(node, m) as root")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.expr("least(root, near) as root"))
        # the label's label of this round's start; a label is always a node
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = stored(step.join(jump, "root").select("node", "old", F.expr("least(root, far) as root")), "labels")
        changed = new.where("root <> old").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels
