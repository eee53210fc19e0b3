"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the least node of its component. Nulls and loops are left out.

    Every round each node takes the least label around it and then its label's label, so labels travel twice as far as in
    the round before. Rounds are written to the shared folder, which cuts lineage; only a count goes to the driver.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    sides = materialize(pairs.union(pairs.select("b", "a")).distinct(), "graph-sides")
    labels = materialize(sides.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "graph-labels")
    while True:
        around = sides.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("around"))
        nearer = labels.join(around, "node").select("node", "label", F.least("label", "around").alias("next"))
        nearer = materialize(nearer, "graph-nearer")
        jump = nearer.select(F.col("node").alias("next"), F.col("next").alias("after"))
        further = materialize(nearer.join(jump, "next").select("node", "label", F.least("next", "after").alias("next")), "graph-labels")
        moved = further.where("label <> next").limit(1).count()
        labels = further.select("node", F.col("next").alias("label"))
        if not moved:
            return labels
