"""Connected components of an edge table, without gathering edges anywhere."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable), of all nodes of the edges.

    Labels start as the smallest neighbour; in each round a node and its label's
    node take the smallest label next to them, then labels are followed one step.
    Rounds grow with the logarithm of the diameter.  Sums and minima are taken map
    side first; hot nodes only stand on the side of joins that AQE can split.
    Each round's labels are written to the shared folder.  No edges give no rows.
    """
    one = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    both = common.saved(one.union(one.select("b", "a")).distinct(), "edges")
    common.free(edges.sparkSession)
    labels = common.saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).select("a", "label")
        best = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("best"))
        own = labels.join(best, "node").select("node", "label", F.least("label", "best").alias("best"))
        offers = own.select("node", F.col("best").alias("label")).union(own.select(F.col("label").alias("node"), F.col("best").alias("label")))
        lower = offers.groupBy("node").agg(F.min("label").alias("label"))
        step = lower.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        jumped = lower.join(step, F.col("label") == F.col("_n"), "left").select("node", F.least("label", "_l").alias("label"))
        new = common.saved(jumped, "labels")
        changed = new.join(labels.withColumnRenamed("label", "was"), "node").where("label <> was").isEmpty()
        common.drop_saved(edges.sparkSession, labels)
        labels = new
        if changed:
            common.drop_saved(edges.sparkSession, both)
            return labels.withColumnRenamed("label", "component")
