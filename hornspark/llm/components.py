"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the smallest node it reaches.

    Each round takes the least label of a node's neighbours, then the label of its label, so that
    rounds grow with the logarithm of a path. Labels and edges stay in tables; only a count of
    changed rows comes to the driver.
    """
    pairs = both = scratch.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = table = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("via"))
        up = labels.select(F.col("node").alias("via"), F.col("comp").alias("up"))
        after = scratch.keep(step.join(up, "via").select("node", "old", F.least("via", "up").alias("comp")))
        changed = after.filter("old <> comp").limit(1).count()
        scratch.free(table)
        labels, table = after.select("node", "comp"), after
        if not changed:
            scratch.free(pairs)
            return labels
