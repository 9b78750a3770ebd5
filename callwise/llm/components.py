"""Connected components by hooking and pointer jumping; every step is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwise.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, label): every node of an edge, and the least node of its component.

    A vertex hooks to its least neighbour if that is smaller, chains are shortened to their roots, edges are
    redrawn between roots, until none is left. Hubs are only aggregated, never gathered.
    """
    links = written(edges.select("a", "b").where("a != b").distinct(), "cc-links")
    labels = None
    while labels is None or links.count():
        both = links.union(links.select("b", "a"))
        parent = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                         .select("node", F.least("node", "m").alias("label")), "cc-parents")
        while True:
            above = parent.select(F.col("node").alias("_n"), F.col("label").alias("_up"))
            jumped = written(parent.join(above, F.col("label") == F.col("_n"), "left").select(
                "node", F.coalesce("_up", "label").alias("label"), (F.coalesce("_up", "label") != F.col("label")).alias("moved")), "cc-parents")
            parent = jumped.select("node", "label")
            if not jumped.where("moved").limit(1).count():
                break
        root = parent.select(F.col("node").alias("_n"), F.col("label").alias("_r"))
        if labels is None:
            labels = parent
        else:
            labels = written(labels.join(root, F.col("label") == F.col("_n"), "left").select(
                "node", F.coalesce("_r", "label").alias("label")), "cc-labels")
        for end in ("a", "b"):
            links = links.join(root, F.col(end) == F.col("_n"), "left").withColumn(end, F.coalesce("_r", end)).select("a", "b")
        links = written(links.where("a != b").distinct(), "cc-links")
    return labels
