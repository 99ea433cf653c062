"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """node, label (the smallest node of its component) of every node of an edge list; by the smallest label of the neighbours and pointer jumping.

    A round takes the smallest label among a node's neighbours, by partial minimum, so a hub is never gathered, and then
    the label of that label. Labels are written to the shared folder each round, the last ones removed. Nulls are no nodes; loops and repeated edges don't matter.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    nodes = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct()
    label = cut(nodes.withColumn("label", F.col("node")))
    links = cut(e.filter("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    both = cut(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    last = label
    for _ in range(most):
        near = both.join(label.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("m"))
        new = label.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("m", "label")).alias("label"))
        top = new.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = cut(new.join(top, "label", "left").select("node", "was", F.least("label", F.coalesce("top", "label")).alias("label")))
        changed = new.filter("was != label").limit(1).count()
        discard(last)
        last, label = new, new.select("node", "label")
        if not changed:
            return label
    raise RuntimeError("the links are longer than most rounds can follow")


def groups(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label, size of components of two nodes or more."""
    c = components(edges, a, b)
    return c.join(c.groupBy("label").agg(F.count("*").alias("size")).filter("size > 1"), "label").select("node", "label", "size")
