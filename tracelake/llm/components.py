"""Connected components of a table of links, by joins and aggregations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; the component is its smallest node.

    Every round, each node takes the smallest label next to it and then the label of that label
    (pointer jumping), so the rounds grow with the logarithm of the longest path. Each round is a
    written table; no link or label reaches the driver. No links give an empty table.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.keep(both, "links")
    label = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = label.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        up = label.select(F.col("node").alias("low"), F.col("component").alias("up"))
        new = low.join(up, "low").select("node", F.least("low", "up").alias("component"), (F.least("low", "up") < F.col("component")).alias("changed"))
        new = scratch.keep(new, "labels")
        scratch.drop(label)
        label = new.select("node", "component")
        if new.where("changed").isEmpty():
            return label


def joined_components(label: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The components ``label(node, component)`` with more ``links(a, b)``; only the components that these touch are walked."""
    if label is None:
        return connected_components(links, scratch)
    of = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    ends = scratch.keep(ends.where("a <> b").distinct(), "joins")
    if ends.isEmpty():
        return label
    up = connected_components(ends, scratch)
    moved = label.join(up.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    fresh = up.join(label.select("node"), "node", "left_anti").select("node", "component")
    return scratch.keep(moved.unionByName(fresh), "labels")
