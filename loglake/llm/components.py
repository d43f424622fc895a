"""Connected components of a link table, by joins and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import save


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of links (a, b).

    Each round takes the smallest label of the neighbours, then the label of
    that label, and is written to the shared folder, so rounds grow with the
    logarithm of a component's diameter. Nothing but a count reaches the
    driver; hot nodes are pre-aggregated in the minimum and split in the join.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = save(both, "component-links")
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                  .select("node", F.least("node", "m").alias("component")), "component-labels")
    while True:
        near = (both.join(labels, both["b"] == labels["node"])
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m")))
        lower = labels.join(near, "node").select("node", "component", F.least("component", "m").alias("m"))
        step = lower.alias("x").join(labels.select(F.col("node").alias("at"), F.col("component").alias("to")),
                                     F.col("m") == F.col("at"))
        step = save(step.select("node", F.col("component").alias("was"), F.least("m", "to").alias("component")), "component-labels")
        labels = step.select("node", "component")
        if step.where("was <> component").isEmpty():
            return labels


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) whose ends are in different components, with these as _a and _b."""
    for side in "ab":
        label = labels.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
        pairs = pairs.join(label, side, "left").withColumn(f"_{side}", F.coalesce(f"_{side}", side))
    return pairs.where("_a <> _b")


def merge_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after links (a, b) between labelled or new nodes have been added.

    Only what the links connect anew is searched, component by component.
    """
    merged = connected_components(across(links, labels).select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
    new = (links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
           .select("node", F.col("node").alias("component")))
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return save(labels.unionByName(new).join(merged, "component", "left").select("node", F.coalesce("to", "component").alias("component")),
                "component-labels")
