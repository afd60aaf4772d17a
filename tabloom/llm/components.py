"""Connected components by DataFrame joins: links never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import discard, join_on, written


def joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after more ``links``: only the components that these join are looked at."""
    if labels is None:
        return components(links)
    left = join_on(links.select("a", "b"), labels.select(F.col("node").alias("a"), F.col("component").alias("x")), "a", 48, "left")
    both = join_on(left, labels.select(F.col("node").alias("b"), F.col("component").alias("y")), "b", 48, "left")
    both = both.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    merged = components(both)
    # Members of merged components get the new name; nodes that had no component yet are among the merged ones themselves.
    new = merged.select(F.col("node").alias("component"), F.col("component").alias("new"))
    named = join_on(labels, new, "component", 48, "left").select("node", F.coalesce("new", "component").alias("component"))
    alone = merged.join(labels, "node", "left_anti").join(links.select(F.col("a").alias("node")).union(links.select("b")).distinct(), "node", "left_semi")
    found = written(named.unionByName(alone.select("node", "component")), "components")
    discard(merged)
    return found


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); a component's name is its smallest node.

    Each round, every node takes the smallest label among its neighbours' and its own, and then its label's label
    (pointer jumping), so that chains shrink at least by half. Each round is written to the shared folder and the one
    before deleted. Links are kept from the larger to the smaller side and back; aggregation by node is partial before
    the shuffle, and a node with very many links, or a label that very many nodes have, is joined by a broadcast.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a != b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = join_on(both, labels.select(F.col("node").alias("b"), "label"), "b", 48).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        # The label of a label: what the node named by it has by now.
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("hop"))
        new = join_on(labels.join(near, "node", "left"), hop, "label", 48, "left")
        new = written(new.select("node", F.least("label", "near", "hop").alias("label"), F.col("label").alias("old")), "labels")
        changed = new.where("label != old").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            discard(both)
            found = labels.select("node", F.col("label").alias("component"))
            found.scratch_path = labels.scratch_path
            return found
