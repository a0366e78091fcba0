"""Connected components by joins: every node takes the smallest label around it, then labels of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import MOST_TOGETHER, Scratch, together


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of edges (a, b), component being the smallest id reachable.

    Each round takes, for every node, the least label among its neighbours (a sum per map task goes ahead of
    the shuffle, so a hub costs one row a task), hooks the label's root to it and jumps from label to label;
    the number of rounds grows with the logarithm of a chain's length. Rounds are written tables, so a lost
    executor costs a task and nothing is gathered at the driver but one count a round. Up to MOST_TOGETHER edges the
    rounds run in one task. Rows with a null end and loops count for nothing; no edges give no rows."""
    pairs = edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    both = scratch.cut(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    small = both.count() <= MOST_TOGETHER
    both = together(both, small)
    label = scratch.cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")), "label")
    label = together(label, small)
    for _ in range(most_rounds):
        # least label among the neighbours of each node, and the same told to the node's present root
        near = both.join(label.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        own = label.join(near, "id").select("id", F.least("near", "component").alias("least"), "component")
        told = own.where("least < component").select(F.col("component").alias("id"), "least", F.lit(None).cast("long").alias("component"))
        told = together(own.union(told), small).groupBy("id").agg(F.min("least").alias("least"), F.max("component").alias("before"))
        # a label's own label
        jump = told.select(F.col("id").alias("least"), F.col("least").alias("next"))
        moved = told.join(jump, "least", "left").select("id", F.coalesce("next", "least").alias("component"), "before")
        new = scratch.cut(moved, "label")
        scratch.drop(label)
        label = together(new.select("id", "component"), small)
        if not new.where("component <> before").limit(1).count():
            scratch.drop(both)
            return label
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
