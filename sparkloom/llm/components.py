"""Connected components of an edge table, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, is_empty, look_up, settle


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in edges (src, dst long); component is its smallest reachable node.

    Each round a node takes the smallest label among its neighbours and then that label's own label
    (pointer jumping), so paths halve. A round's labels are a reliable checkpoint: the lineage stays
    short and nothing goes to the driver but a count of changed labels. Null ends and loops are ignored.
    A node with a great part of all links, and a label that a great part of all nodes have, are looked up by
    broadcast, so that neither sends its rows to one task.
    """
    pairs = edges.where("src is not null and dst is not null and src <> dst")
    both = settle(pairs.select("src", "dst").union(pairs.select("dst", "src")).distinct())
    degrees = settle(both.groupBy(F.col("src").alias("node")).agg(F.least(F.first("src"), F.min("dst")).alias("component"), F.count(F.lit(1)).alias("n")))
    labels = degrees
    for _ in range(max_rounds):
        near = look_up(both, labels.select(F.col("node").alias("dst"), "component", "n"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        moved = settle(labels.join(near, "node").select("node", "n", F.col("component").alias("was"), F.least("component", "near").alias("label")))
        used = moved.groupBy("label").agg(F.count(F.lit(1)).alias("held"))
        jump = settle(used.join(moved.select(F.col("node").alias("label"), F.col("label").alias("next")), "label"))
        labels = look_up(moved, jump, "label", "held")
        labels = settle(labels.select("node", "n", F.least("label", "next").alias("component"), (F.col("was") != F.least("label", "next")).alias("changed")))
        changed = not is_empty(labels.where("changed"))
        free_shuffles(labels.sparkSession)
        labels = labels.drop("changed")
        if not changed:
            return labels.select("node", "component")
    raise RuntimeError(f"labels still change after {max_rounds} rounds")
