"""Weakly connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.session import drop, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node reachable from node.

    Each round every node takes the least label among itself and its neighbours and then the
    label of that label, so paths shorten by half a round. Labels are written to the shared
    folder between rounds, the round before last being deleted; only a changed-row count reaches the driver. Null ends are ignored;
    an empty edge table gives an empty result. Raises if not settled after max_rounds.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = materialise(ends.union(ends.select("v", "u")).where("u <> v").distinct())
    nodes = ends.select(F.col("u").alias("node")).union(ends.select(F.col("v").alias("node"))).distinct()
    labels = written = materialise(nodes.select("node", F.col("node").alias("component")))
    for _ in range(max_rounds):
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.u, "left").select(
            "node", "component", F.least("component", F.coalesce("near", "component")).alias("low")
        )
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("onward"))
        moved = materialise(
            step.join(jump, step.low == jump["at"], "left").select(
                "node", F.least("low", F.coalesce("onward", "low")).alias("component"), (F.least("low", F.coalesce("onward", "low")) < F.col("component")).alias("changed")
            )
        )
        settled = not moved.where("changed").limit(1).count()
        drop(written)
        labels, written = moved.select("node", "component"), moved
        if settled:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
