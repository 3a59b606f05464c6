"""Groups that follow from pairs: which nodes hang together."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tributary.session import materialize, shuffled


def connected(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, group): every node of ``pairs`` and the smallest node it hangs together with.

    A round gives each node the smallest group among its own and its
    neighbours', then the group that this group's own node has by now. Both are
    minima, combined before the shuffle, so a node with very many neighbours
    costs no more than any other. Long chains halve with every round.
    """
    ends = pairs.select(F.col(a).alias("node"), F.col(b).alias("other")).filter("node IS NOT NULL AND other IS NOT NULL")
    edges = materialize(ends.unionByName(ends.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    groups = materialize(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("group")), "groups")
    while True:
        near = edges.join(groups.select(F.col("node").alias("other"), "group"), "other").groupBy("node").agg(F.min("group").alias("near"))
        # what a neighbour tells a node, it also tells the node's group
        told = groups.join(near, "node").select("group", "near").groupBy("group").agg(F.min("near").alias("told"))
        heard = groups.join(near, "node").join(shuffled(told), "group").select("node", F.least("group", "near", "told").alias("next"))
        onward = heard.select(F.col("node").alias("next"), F.col("next").alias("onward"))
        moved = materialize(heard.join(shuffled(onward), "next").join(groups, "node").select("node", F.col("onward").alias("group"), (F.col("onward") != F.col("group")).alias("moved")), "groups")
        groups = moved.select("node", "group")
        if moved.filter("moved").isEmpty():
            return groups
