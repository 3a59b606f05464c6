"""Connected components of a large graph, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tributary.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has an edge.

    ``edges`` has two columns of one sortable type; nulls and loops tie nothing
    and are left out, repeated edges count once. In a round each node points at
    its smallest neighbour if that is smaller, pointers are followed once more,
    and edges are carried over to what their ends point at. Nodes that are no
    local minimum disappear, so rounds grow with the logarithm of the nodes.
    Each round is a written table; no group is gathered: all that is kept per
    node is a minimum, which tasks combine before the shuffle.
    """
    a, b = (F.col(f"`{c}`") for c in edges.columns)
    edges = materialize(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
                        .filter(a.isNotNull() & b.isNotNull() & (F.col("u") < F.col("v"))).distinct(), "edges")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    labels = materialize(nodes.withColumn("root", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = materialize(both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("p")), "pointers")
        onward = to.select(F.col("u").alias("p"), F.col("p").alias("onward"))
        to = materialize(to.join(onward, "p").select("u", F.col("onward").alias("p")), "pointers")
        labels = materialize(labels.join(to.select(F.col("u").alias("root"), "p"), "root", "left")
                             .select("node", F.coalesce("p", "root").alias("root")), "labels")
        ends = (edges.join(to, "u").select(F.col("p").alias("a"), F.col("v").alias("u")).join(to, "u").select("a", F.col("p").alias("b")))
        edges = materialize(ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
                            .filter(F.col("u") < F.col("v")).distinct(), "edges")
    return labels
