"""Connected components by randomised contraction: each round every node moves to its least neighbour under a fresh hash, edges are relabelled, loops and repeats go.

A constant share of the nodes goes in each round whatever the graph's shape, so long chains need logarithmically many
rounds. All tables stay distributed; each round is written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.session import cut


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (a, b) -> node, label: nodes of one component share a label, which is one of them. Nodes without edges do not appear."""
    left = cut(edges.where("a <> b").select("a", "b").distinct(), f"{name}-edges")
    labels, seed = None, 0
    while not left.isEmpty():
        seed += 1
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64(F.lit(seed), "b").alias("h"), F.col("b").alias("x"))).alias("t"))
        own = F.struct(F.xxhash64(F.lit(seed), "a").alias("h"), F.col("a").alias("x"))
        moves = cut(best.select(F.col("a").alias("node"), F.least("t", own)["x"].alias("to")), f"{name}-moves")
        if labels is None:
            labels = moves.select("node", F.col("to").alias("label"))
        else:
            m = moves.select(F.col("node").alias("_n"), "to")
            labels = cut(labels.join(m, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("to", "label").alias("label")), f"{name}-labels")
        ma, mb = moves.select(F.col("node").alias("a"), F.col("to").alias("_a")), moves.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        left = left.join(ma, "a").join(mb, "b").where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
        left = cut(left, f"{name}-edges")
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
