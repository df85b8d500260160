"""PageRank by power iteration over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialise


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6, every: int = 5, nodes: DataFrame | None = None) -> DataFrame:
    """(node, rank) of the nodes of ``edges`` (src, dst[, weight]) and of ``nodes`` (node); ranks sum to 1.

    What nodes without edges out hold is spread evenly.  Stops once the ranks move
    by less than ``tolerance`` for each node in all, or after ``rounds``.  The ranks are
    written every few rounds, which cuts the lineage.
    """
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    flows = edges.groupBy("src", "dst").agg(F.sum(weight).alias("weight"))
    out = flows.groupBy("src").agg(F.sum("weight").alias("total"))
    flows = materialise(flows.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "flows")
    ends = flows.select(F.col("src").alias("node")).unionByName(flows.select(F.col("dst").alias("node")))
    nodes = (ends if nodes is None else ends.unionByName(nodes.select("node"))).distinct()
    sources = flows.select(F.col("src").alias("node")).distinct().withColumn("linked", F.lit(True))
    nodes = materialise(nodes.join(sources, "node", "left").withColumn("linked", F.coalesce("linked", F.lit(False))), "nodes")
    n = nodes.count()
    if n == 0:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for step in range(1, rounds + 1):
        loose = ranks.agg(F.coalesce(F.sum(F.when(~F.col("linked"), F.col("rank"))), F.lit(0.0)).alias("loose"))
        given = flows.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("given"))
        after = (
            ranks.withColumnRenamed("rank", "_before").join(given, "node", "left").crossJoin(F.broadcast(loose))  # one row
            .select("node", "linked", "_before", ((1 - damping) / n + damping * (F.coalesce("given", F.lit(0.0)) + F.col("loose") / n)).alias("rank"))
        )
        if step % every == 0 or step == rounds:
            after = materialise(after, "ranks")
            if tolerance is not None and after.agg(F.sum(F.abs(F.col("rank") - F.col("_before")))).first()[0] < n * tolerance:
                return after.select("node", "rank")
        ranks = after.select("node", "linked", "rank")
    return ranks.select("node", "rank")


def normalised(ranks: DataFrame) -> DataFrame:
    """Ranks as shares of the largest, nodes in lower case."""
    top = ranks.agg(F.max("rank")).first()[0]
    share = F.col("rank") / F.lit(top) if top else F.col("rank")
    return ranks.select(F.lower("node").alias("node"), share.alias("rank"))
