"""Connected components by alternating large-star and small-star steps, each a written table that goes when the components are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.llm._common import materialise, scratch_scope


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 60, partial: bool = False) -> DataFrame:
    """(node, root) for every node with an edge; root is the component's smallest node.

    With ``partial`` the steps end after ``rounds`` at the latest: nodes with one root are connected, but a component may have several.

    The result is a written table. Minima are pre-aggregated, and edges meet them in a join of two written tables, whose hot keys AQE splits. Self
    loops and repeated edges are allowed; an empty table gives an empty table.
    """
    with scratch_scope(edges.sparkSession):
        edges = materialise(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u != v").distinct(), "edges")
        last = _signature(edges)
        for _ in range(rounds):
            if not last[0]:
                break
            # Large star: every node hands its larger neighbours to its smallest neighbour, or to itself if that is smaller.
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
            large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
            large = materialise(large, "large-star")
            # Small star: every node hands itself and its smaller neighbours to the smallest of them.
            least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
            small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
            edges = materialise(small.filter("u != v").distinct(), "edges")
            now = _signature(edges)
            if now == last:
                break
            last = now
        else:
            if not partial:
                raise RuntimeError("components did not settle")
            labels = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")))
            return materialise(labels.groupBy("node").agg(F.min("root").alias("root")), "roots", keep=True)
        leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        return materialise(leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots", keep=True)
