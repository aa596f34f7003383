"""Weighted reciprocal rank fusion, the candidate cut, blends and the final order.

ranked: (query_id, list_no, rank, node_id). lists: (query_id, list_no, weight), one row for every list that was asked
for, also those that returned nothing: they stay in the denominator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETRIEVERS = 3  # vector, keywords, wide: the order in which equal scores were first seen


def ranked_lists(wide: DataFrame, keywords: DataFrame, narrow_k: int) -> DataFrame:
    """The three lists of each variant from two searches: the narrow list is the head of the wide one."""
    number = lambda at: (F.col("variant_no") * RETRIEVERS + at).alias("list_no")
    rows = lambda df, at: df.select("query_id", number(at), "rank", "node_id")
    return rows(wide.filter(F.col("rank") <= narrow_k), 0).unionByName(rows(keywords, 1)).unionByName(rows(wide, 2))


def list_weights(asked: DataFrame, original_weight: float = 1.5) -> DataFrame:
    """lists for ``asked`` (query_id, variant_no, variant, query): variants equal to the query weigh more."""
    weight = F.when(F.col("variant") == F.col("query"), original_weight).otherwise(1.0)
    at = F.explode(F.sequence(F.lit(0), F.lit(RETRIEVERS - 1)))
    return asked.select("query_id", "variant_no", weight.alias("weight"), at.alias("at")).select("query_id", (F.col("variant_no") * RETRIEVERS + F.col("at")).alias("list_no"), "weight")


def rrf(ranked: DataFrame, lists: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, node_id, rrf, first_list, first_rank); rank 1 in every list is 1. Rounded to 9 digits."""
    best = lists.groupBy("query_id").agg(F.sum(F.col("weight") / (k + 1)).alias("best"))
    share = F.col("weight") / (F.lit(k) + F.col("rank"))
    fused = ranked.join(lists, ["query_id", "list_no"]).groupBy("query_id", "node_id").agg(F.sum(share).alias("sum"), F.min(F.struct("list_no", "rank")).alias("first"))
    return fused.join(best, "query_id").select(
        "query_id", "node_id", F.round(F.col("sum") / F.col("best"), 9).alias("rrf"), F.col("first.list_no").alias("first_list"), F.col("first.rank").alias("first_rank")
    )


def cut(fused: DataFrame, n: int = 30) -> DataFrame:
    """The n best of each query with cand_rank; ties in first-seen order."""
    order = Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), "first_list", "first_rank", "node_id")
    return fused.withColumn("cand_rank", F.row_number().over(order)).filter(F.col("cand_rank") <= n)


def blend_cosine(cosine: Column, rrf_: Column, alpha=0.7) -> Column:
    """alpha * cosine + (1 - alpha) * rrf; a missing rrf is 0."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return a * cosine.cast("double") + (1 - a) * F.coalesce(rrf_.cast("double"), F.lit(0.0))


def blend_cross_encoder(logit: Column, rrf_: Column, weight=0.85) -> Column:
    """weight * sigmoid(logit) + (1 - weight) * rrf; a missing rrf is 0."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return w / (1 + F.exp(-logit.cast("double"))) + (1 - w) * F.coalesce(rrf_.cast("double"), F.lit(0.0))


def top_k(scored: DataFrame, k: int = 8) -> DataFrame:
    """The k best of each query by score (9 digits), with rank; ties in candidate order."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "cand_rank")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
