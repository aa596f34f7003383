"""The embedding cache as a table: (model_name, text_hash, vector, last_used)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.functions.text import content_hash
from skeinery.operators.embed import Embedder, with_embedding

SCHEMA = "model_name string, text_hash string, vector array<float>, last_used long"


def lookup(texts: DataFrame, cache: DataFrame, model_name: str) -> DataFrame:
    """``texts`` (text, ...) with text_hash, vector (null where missing) and hit."""
    own = cache.filter(F.col("model_name") == model_name).select("text_hash", "vector", F.lit(True).alias("hit"))
    return texts.withColumn("text_hash", content_hash(F.col("text"))).join(own, "text_hash", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def evict(cache: DataFrame, max_size: int) -> DataFrame:
    """The ``max_size`` rows used last, of all models together; ties by model and hash.

    The cut is found by ordering alone (a top-k that Spark keeps by partition), not by one task's window.
    """
    kept = cache.select("model_name", "text_hash", "last_used").orderBy(F.col("last_used").desc(), "model_name", "text_hash").limit(max_size)
    return cache.join(kept.select("model_name", "text_hash"), ["model_name", "text_hash"], "left_semi")


def get_many(texts: DataFrame, cache: DataFrame, embedder: Embedder, now: int, max_size: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(``texts`` with vector, the cache afterwards).

    Each distinct missing text is embedded once; hits and new rows get last_used = ``now``; then the oldest go.
    """
    wanted = texts.select("text", content_hash(F.col("text")).alias("text_hash")).dropDuplicates(["text_hash"])
    own = cache.filter(F.col("model_name") == embedder.name)
    missing = wanted.join(own, "text_hash", "left_anti")
    made = with_embedding(missing, embedder, into="vector").select(F.lit(embedder.name).alias("model_name"), "text_hash", "vector", F.lit(now).cast("long").alias("last_used"))
    touched = cache.join(wanted.select("text_hash", F.lit(True).alias("touched")), "text_hash", "left").select(
        "model_name",
        "text_hash",
        "vector",
        F.when(F.col("touched") & (F.col("model_name") == embedder.name), F.lit(now)).otherwise(F.col("last_used")).cast("long").alias("last_used"),
    )
    after = touched.unionByName(made)
    vectors = after.filter(F.col("model_name") == embedder.name).select("text_hash", "vector")
    answered = texts.withColumn("text_hash", content_hash(F.col("text"))).join(vectors, "text_hash").drop("text_hash")
    return answered, evict(after, max_size)
