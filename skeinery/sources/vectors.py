"""Embedded texts as a key-value table: (model_name, text_hash) to vector, dealt into buckets.

<root>/vectors/model=../bucket=../ (model: a hash of its name) holds the vectors, <root>/used/ what was used when. New vectors are appended to
their buckets; a hit costs a row in ``used``, no rewrite. When there are more than ``max_size`` vectors, a threshold on the
last use decides which go (ties by model and hash), and only buckets that lose some are written again; ``used`` shrinks to
a row a vector with that. Models don't mix: the name is part of the key.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinery.functions.text import content_hash
from skeinery.operators.embed import Embedder, with_embedding
from skeinery.sources.files_on import Store
from skeinery.sources.scratch import written

VECTORS = "model_name string, text_hash string, vector array<float>, model string, bucket int"
USED = "model_name string, text_hash string, last_used long"


def folder_of(model: str) -> str:
    return hashlib.sha256(model.encode()).hexdigest()[:16]


class VectorTable:
    def __init__(self, spark: SparkSession, root: str, max_size: int = 50_000, buckets: int = 16, clock: Callable[[], float] | None = None):
        self.spark, self.root, self.max_size, self.buckets, self.clock = spark, root.rstrip("/"), max_size, buckets, clock or time.time
        self.store = Store(spark, self.root)

    def _table(self, part: str, schema: str) -> DataFrame:
        if not self.store.exists(part):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{part}")

    def vectors(self) -> DataFrame:
        """model_name, text_hash, vector and last_used of every text that is remembered."""
        last = self._table("used", USED).groupBy("model_name", "text_hash").agg(F.max("last_used").alias("last_used"))
        own = self._table("vectors", VECTORS).dropDuplicates(["model_name", "text_hash"])  # two writers may have added one
        return own.join(last, ["model_name", "text_hash"]).select("model_name", "text_hash", "vector", "last_used")

    def _of(self, model: str) -> DataFrame:
        rows = self._table("vectors", VECTORS).filter((F.col("model") == folder_of(model)) & (F.col("model_name") == model))  # reads that model's folders
        return rows.select("text_hash", "vector").dropDuplicates(["text_hash"])

    def embedded(self, rows: DataFrame, embedder: Embedder, text: str = "text", into: str = "embedding") -> DataFrame:
        """``rows`` with the vectors of their texts: each distinct text that isn't remembered is embedded, once, and remembered.

        What is returned reads a written table of its own, so an eviction takes nothing from it.
        """
        spare = "_hash"
        while spare in rows.columns:
            spare = "_" + spare
        rows = written(rows.withColumn(spare, content_hash(F.coalesce(F.col(text), F.lit("")))), "rows-to-embed")
        texts = rows.groupBy(F.col(spare).alias("text_hash")).agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("text"))
        known = self._of(embedder.name)
        missing = with_embedding(texts.join(known.select("text_hash"), "text_hash", "left_anti"), embedder, into="vector")
        bucket = F.pmod(F.xxhash64("text_hash"), F.lit(self.buckets)).cast("int")
        made = missing.select(F.lit(embedder.name).alias("model_name"), "text_hash", "vector", F.lit(folder_of(embedder.name)).alias("model"), bucket.alias("bucket"))
        made.repartition("bucket").write.mode("append").partitionBy("model", "bucket").parquet(f"{self.root}/vectors")
        now = texts.select(F.lit(embedder.name).alias("model_name"), "text_hash", F.lit(int(self.clock() * 1000)).cast("long").alias("last_used"))
        now.coalesce(self.buckets).write.mode("append").parquet(f"{self.root}/used")
        answered = rows.join(self._of(embedder.name).withColumnRenamed("text_hash", spare), spare).drop(spare).withColumnRenamed("vector", into)
        answered = written(answered, "embedded")
        self.evict()
        return answered

    def evict(self) -> int:
        """Forget the vectors used least recently beyond ``max_size``; how many went."""
        last = self._table("used", USED).groupBy("model_name", "text_hash").agg(F.max("last_used").alias("last_used"))
        # Uses by time, newest first: one row for each build or search, few against the vectors.
        left, threshold = self.max_size, None
        for r in last.groupBy("last_used").agg(F.count("*").alias("n")).orderBy(F.desc("last_used")).toLocalIterator():
            if r.n > left:
                threshold = r.last_used
                break
            left -= r.n
        if threshold is None:
            return 0
        tied = last.filter(F.col("last_used") == threshold).orderBy("model_name", "text_hash").limit(left).select("model_name", "text_hash", "last_used")
        kept = last.filter(F.col("last_used") > threshold).unionByName(tied)
        gone = last.join(kept.select("model_name", "text_hash"), ["model_name", "text_hash"], "left_anti").select("model_name", "text_hash")
        whole = self._table("vectors", VECTORS)
        losing = whole.join(gone, ["model_name", "text_hash"], "left_semi").select("model", "bucket").distinct()
        rest = whole.join(losing, ["model", "bucket"], "left_semi").join(kept.select("model_name", "text_hash"), ["model_name", "text_hash"], "left_semi").dropDuplicates(["model_name", "text_hash"])
        fresh = uuid.uuid4().hex
        n = gone.count()
        rest.repartition("model", "bucket").write.partitionBy("model", "bucket").parquet(f"{self.root}/fresh-{fresh}/vectors")
        kept.coalesce(self.buckets).write.parquet(f"{self.root}/fresh-{fresh}/used")
        # Whole new folders take the losing buckets' places one by one. A failure between the two steps forgets a bucket's vectors, which are then made again.
        for r in losing.collect():  # at most buckets x models
            folder = f"model={r.model}/bucket={r.bucket}"
            self.store.delete(f"vectors/{folder}")
            self.store.take(f"fresh-{fresh}/vectors/{folder}", f"vectors/{folder}")
        self.store.delete("used")
        self.store.take(f"fresh-{fresh}/used", "used")
        self.store.delete(f"fresh-{fresh}")
        return n
