"""The search engine: a table of queries in, ranked chunks for all of them out, in one plan."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.config import Settings
from skeinery.functions import vectors
from skeinery.operators import fuse, retrieve
from skeinery.operators.embed import Embedder, with_embedding
from skeinery.operators.retrieve import Blocks, Postings

#: logits(queries, texts): a model that reads both together.
CrossEncoder = Callable[[list[str], list[str]], list[float]]


class HybridEngine:
    """``chunks`` has node_id, file_name, file_path, text, embedding (and text_embedding where re-ranking should use another).

    Chunks without vectors are embedded when they are searched: each once for the vector search, and the few candidates again for the score.
    ``settle`` (``sources.scratch.written``) is given the retrievers' lists and the candidates, which are small and used several times: as
    written tables they have a known size, so that the texts they are joined with aren't shuffled, and no search runs twice.
    """

    def __init__(self, chunks: DataFrame, postings: Postings | Blocks, embedder: Embedder, settings: Settings = Settings(), cross_encoder: CrossEncoder | None = None, settle: Callable[[DataFrame, str], DataFrame] = retrieve.lazily):
        self.chunks, self.postings, self.embedder, self.settings, self.cross_encoder, self.settle = chunks, postings, embedder, settings, cross_encoder, settle

    @classmethod
    def over(cls, index, settings: Settings = Settings(), cross_encoder: CrossEncoder | None = None) -> HybridEngine:
        """The engine over a stored index (``sources.index.VersionedIndex``); an index that is missing or empty is an error."""
        index.check()
        return cls(index.chunks(), index.blocks(), index.embedder, settings, cross_encoder)

    def vectors(self) -> DataFrame:
        return self.chunks if "embedding" in self.chunks.columns else with_embedding(self.chunks.select("node_id", "text"), self.embedder)

    def retrieve(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(ranked, lists) of the three retrievers for every variant; the vectors are scanned once, for the wide list."""
        s = self.settings
        asked = with_embedding(retrieve.variants(queries, s.suffixes), self.embedder, text="variant")
        wide = self.settle(retrieve.knn(self.vectors(), asked, s.wide_k), "wide")
        keywords = self.settle(retrieve.bm25(self.postings, asked, s.bm25_k, s.bm25_k1, s.bm25_b, self.settle), "keywords")
        return fuse.ranked_lists(wide, keywords, s.narrow_k), fuse.list_weights(asked, s.original_weight)

    def candidates(self, queries: DataFrame) -> DataFrame:
        ranked, lists = self.retrieve(queries)
        return fuse.cut(fuse.rrf(ranked, lists, self.settings.rrf_k), self.settings.rerank_candidates)

    def scored(self, queries: DataFrame) -> DataFrame:
        """Candidates with their texts and the final score."""
        second = next((c for c in ("text_embedding", "embedding") if c in self.chunks.columns), None)
        vector = [F.col(second).alias("node_vector")] if second else []
        found = self.settle(self.candidates(queries), "candidates").join(self.chunks.select("node_id", "file_name", "file_path", "text", *vector), "node_id")
        if not second and not self.cross_encoder:
            found = with_embedding(found, self.embedder, into="node_vector")
        if self.cross_encoder:
            model = self.cross_encoder

            @F.arrow_udf("double")
            def logit(qs: pa.Array, texts: pa.Array) -> pa.Array:
                return pa.array([float(x) for x in model(qs.to_pylist(), texts.to_pylist())], pa.float64())

            found = found.join(queries.select("query_id", "query"), "query_id")
            return found.withColumn("score", fuse.blend_cross_encoder(logit(F.col("query"), F.col("text")), F.col("rrf"), self.settings.cross_encoder_weight))
        asked = with_embedding(queries.select("query_id", "query"), self.embedder, text="query", into="query_vector")
        found = found.join(asked, "query_id")
        cosine = F.round(vectors.cosine(F.col("query_vector"), F.col("node_vector")), 9)
        return found.withColumn("score", fuse.blend_cosine(cosine, F.col("rrf"), self.settings.alpha))

    def search(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """(query_id, rank, file, path, text, score, node_id) for ``queries`` (query_id, query); scores are rounded after ranking."""
        best = fuse.top_k(self.scored(queries), top_k or self.settings.top_k)
        text = F.substring("text", 1, self.settings.result_chars)
        return best.select("query_id", "rank", F.col("file_name").alias("file"), F.col("file_path").alias("path"), text.alias("text"), F.round("score", 3).alias("score"), "node_id")


def documents(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, answer, sources, context): one result document for each query, also for those without results."""
    row = F.struct("rank", "file", "path", "text", "score")
    each = results.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("context"), F.array_sort(F.collect_set("file")).alias("sources"), F.count("*").alias("n"))
    all_ = queries.select("query_id").join(each, "query_id", "left")
    n = F.coalesce("n", F.lit(0))
    empty = F.array().cast(each.schema["context"].dataType)
    return all_.select(
        "query_id",
        F.format_string("Top %d relevant code snippets retrieved. See context for details.", n).alias("answer"),
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
        F.coalesce("context", empty).alias("context"),
    )


class Cached:
    """A bounded memory of single queries' result documents, forgotten when the index version changes."""

    def __init__(self, engine_of: Callable[[], tuple[str, HybridEngine]], size: int = 256):
        self.engine_of, self.size, self.kept = engine_of, size, OrderedDict()

    def query(self, question: str, top_k: int | None = None) -> dict:
        version, engine = self.engine_of()
        key = (version, question, top_k)
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key]
        asked = engine.chunks.sparkSession.createDataFrame([(0, question)], "query_id long, query string")
        found = documents(engine.search(asked, top_k), asked).select(F.to_json(F.struct("answer", "sources", "context")).alias("json")).first()
        self.kept[key] = json.loads(found.json)
        if len(self.kept) > self.size:
            self.kept.popitem(last=False)
        return self.kept[key]
