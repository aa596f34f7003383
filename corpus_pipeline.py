"""A training corpus from ``documents``: toxicity, line dedup, SimHash near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the
columns of documents. No stage but the first reads another table (it learns from ``labels``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinery.llm import line_dedup, mixing, packing, simhash, similar, toxicity
from skeinery.llm._common import materialise, scratch_scope, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network scores at 0.5 or more go."""
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.filter(F.col(scored.columns[-1]) < 0.5).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 40 characters in at least 5 documents stay in the largest doc_id alone; n_chars follows the text."""
    got = line_dedup.dedup_lines(docs, min_chars=40, min_docs=5)
    kept = got.columns[len(docs.columns)]
    text = {"text": F.col(kept), "n_chars": F.length(kept).cast(docs.schema["n_chars"].dataType)}
    return got.select(*[text.get(c, F.col(c)).alias(c) for c in docs.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles, the one with the smallest doc_id stays."""
    return simhash.representatives(docs, similar.near_duplicates, words=5, similarity=0.8)


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets: a document comes not at all, once or twice."""
    return mixing.mixed(docs, weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", without_near_duplicates),
    ("mixing", mixed_to_weights),
    ("packing", packed),
]

#: SQL can express neither the network nor the fingerprints; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's rows written as Parquet and read again by the next; what a stage wrote for itself goes with it."""
    docs = table(spark, sf_dir, "documents")
    with scratch_scope(spark):
        for name, stage in STAGES[:-1]:
            with scratch_scope(spark):
                docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        return materialise(STAGES[-1][1](spark, docs, sf_dir), f"pipeline-{STAGES[-1][0]}", keep=True)
