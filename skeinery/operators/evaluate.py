"""Recall, reciprocal rank and nDCG over batches of queries.

retrieved: (query_id, rank, file). golden: (query_id, query, relevant_files).
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

GOLDEN = "query_id long, query string, relevant_files array<string>"


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """A JSONL file of {query, relevant_files}; blank lines are skipped, a bad entry is a ValueError with path:line.

    A golden set is written by hand; it is read on the driver, through Spark, for the sake of line numbers.
    """
    rows = []
    whole = spark.read.text(path, wholetext=True).first()
    for number, line in enumerate((whole.value if whole else "").split("\n"), 1):
        if not line.strip():
            continue
        try:
            entry = json.loads(line)
        except ValueError as e:
            raise ValueError(f"{path}:{number}: {e}") from None
        query, files = entry.get("query"), entry.get("relevant_files")
        if not query or not files:
            raise ValueError(f"{path}:{number}: query and relevant_files must be there and not be empty")
        rows.append((len(rows), query, files))
    return spark.createDataFrame(rows, GOLDEN)


#: Bytes of queries in one automaton; more are answered by several, a scan of the files each.
AUTOMATON_BYTES = 8 << 20


@lru_cache(maxsize=2)
def _automaton(token: str, queries: tuple[str, ...]):
    """Of the queries that aren't empty; built once a worker for a block of queries."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for q in queries:
        if q:
            out.add_word(q, q)
    out.make_automaton()
    return out


def holders(files: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, query, file_name) where the text of ``files`` (file_name, text) contains the query of ``asked`` whole.

    An automaton over all queries finds those that a text holds in one pass over it, so the files are scanned once and
    nothing of them is shuffled. Queries go to the tasks in blocks of a checked size. Nulls are held by nothing and hold
    nothing; the empty query is held by every text.
    """
    items = asked.filter(F.col("query").isNotNull()).select("query_id", "query").distinct()
    size = items.agg(F.sum(F.octet_length("query")).alias("n")).first().n or 0
    blocks = max(1, -(-size // AUTOMATON_BYTES))
    spark, kind = files.sparkSession, asked.schema["query_id"].dataType.simpleString()
    found = None
    for block in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block)
        by_query: dict[str, list] = {}
        for r in own.toLocalIterator():  # a block's bytes at most
            by_query.setdefault(r.query, []).append(r.query_id)
        hits = _held(files, spark.sparkContext.broadcast(by_query), kind)
        found = hits if found is None else found.unionByName(hits)
    return found.distinct()


def _held(files: DataFrame, shared, kind: str) -> DataFrame:
    token = uuid.uuid4().hex

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_query = shared.value
        automaton = _automaton(token, tuple(by_query)) if any(by_query) else None
        for batch in batches:
            ids, queries, names = [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None:
                    continue
                held = {q for _, q in automaton.iter(text)} if automaton else set()
                if "" in by_query:
                    held.add("")
                for q in held:
                    ids += by_query[q]
                    queries += [q] * len(by_query[q])
                    names += [name] * len(by_query[q])
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, queries, names), schema)], schema=schema)

    columns = f"query_id {kind}, query string, file_name string"
    schema = to_arrow_schema(files.sparkSession.createDataFrame([], columns).schema)
    return files.select("file_name", "text").mapInArrow(search, columns)


def ranked_files(chunks: DataFrame) -> DataFrame:
    """(query_id, rank, file) from (query_id, rank, file) of chunks: each file once, at its best place; no null or empty file."""
    files = chunks.filter(F.coalesce("file", F.lit("")) != "").groupBy("query_id", "file").agg(F.min("rank").alias("first"))
    order = Window.partitionBy("query_id").orderBy("first", "file")
    return files.select("query_id", F.row_number().over(order).alias("rank"), "file")


def metrics(retrieved: DataFrame, golden: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, recall, mrr, ndcg), a row for every golden query; an empty relevant set is an error."""
    wanted = golden.select("query_id", F.array_distinct("relevant_files").alias("files"))
    n = F.when(F.size("files") > 0, F.size("files")).otherwise(F.raise_error(F.lit("relevant files must not be empty")).cast("int"))
    wanted = wanted.withColumn("n", n)
    hits = retrieved.join(wanted.select("query_id", F.explode("files").alias("file")), ["query_id", "file"]).groupBy("query_id")
    gain = F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0))
    hits = hits.agg(F.count_if(F.col("rank") <= k).alias("found"), F.min("rank").alias("first"), F.sum(gain).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return wanted.join(hits, "query_id", "left").select(
        "query_id",
        F.round(F.coalesce("found", F.lit(0)) / F.col("n"), 9).alias("recall"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 9).alias("mrr"),
        F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 9).alias("ndcg"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """The means; null for no rows."""
    return rows.agg(*(F.round(F.avg(c), 6).alias(c) for c in ("recall", "mrr", "ndcg")), F.count("*").alias("n_queries"))


def evaluate(golden: DataFrame, k: int, search: Callable[[DataFrame, int], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(per query, summary) of ``search(queries, top_k)``, which returns (query_id, rank, file, ...) for all queries at once."""
    found = ranked_files(search(golden.select("query_id", "query"), k).select("query_id", "rank", "file"))
    files = found.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "file"))), lambda x: x["file"]).alias("retrieved"))
    rows = golden.select("query_id", "query").join(metrics(found, golden, k), "query_id").join(files, "query_id", "left")
    rows = rows.withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>")))
    return rows, summary(rows)


def report(per_query: DataFrame, means: DataFrame, k: int, out: str | None = None, stream=None) -> str:
    """The report as a table of fixed width (golden sets are small); with ``out`` also as a JSON file."""
    rows, mean = per_query.orderBy("query_id").collect(), means.first()
    lines = [f"{'query':<48} {f'recall@{k}':>10} {'mrr':>8} {f'ndcg@{k}':>10}", "-" * 79]
    line = lambda name, r: f"{name:<48} {r.recall or 0:>10.3f} {r.mrr or 0:>8.3f} {r.ndcg or 0:>10.3f}"
    lines += [line(r.query[:47], r) for r in rows] + ["-" * 79, line(f"MEAN ({len(rows)} queries)", mean)]
    print("\n".join(lines), file=stream or sys.stdout)
    if out:
        names = {"recall": f"recall@{k}", "mrr": "mrr", "ndcg": f"ndcg@{k}"}
        document = {
            "per_query": [{"query": r.query, "retrieved": r.retrieved, **{v: r[c] for c, v in names.items()}} for r in rows],
            "summary": {v: mean[c] for c, v in names.items()} if rows else {},
        }
        with open(out, "w", encoding="utf-8") as f:
            json.dump(document, f, indent=2)
    return "\n".join(lines)
