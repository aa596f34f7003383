"""Retrievers that answer a whole table of query variants: exact nearest neighbours and BM25.

Both are tiled products, of vectors or of term weights; BM25 reads postings whole or in blocks that a threshold skips. Both return (query_id, variant_no, node_id, score, rank). Scores are rounded to 9 digits before they are ranked, so
that sums in another order rank alike; ties go to the smaller node_id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinery.functions.text import expand_query, terms

#: Query vectors and rows in a tile of the product.
QUERY_BLOCK, ROW_BLOCK = 2048, 8192
#: The same for BM25, whose tiles hold a score for each pair.
ASKED_BLOCK, NODE_BLOCK = 1024, 4096
#: Postings in a block, about; blocks whose postings a query reads first to get a threshold.
BLOCK, FIRST_BLOCKS = 128, 8
#: What a score may seem to fall short of a threshold by summing in another order and rounding.
SLACK = 1e-8
HIT = "query_id long, variant_no int, node_id string, score double"


def lazily(df: DataFrame, tag: str) -> DataFrame:
    """What ``settle`` does by default: small tables that are used again are computed again. ``scratch.written`` writes them."""
    return df


def variants(queries: DataFrame, suffixes) -> DataFrame:
    """``queries`` (query_id, query) as (query_id, variant_no, variant, query); the query itself is variant 0."""
    return queries.select("query_id", "query", F.posexplode(expand_query(F.col("query"), suffixes)).alias("variant_no", "variant"))


def top(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "variant_no").orderBy(F.col("score").desc(), "node_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn(vectors: DataFrame, asked: DataFrame, k: int, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """The k vectors (node_id, embedding) with the largest cosine for each of ``asked`` (query_id, variant_no, embedding).

    A tiled product: queries and rows are dealt into blocks by hashes, each pair of blocks is a tile that one task
    multiplies, and a tile hands on k rows for each of its queries, which are merged by rank. Neither side passes through
    the driver and no task holds more than a block of each. Vectors are read once; a row is sent once for each block of
    queries. Zero vectors have cosine 0 with everything.
    """
    queries, rows = (max(1, -(-side.count() // block)) for side, block in ((asked, query_block), (vectors, row_block)))

    def dealt(side: DataFrame, own: str, ids: list[str], blocks: int, other: str, others: int) -> DataFrame:
        number = F.pmod(F.xxhash64(*ids), F.lit(blocks)).cast("int")
        return side.select(*ids, "embedding", number.alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    left = dealt(asked, "query_block", ["query_id", "variant_no"], queries, "row_block", rows)
    right = dealt(vectors, "row_block", ["node_id"], rows, "query_block", queries)
    tile = ["query_block", "row_block"]
    return top(left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(_tile(k), HIT), k)


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of a list column at length 1, in double precision."""
    data = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    size = np.sqrt((data * data).sum(axis=1))
    return data / np.where(size == 0, 1, size)[:, None]


def _tile(k: int):
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64())

    def search(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and rows.num_rows:
            names = rows.column("node_id").to_pylist()
            got = np.round(_unit(asked.column("embedding")) @ _unit(rows.column("embedding")).T, 9) + 0.0
            at = max(0, len(names) - k)
            cut = np.partition(got, at, axis=1)[:, at]
            for q, v, own, least in zip(asked.column("query_id").to_pylist(), asked.column("variant_no").to_pylist(), got, cut):
                # All that tie with the k-th stand for the choice by node_id.
                best = sorted((-float(own[i]), names[i]) for i in np.flatnonzero(own >= least))[:k]
                out += [(q, v, name, -s) for s, name in best]
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["query_id", "variant_no", "node_id", "score"])

    return search


@dataclass
class Postings:
    """The keyword index: postings(term, node_id, tf, dl), frequencies(term, df) and totals(n_docs, avgdl)."""

    postings: DataFrame
    frequencies: DataFrame
    totals: DataFrame


def build_postings(chunks: DataFrame) -> Postings:
    """From ``chunks`` (node_id, text). Write the tables (sources.index does) before they are searched often."""
    words = chunks.select("node_id", terms(F.col("text")).alias("terms"))
    words = words.select("node_id", F.size("terms").alias("dl"), "terms")
    # The texts are dealt by node, so that their many postings are counted where they are made and aren't shuffled.
    dealt = chunks.select("node_id", "text").repartition("node_id").select("node_id", terms(F.col("text")).alias("terms"))
    # The outer explode keeps Spark from cutting every text into terms a second time, to drop those without any before they are dealt.
    dealt = dealt.select("node_id", F.size("terms").alias("dl"), F.explode_outer("terms").alias("term")).filter("term IS NOT NULL")
    postings = dealt.groupBy("term", "node_id", "dl").agg(F.count("*").alias("tf"))
    frequencies = term_frequencies(postings)
    totals = words.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    return Postings(postings, frequencies, totals)


def term_frequencies(postings: DataFrame) -> DataFrame:
    """(term, df). Counted over ``tf``, so that a plan which also reads the postings can share their shuffle."""
    return postings.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))


@dataclass
class Blocks:
    """The keyword index in blocks, for searches that skip most of them.

    blocks(segment, term, level, bucket, n, max_tf, min_dl, postings): a term's postings are dealt into 2^level blocks of
    about ``BLOCK`` by the first bits of the node's hash, so a frequent term is no single row's or task's. frequencies and
    totals are those of ``Postings``. dead (segment, node_id): postings that no longer count.
    """

    blocks: DataFrame
    frequencies: DataFrame
    totals: DataFrame
    dead: DataFrame | None = None

    def alive(self, rows: DataFrame) -> DataFrame:
        return rows if self.dead is None else rows.join(self.dead, ["segment", "node_id"], "left_anti")

    def flat(self) -> Postings:
        rows = self.blocks.select("segment", "term", F.explode("postings").alias("p")).select("segment", "term", "p.*")
        return Postings(self.alive(rows).select("term", "node_id", "dl", "tf"), self.frequencies, self.totals)


def bucket_of(node: Column, level: Column) -> Column:
    """The first ``level`` bits of the node's hash."""
    return F.when(level == 0, F.lit(0)).otherwise(F.call_function("shiftrightunsigned", F.xxhash64(node), F.lit(64) - level).cast("int"))


def in_blocks(postings: DataFrame, frequencies: DataFrame, size: int = BLOCK, segment: int = 0, settle: Callable[[DataFrame, str], DataFrame] = lazily) -> DataFrame:
    """``postings`` (term, node_id, dl, tf) as blocks. Give written tables: hot terms are then split by AQE before they are dealt into their blocks."""
    level = F.greatest(F.lit(0), F.least(F.lit(30), F.ceil(F.log2(F.col("df") / F.lit(float(size)))))).cast("int")
    # Most terms are in one block: only the others are looked up.
    levels = frequencies.select("term", level.alias("level")).filter("level > 0")
    levels = settle(levels, "levels")
    dealt = postings.join(levels, "term", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    dealt = dealt.withColumn("bucket", bucket_of(F.col("node_id"), F.col("level")))
    one = F.struct("node_id", F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl"))
    made = dealt.groupBy("term", "level", "bucket").agg(F.count("*").alias("n"), F.max("tf").cast("int").alias("max_tf"), F.min("dl").cast("int").alias("min_dl"), F.collect_list(one).alias("postings"))
    return made.select(F.lit(segment).alias("segment"), "*")


def _weight(tf: Column, dl: Column, k1: float, b: float) -> Column:
    """A term's part of a score; it grows with tf and falls with dl, so a block's largest tf and least dl bound it."""
    tf, dl = tf.cast("double"), dl.cast("double")
    return F.col("idf") * tf / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))


def bm25_plan(index: Blocks, asked: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, settle: Callable[[DataFrame, str], DataFrame] = lazily) -> tuple[DataFrame, DataFrame]:
    """Which blocks a search has to read: (terms, blocks).

    A first few blocks, those with the largest bounds, give k partial scores and so a threshold that the k-th score
    reaches at least. Terms whose bounds together stay below it can't bring a node in by themselves: they aren't essential,
    and are only looked up for nodes found by others. A block of an essential term is read only if its bound and the other
    terms' bounds reach the threshold.
    """
    who = ["query_id", "variant_no"]
    wanted = settle(_wanted(index, asked), "wanted")
    bounded = wanted.join(index.blocks.select("segment", "term", "level", "bucket", "n", "max_tf", "min_dl"), "term").withColumn("bound", _weight(F.col("max_tf"), F.col("min_dl"), k1, b))
    first = bounded.withColumn("at", F.row_number().over(Window.partitionBy(*who).orderBy(F.col("bound").desc(), "term", "segment", "bucket"))).filter(F.col("at") <= FIRST_BLOCKS)
    first = settle(first, "first-blocks")
    seen = first.join(index.blocks.select("segment", "term", "bucket", "postings"), ["segment", "term", "bucket"])
    seen = index.alive(seen.select(*who, "segment", "idf", "avgdl", F.explode("postings").alias("p")).select(*who, "segment", "idf", "avgdl", "p.*"))
    partial = seen.groupBy(*who, "node_id").agg(F.sum(_weight(F.col("tf"), F.col("dl"), k1, b)).alias("score"))
    kth = F.row_number().over(Window.partitionBy(*who).orderBy(F.col("score").desc()))
    least = partial.withColumn("at", kth).filter(F.col("at") <= k).filter(F.col("at") == k).select(*who, F.col("score").alias("least"))
    limits = bounded.groupBy(*who, "term", "idf", "avgdl").agg(F.max("bound").alias("limit"))
    limits = limits.join(least, who, "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - SLACK)
    own = Window.partitionBy(*who)  # the terms of one query
    limits = limits.withColumn("below", F.sum("limit").over(own.orderBy("limit", "term"))).withColumn("all", F.sum("limit").over(own))
    terms_ = limits.withColumn("essential", F.col("below") >= F.col("least"))
    each = bounded.drop("idf", "avgdl").join(terms_, [*who, "term"])
    return terms_, each.withColumn("read", F.col("essential") & (F.col("bound") + F.col("all") - F.col("limit") >= F.col("least")))


def _terms_of(asked: DataFrame) -> DataFrame:
    return asked.select("query_id", "variant_no", F.explode(F.array_distinct(terms(F.col("variant")))).alias("term"))


def _wanted(index: Postings | Blocks, asked: DataFrame) -> DataFrame:
    return _terms_of(asked).join(bm25_stats(index), "term")


def bm25_pruned(index: Blocks, asked: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, settle: Callable[[DataFrame, str], DataFrame] = lazily) -> DataFrame:
    """The rows of ``bm25``, from the blocks that ``bm25_plan`` leaves.

    A block is read once, however many queries want it, and tiles keep the nodes that may still be among the best. Terms
    that aren't essential are then looked up where these nodes' postings lie: a second product has whole scores for them,
    and for others at most their scores.
    """
    who, where = ["query_id", "variant_no"], ["segment", "term", "bucket"]
    terms_, planned = bm25_plan(index, asked, k, k1, b, settle)
    terms_, wanted = settle(terms_, "limits"), settle(planned.filter("read").select(*where).distinct(), "read")

    def postings(keys: DataFrame) -> DataFrame:
        read = index.blocks.join(keys, where, "left_semi")
        return index.alive(read.select("segment", "term", F.explode("postings").alias("p")).select("segment", "term", "p.*"))

    sizes = (asked.count(), _n_docs(index))
    # What a node must have by essential terms alone: the others' bounds together are the largest ``below`` among them.
    rest = F.coalesce(F.max(F.when(~F.col("essential"), F.col("below"))), F.lit(0.0))
    essential = terms_.groupBy(*who).agg(F.collect_list(F.when(F.col("essential"), F.struct("term", "idf"))).alias("terms"), F.first("avgdl").alias("avgdl"), rest.alias("rest"), F.first("least").alias("least"))
    found = settle(_tiles(essential, postings(wanted), sizes, k, k1, b, True), "found")
    low = top(found, k).groupBy(*who).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0.0).alias("low"))
    found = found.join(settle(low.join(essential.select(*who, "rest"), who), "lowest"), who).filter(F.col("score") + F.col("rest") >= F.col("low") - SLACK)
    levels = index.blocks.select("segment", "term", "level").distinct()
    others = terms_.filter("NOT essential").select(*who, "term").join(levels, "term")
    sought = found.select(*who, "node_id").join(others, who).select("segment", "term", bucket_of(F.col("node_id"), F.col("level")).alias("bucket"))
    needed = settle(sought.unionByName(wanted).distinct(), "needed")
    every = terms_.groupBy(*who).agg(F.collect_list(F.struct("term", "idf")).alias("terms"), F.first("avgdl").alias("avgdl"))
    every = every.select("*", F.lit(0.0).alias("rest"), F.lit(0.0).alias("least"))
    return top(_tiles(every, postings(needed), sizes, k, k1, b), k)


def _n_docs(index: Postings | Blocks) -> int:
    row = index.totals.select("n_docs").first()
    return row.n_docs if row else 0


def _tiles(asked: DataFrame, postings: DataFrame, sizes: tuple[int, int], k: int, k1: float, b: float, partial: bool = False) -> DataFrame:
    """(query_id, variant_no, node_id, score): a tile's k best nodes for each of its queries, rounded.

    ``asked`` is (query_id, variant_no, terms: term and idf, avgdl, rest, least), ``postings`` (term, node_id, tf, dl). A node's
    postings are one row, sent once for each block of queries; ``sizes`` are the numbers of queries and nodes, about. With ``partial`` scores lack up to ``rest``: then all
    nodes are kept, unrounded, that can reach both ``least`` and the k-th partial score of their tile.
    """
    queries, nodes = (max(1, -(-n // block)) for n, block in zip(sizes, (ASKED_BLOCK, NODE_BLOCK)))

    def dealt(side: DataFrame, own: str, ids: list[str], blocks: int, other: str, others: int) -> DataFrame:
        number = F.pmod(F.xxhash64(*ids), F.lit(blocks)).cast("int")
        return side.withColumn(own, number).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    each = F.col("terms")
    left = asked.select("query_id", "variant_no", each["term"].alias("terms"), each["idf"].alias("idfs"), "avgdl", "rest", "least")
    left = dealt(left, "query_block", ["query_id", "variant_no"], queries, "node_block", nodes)
    listed = F.collect_list(F.struct("term", F.col("tf").cast("double").alias("tf"), F.col("dl").cast("double").alias("dl")))
    right = postings.groupBy("node_id").agg(listed.alias("p"))
    right = right.select("node_id", F.col("p")["term"].alias("terms"), F.col("p")["tf"].alias("tfs"), F.col("p")["dl"].alias("dls"))
    right = dealt(right, "node_block", ["node_id"], nodes, "query_block", queries)
    tile = ["query_block", "node_block"]
    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(_term_tile(k, k1, b, partial), HIT)


def _term_tile(k: int, k1: float, b: float, partial: bool):
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64())

    def flat(table: pa.Table, column: str) -> tuple[np.ndarray, pa.Array]:
        """The row of each element of a list column, and the elements."""
        lists = table.column(column).combine_chunks()
        return pc.list_parent_indices(lists).to_numpy(), lists.flatten()

    def search(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and rows.num_rows:
            at, words = flat(asked, "terms")
            idf, known = flat(asked, "idfs")[1].to_numpy(), words.unique()
            term = pc.index_in(words, known).to_numpy()
            by_term = np.argsort(term, kind="stable")
            wanted = np.split(by_term, np.cumsum(np.bincount(term, minlength=len(known)))[:-1]) if len(known) else []
            doc, words = flat(rows, "terms")
            tf, dl = (flat(rows, c)[1].to_numpy() for c in ("tfs", "dls"))
            own = pc.fill_null(pc.index_in(words, known), -1).to_numpy()
            used = np.flatnonzero(own >= 0)
            weight = tf[used] / (tf[used] + k1 * (1 - b + b * dl[used] / asked.column("avgdl")[0].as_py()))
            # A node that several rows name has a term more than once: such weights are added up first.
            key = own[used].astype(np.int64) * rows.num_rows + doc[used]
            order = np.argsort(key, kind="stable")
            key, weight = key[order], weight[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            key, weight = key[first], np.add.reduceat(weight, first) if len(first) else weight
            own, doc = key // rows.num_rows, key % rows.num_rows
            ends = np.searchsorted(own, np.arange(len(known) + 1))
            got = np.zeros((asked.num_rows, rows.num_rows))
            for t, who in enumerate(wanted):
                a, z = ends[t], ends[t + 1]
                if a < z:
                    got[at[who][:, None], doc[a:z]] += idf[who][:, None] * weight[a:z]
            held = got > 0  # also where it rounds to 0
            if not partial:
                got = np.round(got, 9)
            names = rows.column("node_id").to_pylist()
            cut = max(0, len(names) - k)
            least = np.partition(got, cut, axis=1)[:, cut]
            if partial:
                rest = asked.column("rest").to_numpy()
                least = np.maximum(least, asked.column("least").to_numpy()) - rest - SLACK
            for q, v, scores, held_, low in zip(asked.column("query_id").to_pylist(), asked.column("variant_no").to_pylist(), got, held, least):
                best = [(-float(scores[i]), names[i]) for i in np.flatnonzero((scores >= low) & held_)]
                # All that tie with the k-th stand for the choice by node_id.
                out += [(q, v, name, -s) for s, name in (best if partial else sorted(best)[:k])]
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["query_id", "variant_no", "node_id", "score"])

    return search


def bm25_stats(index: Postings | Blocks) -> DataFrame:
    """(term, df, n_docs, avgdl, idf)"""
    n = F.col("n_docs").cast("double")
    idf = F.ln(F.lit(1.0) + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return index.frequencies.join(F.broadcast(index.totals)).withColumn("idf", idf)  # one row


def bm25(index: Postings | Blocks, asked: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, settle: Callable[[DataFrame, str], DataFrame] = lazily) -> DataFrame:
    """The k best nodes for each of ``asked`` (query_id, variant_no, variant), by distinct query terms.

    A tiled product like ``knn``: of the postings only those of asked terms are dealt, once for each block of queries, and
    hits of a query and a node meet in a tile, not in a shuffle.
    """
    if isinstance(index, Blocks):
        return bm25_pruned(index, asked, k, k1, b, settle)
    # The semi join is pushed below the counting, so that only asked terms are counted.
    own = settle(_terms_of(asked).select("term").distinct(), "terms")
    postings = settle(index.postings.join(own, "term", "left_semi"), "asked-postings")
    wanted = settle(_wanted(replace(index, frequencies=term_frequencies(postings)), asked), "wanted")
    queries = wanted.groupBy("query_id", "variant_no").agg(F.collect_list(F.struct("term", "idf")).alias("terms"), F.first("avgdl").alias("avgdl"))
    queries = queries.select("*", F.lit(0.0).alias("rest"), F.lit(0.0).alias("least"))
    return top(_tiles(queries, postings, (asked.count(), _n_docs(index)), k, k1, b), k)
