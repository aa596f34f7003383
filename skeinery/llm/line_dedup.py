"""Line dedup over levelled sorted runs of line hashes.

A run is a table of line hashes, bucketed by hash and sorted: (h1, h2, n, keeper) with the number of documents that hold
the line and the largest of their ids, as the batch that saw it first had them. A new batch is reduced to one row a line
and merge-anti-joined with every run: the lines that none of them has are a run of level 0, so a line is in exactly one
run. The others' numbers go to tables of additions, which only ``totals`` reads, beside the runs. Two runs of one level
are compacted into one of the next by a merge join, additions likewise. Runs, batches and additions have the same buckets in the same order, so
no join above them shuffles or sorts. Nothing is collected, no line's documents ever meet in one task: counts are
pre-aggregated, and the join of lines with repeated keys is between two written tables, so AQE splits a hot key.

Defined cases: null text is one empty line; short keys are never dropped; equal lines within one document count once
and go or stay together; a null doc_id is one document, ordered below all others; rows that repeat a doc_id are one
document for counting, each is edited by itself; texts and lines of any length are taken whole; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinery.llm._common import NULL_ID, Buckets, ascii_lower, in_scope, in_written_order, materialise, scratch_path, scratch_scope, spare

BLANKS = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
RUN = "h1 long, h2 long, n long, keeper long"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, text_hash, pos, h1, h2): the lines whose keys have at least ``min_chars`` code points, by a hash of 128 bits."""
    lines = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"),
        F.xxhash64("text").alias("text_hash"),
        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"),
    )
    # Stripping only shortens a line, so short ones go before any key is made.
    lines = lines.filter(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line")))
    return lines.filter(F.length("key") >= min_chars).select("doc", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


class LineRuns:
    """The levelled runs. Batches can be added at any time; a document's lines belong in one batch. ``close`` deletes all."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark, self.tables = spark, Buckets(spark, buckets)
        self.levels: list[list[str]] = []
        self.additions: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        return self.tables.save(rows.select(*KEY, "n", "keeper"), KEY)

    def read(self) -> DataFrame:
        """All rows of all runs: a row for each line seen."""
        return reduce(DataFrame.unionByName, map(self.spark.table, sum(self.levels, [])), self.spark.createDataFrame([], RUN))

    def _place(self, levels: list[list[str]], name: str, level: int = 0) -> None:
        """Put a table into a level; the level's second one is merged with its first into one of the next level."""
        while len(levels) <= level:
            levels.append([])
        levels[level].append(name)
        if len(levels[level]) > 1:
            old, levels[level] = levels[level], []
            a, b = (self.spark.table(x) for x in old)
            both = a.hint("merge").join(b.select(*KEY, F.col("n").alias("m"), F.col("keeper").alias("other")), KEY, "full")
            both = both.select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), F.greatest("keeper", "other").alias("keeper"))
            self._place(levels, self._write(both), level + 1)
            for x in old:
                self.tables.drop(x)

    def add(self, lines: DataFrame) -> None:
        """Add a batch of hashed lines."""
        batch = lines.groupBy(*KEY).agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keeper")).repartition(self.tables.n, *KEY)
        batch = self._write(batch)
        fresh = self.spark.table(batch)
        for run in (name for level in self.levels for name in level):
            fresh = fresh.join(self.spark.table(run).select(*KEY).hint("merge"), KEY, "left_anti")
        if not any(self.levels):
            self._place(self.levels, batch)
            return
        fresh = self._write(fresh)
        again = self.spark.table(batch).join(self.spark.table(fresh).select(*KEY).hint("merge"), KEY, "left_anti")
        self._place(self.additions, self._write(again))
        self.tables.drop(batch)
        self._place(self.levels, fresh)

    def totals(self) -> DataFrame:
        """(h1, h2, n, keeper) over all batches: what the runs have, and what was added to it since."""
        parts = []
        for run in sum(self.levels, []):
            part = self.spark.table(run)
            for name in sum(self.additions, []):
                more = self.spark.table(name).select(*KEY, F.col("n").alias("more"), F.col("keeper").alias("later"))
                part = part.join(more.hint("merge"), KEY, "left")
                part = part.select(*KEY, (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("keeper", "later").alias("keeper"))
            parts.append(part)
        return reduce(DataFrame.unionByName, parts) if parts else self.read()

    def close(self) -> None:
        self.tables.close()
        self.levels, self.additions = [], []


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4) -> DataFrame:
    """``docs`` (doc_id, text, ...) with kept_text, n_lines and n_dropped.

    Keys of at least ``min_chars`` in at least ``min_docs`` documents stay in the largest doc_id alone. kept_text is null
    where text is null.
    """
    spark, plain = docs.sparkSession, list(docs.columns)
    kept, n_lines, n_dropped, own, own_hash, gone, lines = (spare(plain, x) for x in ("kept_text", "n_lines", "n_dropped", "_doc", "_text_hash", "_gone", "_lines"))
    with scratch_scope(spark):
        batch = F.pmod(F.xxhash64(F.lit("batch"), "doc"), F.lit(batches)).cast("int")
        in_scope(path := scratch_path(spark, "line-hashes"))
        hashed_lines(docs, min_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
        hashed = spark.read.schema("doc long, text_hash long, pos int, h1 long, h2 long, batch int").parquet(path)
        runs = LineRuns(spark)
        try:
            for b in range(batches):
                runs.add(hashed.filter(F.col("batch") == b))
            with in_written_order(spark):
                repeated = materialise(runs.totals().filter(F.col("n") >= min_docs).select(*KEY, F.col("keeper").alias("stays")), "line-repeated")
        finally:
            runs.close()
        dropped = (
            hashed.join(repeated, KEY)
            .filter(F.col("doc") != F.col("stays"))
            .groupBy(F.col("doc").alias(own), F.col("text_hash").alias(own_hash))
            .agg(F.collect_set("pos").alias(gone))
        )
        dropped = materialise(dropped, "line-dropped", keep=True)
    keyed = docs.withColumns({own: F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), own_hash: F.xxhash64("text")})
    # The lines are a column of their own that is used twice, so they are split once, after the texts have moved.
    joined = keyed.join(dropped, [own, own_hash], "left").withColumn(lines, F.split(F.coalesce("text", F.lit("")), "\n", -1))
    # array_except is linear, and taking a line of a stored array by its number costs nothing.
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(F.col(lines), i))
    return joined.select(
        *[F.col(f"`{c}`") for c in plain],
        F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias(kept),
        F.size(lines).cast("long").alias(n_lines),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_dropped),
    )
