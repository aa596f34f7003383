"""Mix sources to target weights by systematic sampling.

Every source gets a target, in words; a document's expected copies are target / source size. Within a source the
documents are ranked by size, expected copies are prefix-summed along the ranks, one random offset for the source is
added, and a document is emitted once for each integer boundary that its step crosses. As the order is by size, the
words taken stray from the target by about one large document, whatever the distribution.

Ranks come without a single-task sort of a source: documents are counted by (source, size, salt), the counts are
prefix-summed (tables of at most distinct sizes x salts rows), and only rows of one (source, size, salt) are ordered
together.

Defined cases: null or empty text has size 0 (it takes part in the ranking, its copies add no words); a null source is
a source of its own, ordered last; sources without words have target 0 and take nothing; repeated rows are documents
of their own; an empty table gives an empty table; other columns pass through, clashing names included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinery.llm._common import materialise, spare, uniform

WORD = r"[^\x20\x09-\x0D]+"
#: Sources are names in a mixing recipe; beyond this many the recipe is taken for a mistake and refused.
MAX_SOURCES = 1_000_000


def word_count(col):
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def shared_targets(sizes: list[float], weights: list[float], share: float, cap: float) -> list[float]:
    """Split ``share`` of all sizes by weight; what goes beyond ``cap`` times a size is reshared among the others."""
    total, limits = share * sum(sizes), [cap * x for x in sizes]
    out = [0.0] * len(sizes)
    free = list(range(len(sizes)))
    left = total
    while free:
        weight = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / weight >= limits[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = limits[i]
        left -= sum(limits[i] for i in full)
        full_set = set(full)
        free = [i for i in free if i not in full_set]
    return out


def targets(sized: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target), one row for each source; ``sized`` has source and size."""
    spark = sized.sparkSession
    rows = sized.groupBy("source").agg(F.sum("size").alias("s")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))  # Python orders strings by code point
    got = shared_targets([float(r.s) for r in rows], [weights[i % len(weights)] for i in range(len(rows))], share, cap)
    return spark.createDataFrame([(r.source, int(r.s), t) for r, t in zip(rows, got)], "source string, source_size long, target double")


def mix(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 17, salts: int = 64) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target and copies, the times the mix takes the row.

    A row's copies times its size are the words it gives. Runs with the same seed agree.
    """
    plain = list(docs.columns)
    size, source_size, target, copies = (spare(plain, x) for x in ("size", "source_size", "target", "copies"))
    own, salt, tie, row = (spare(plain, x) for x in ("_own", "_salt", "_tie", "_row"))
    # A key that is never null, in the order of the sources but for null, so that joins and windows share one shuffle.
    sized = docs.withColumns({own: F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), size: word_count(F.col("text")), tie: F.xxhash64("doc_id", "text")})
    sized = sized.withColumn(salt, F.pmod(F.col(tie), F.lit(salts)))
    # The counts are narrow and are read several times below; the texts are not.
    counts = sized.groupBy(own, size, salt).agg(F.count("*").alias("n")).toDF("own", "in_size", "salt", "n")
    counts = materialise(counts, "mix-counts")
    by_source = counts.select(F.when(F.col("own") != "", F.substring("own", 2, 2**31 - 1)).alias("source"), (F.col("in_size") * F.col("n")).alias("size"))
    goal = targets(by_source, weights, share, cap).select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("own"), "source_size", "target")
    before = Window.partitionBy("own").orderBy("in_size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = counts.groupBy("own", "in_size").agg(F.sum("n").alias("m")).select("own", "in_size", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("own", "in_size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(by_size, ["own", "in_size"]).join(goal, "own")
    offsets = offsets.select(
        F.col("own").alias(own), F.col("in_size").alias(size), F.col("salt").alias(salt), (F.col("before") + F.col("within")).alias("_offset"),
        F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
    )
    offsets = offsets.toDF(own, size, salt, *(spare(plain, x) for x in ("_offset", "_source_size", "_target")))
    offset, full, share_of = (F.col(c) for c in offsets.columns[3:])
    ranked = sized.withColumn(row, F.row_number().over(Window.partitionBy(own, size, salt).orderBy(tie, "doc_id"))).join(offsets, [own, size, salt])
    step = F.when(full > 0, share_of / full).otherwise(F.lit(0.0))
    start, at = uniform(seed, F.col(own)), (offset + F.col(row)).cast("double")
    crossed = (F.floor(start + step * at) - F.floor(start + step * (at - 1))).cast("int")
    return ranked.select(*[F.col(f"`{c}`") for c in plain], F.col(size), full.alias(source_size), share_of.alias(target), crossed.alias(copies))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as the mix takes it."""
    plain = list(docs.columns)
    got = mix(docs, **options)
    copies = got.columns[-1]
    return got.filter(F.col(copies) > 0).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in plain])
