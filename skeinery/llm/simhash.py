"""SimHash near-dedup over a byte-position inverted index with count filtering.

Fingerprints are reduced to distinct values first, so exact copies are one entry. Two fingerprints of 8 bytes that
differ in at most 2 bits differ in at most 2 bytes, so they share at least 6 positional bytes. The index is refined in two
steps, each of which drops lists of one: a fingerprint is filed under each pair of the 4 blocks of two bytes (6 lists of 4
equal bytes), and within a list under each two of the other positions (28 lists of 6 equal bytes in all). Fingerprints in a
list of 6 have shared the guaranteed number with another one; such a list isn't paired out, however long it is, but each
of its members is filed once more under itself and under itself with one bit changed in the positions that it may differ
in. Members meet at such a point if and only if they differ in at most 2 bits, and at most 65 can meet at one. Pairs that
met have their shared positional bytes tallied, those with at least 6 are retained and verified by their differing bits.
Rows at each step grow with the fingerprints (at most 6, 28 and 65 for each), and lists of every length go this one way.

Defined cases: null, empty or blank texts have fingerprint 0 and are linked like any other; fewer words than a
shingle: the whole sequence is the shingle; a text of any length is hashed in blocks; repeated rows share a fingerprint
and a component; a null doc_id is ignored when the smallest is taken (a component of null ids alone has a null id); an
empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinery.llm._common import bounded_batches, materialise, scratch_scope, spare
from skeinery.llm.graph import connected_components

SEED = 42
#: Rows whose bits are counted at once: what a counter of one byte holds.
BLOCK = 255
#: Bits that linked fingerprints may differ in, hence bytes at most.
BITS = 2
BLOCKS = ((0, 1), (2, 3), (4, 5), (6, 7))


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 of the word shingles, repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and [\x20\x09-\x0D] alone
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    n = len(parts) - words + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    pieces = map(joined.__getitem__, map(slice, starts, ends[words - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, n)


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many of at most ``BLOCK`` rows of bytes have each bit set: eight counters of a byte are added at once as a long."""
    return np.unpackbits(rows, axis=1, bitorder="little").view(np.uint64).sum(axis=0).view(np.uint8)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned fingerprint: a bit is 1 if it is set in over half of the hashes."""
    return majority(shingle_hashes(text, words))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes; 0 of none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += bit_counts(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, column: str = "fp") -> DataFrame:
    """``docs`` (text, ...) with the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        got = np.array([fingerprint(t.as_py(), words) for t in texts], np.uint64)
        return pa.array(got.view(np.int64))

    return docs.withColumn(column, fp(F.col("text")))


def _mask(positions) -> F.Column:
    mask = sum(0xFF << (8 * i) for i in positions)
    return F.lit(mask - ((mask >> 63) << 64))


def _free_positions() -> list[list[int]]:
    """For each pair of blocks the two positions (as bits) that its lists of 6 leave free; what several pairs could give is with the first."""
    pairs, free = list(combinations(BLOCKS, 2)), []
    for pair in pairs:
        other = [i for b in BLOCKS if b not in pair for i in b]
        first = {b: next(p for p in pairs if b not in p) for b in BLOCKS}
        free.append([1 << i | 1 << j for i, j in combinations(other, 2) if first.get((i, j), pair) == pair])
    return free


def _shared(lists: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """The rows of ``lists`` whose list (``keys``) holds more than one fingerprint."""
    filed = materialise(lists, tag)
    several = materialise(filed.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), f"{tag}-lists")
    return filed.join(several, keys)


def links(distinct: DataFrame) -> DataFrame:
    """(u, v) between the distinct fingerprints of ``distinct`` (fp) that differ in at most 2 bits, enough to connect all that do."""
    fp, u, v = F.col("fp"), F.col("u"), F.col("v")
    fours = [F.struct(F.lit(k).alias("k"), fp.bitwiseAND(_mask((*p, *q))).alias("bytes")) for k, (p, q) in enumerate(combinations(BLOCKS, 2))]
    filed = _shared(distinct.select("fp", F.explode(F.array(*fours)).alias("key")).select("fp", "key.k", "key.bytes"), ["k", "bytes"], "four-bytes")
    sixes = [[F.struct(F.lit(f).alias("free"), fp.bitwiseAND(_mask(i for i in range(8) if not f >> i & 1)).alias("bytes")) for f in free] for free in _free_positions()]
    at_k = F.coalesce(*[F.when(F.col("k") == k, F.array(*six)) for k, six in enumerate(sixes)])
    filed = _shared(filed.select("fp", F.explode(at_k).alias("key")).select("fp", "key.free", "key.bytes"), ["free", "bytes"], "six-bytes")
    open_ = filed.groupBy("fp").agg(F.bit_or("free").alias("free"))
    flips = "transform(filter(sequence(0, 63), i -> getbit(free, i div 8) = 1), i -> fp ^ shiftleft(1L, i))"
    points = open_.select("fp", F.explode(F.concat(F.array(fp), F.expr(flips))).alias("point"))
    met = points.groupBy("point").agg(F.collect_list("fp").alias("at")).filter(F.size("at") > 1)  # 65 at most
    pairs = met.select(F.array_min("at").alias("u"), F.explode("at").alias("v")).filter("u != v").distinct()
    apart = u.bitwiseXOR(v)
    tally = sum(((apart.bitwiseAND(_mask((i,))) == 0).cast("int") for i in range(8)), F.lit(0))
    return pairs.filter((tally >= 8 - BITS) & (F.bit_count(apart) <= BITS))


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, text_hash, fp (signed long), root (the component's smallest fingerprint) and component_id, its smallest doc_id."""
    prints = fingerprints(docs.select("doc_id", "text"), words).select("doc_id", F.xxhash64("text").alias("text_hash"), "fp")
    prints = materialise(prints, "prints")
    with scratch_scope(docs.sparkSession):
        distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-prints")
        members = with_components(distinct, links(distinct.select("fp")), "fp")
    # Both sides are written tables, so AQE splits a fingerprint that a third of the rows share.
    return prints.join(members, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def with_components(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """A written table of ``node``, root and component_id (the least ``first``) for each row of ``nodes`` (node, first, ...)."""
    roots = connected_components(edges).withColumnRenamed("node", node)
    rooted = materialise(nodes.select(node, "first").join(roots, node, "left").withColumn("root", F.coalesce("root", node)), "rooted")
    smallest = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    return materialise(rooted.join(smallest, "root").select(node, "root", "component_id"), "members", keep=True)


def hex_fingerprint(col):
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def representatives(docs: DataFrame, find=near_duplicates, **options) -> DataFrame:
    """One row of ``docs`` for each component that ``find`` gives: its smallest doc_id (of rows that repeat that, the first by a hash of the text)."""
    plain = list(docs.columns)
    own, none, own_hash, at = (spare(plain, x) for x in ("_own", "_none", "_text_hash", "_at"))
    keys = [own, none, own_hash]
    first = find(docs, **options).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = first.groupBy("root", "doc_id").agg(F.min("text_hash").alias(own_hash))
    # The join and the window have the same keys, none of them null, so that whole texts are dealt once.
    id_, null = F.coalesce("doc_id", F.lit(0)).alias(own), F.isnull("doc_id").alias(none)
    rows = docs.select("*", id_, null, F.xxhash64("text").alias(own_hash)).join(kept.select(id_, null, own_hash).distinct(), keys, "left_semi")
    order = Window.partitionBy(*keys).orderBy("doc_id")
    return rows.withColumn(at, F.row_number().over(order)).filter(F.col(at) == 1).select(*[F.col(f"`{c}`") for c in plain])
