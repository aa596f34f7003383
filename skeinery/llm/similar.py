"""SimHash near-dedup with verification, exact at a Jaccard similarity of 0.8.

Texts meet through their fingerprints first: ``simhash.links`` files these by byte position, tallies the positions that two share
and keeps those in few bits; the texts behind them are verified by their shingles. Fingerprints alone can't stand in for a
similarity: two texts at 0.8 may differ in any number of bits. So the links that no distance guarantees come from a second
inverted index with count filtering, which holds
the shingles' hashes themselves, and of each text only so many of the first that a guaranteed number must be
shared. Shingles that a sample of the texts shows to be frequent come last in every text, the others by their hashes; the
sample only orders them, so whatever it misses costs no link, but lists stay short as tables grow.
At a similarity of t, two sets share at least t of the larger, and 2t / (1 + t) of the smaller, so of the larger one
the first n - tn and of the smaller one the first n - 2tn / (1 + t), plus two, hold the first two shared ones. Postings that
a pair shares are tallied, pairs with the guaranteed two (of small sets: one) are retained and verified.

A list of over ``most`` texts (a passage or a template that many share) emits no pairs. The texts of such lists are filed
again, now with the shingles that over ``most`` of them have at the end, rarest first: what many share isn't indexed, unless
it is nearly all of a text. Where the others come among themselves doesn't matter, as their lists are short. Lists that are long even so are of texts that are nearly the same. Such a list's texts are
verified against a few leaders, which mostly connects it; those that stay outside its largest component are compared
with the texts of other components in it. No link is lost.

Texts with the same words in the same order are one node.

Defined cases: null, empty or blank texts are one node; fewer words than a shingle: the whole sequence is the shingle; a
null doc_id is ignored when the smallest is taken; a text of any length is taken; an empty table gives an empty table;
other columns don't matter.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.llm import simhash
from skeinery.llm._common import NULL_ID, bounded_batches, materialise, scratch_scope
from skeinery.llm.graph import connected_components

SEED = 42
#: Texts in a list whose pairs are all tallied.
MOST = 16
#: Texts of a list that is long even when filed by rarity, against which all others in it are verified first.
LEADERS = 3
#: Shared postings that are guaranteed for sets of at least ``MANY``; smaller ones share one.
SHARED, MANY = 2, 10
#: Shingles that two texts of a sample of one in so many share count as frequent; a table of so many bits (a power of two) marks them.
SAMPLED, MARKS = 8, 1 << 26
#: Rows of a table below which no sample is taken: its lists are refined at little cost.
FEWEST = 2_000
#: Parts of the shingles of long lists that are counted one after the other, so that one part's shuffle is on the disk at a time.
PASSES = 6


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    return np.unique(simhash.shingle_hashes(text, words))


def _node(text: str | None) -> int:
    """Stands for the sequence of words."""
    return xxhash.xxh64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()), SEED)


def _mark(hashes: np.ndarray, marks: int) -> np.ndarray:
    return (hashes & np.uint64(marks - 1)).astype(np.int64)


def marked_last(hashes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """``hashes`` with those that have a mark after the others, each part in its order."""
    at = _mark(hashes, 8 * len(marks))
    last = (marks[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return np.concatenate([hashes[~last], hashes[last]])


def indexed(n: int, similarity: float) -> tuple[int, int]:
    """How many first shingles of a set of ``n`` are indexed, and how many of these count where it is the smaller of two."""
    more = SHARED if n >= MANY else 1
    least, of_smaller = (math.ceil(x * n - 1e-9) for x in (similarity, 2 * similarity / (1 + similarity)))
    return min(n, n - least + more), min(n, n - of_smaller + more)


def frequent_marks(docs: DataFrame, words: int, sampled: int = SAMPLED, marks: int = MARKS) -> np.ndarray:
    """A bit for each value that a shingle's last bits can have, packed: 1 if shingles with it are in two of the sampled texts or more.

    It only says which shingles are indexed last, the same ones in every text, so neither a mark too many nor one too few loses a link.
    """
    out = np.zeros(marks // 8, np.uint8)
    if docs.count() < FEWEST:
        return out
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("array<bigint>")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(_mark(shingle_set(t, words), marks)) + 1 for t in texts.to_pylist()], pa.list_(pa.int64()))  # Spark's bitmaps begin at 1

    own = F.xxhash64("text")
    texts = docs.filter(F.pmod(own, F.lit(sampled)) == 0).groupBy(own.alias("_hash")).agg(F.first("text").alias("text"))  # equal texts count once
    shared = texts.select(F.explode(cut("text")).alias("mark")).groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1")
    parts = shared.groupBy(F.bitmap_bucket_number("mark").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("mark")).alias("bits"))
    for at, bits in materialise(parts, "marks").collect():  # at most MARKS bits, whatever the corpus
        lo = (at - 1) * len(bits)
        out[lo : lo + len(bits)] = np.frombuffer(bits, np.uint8)[: len(out) - lo]
    return out


def _signed(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """doc_id, text_hash, node, fp, size, first (the indexed shingles) and early (how many count in the smaller set) for each row."""
    bounded_batches(docs.sparkSession)
    marked = docs.sparkSession.sparkContext.broadcast(frequent_marks(docs, words))

    @F.arrow_udf("struct<node: bigint, fp: bigint, size: int, early: int, first: array<bigint>>")
    def sign(texts: pa.Array) -> pa.Array:
        texts = texts.to_pylist()
        nodes = np.array([_node(t) for t in texts], np.uint64).view(np.int64)
        hashes = [simhash.shingle_hashes(t, words) for t in texts]
        fps = np.array([simhash.majority(h) for h in hashes], np.uint64).view(np.int64)
        sets = [np.unique(h) for h in hashes]
        sizes = [indexed(len(s), similarity) for s in sets]
        first = [marked_last(s, marked.value)[:p].view(np.int64) for s, (p, _) in zip(sets, sizes)]
        columns = [pa.array(nodes), pa.array(fps), pa.array([len(s) for s in sets], pa.int32()), pa.array([e for _, e in sizes], pa.int32()), pa.array(first, pa.list_(pa.int64()))]
        return pa.StructArray.from_arrays(columns, ["node", "fp", "size", "early", "first"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), sign("text").alias("s")).select("doc_id", "text_hash", "s.*")


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """A written table (node, hot, n_first, n_early, shingles) of ``nodes`` (node, hot, n_first, n_early, at: doc_id and text_hash of a row)."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("array<bigint>")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t, words).view(np.int64) for t in texts.to_pylist()], pa.list_(pa.int64()))

    # Equal ids and hashes are equal texts, so a null id needs no key of its own; rows are dealt once, for the join and for what repeats.
    known = lambda c: F.coalesce(c, F.lit(NULL_ID))
    at = nodes.select("node", "hot", "n_first", "n_early", known("at.doc_id").alias("_id"), F.col("at.text_hash").alias("_hash"))
    rows = docs.select("text", known(F.col("doc_id").cast("long")).alias("_id"), F.xxhash64("text").alias("_hash")).join(at, ["_id", "_hash"])
    return materialise(rows.dropDuplicates(["_id", "_hash"]).select("node", "hot", "n_first", "n_early", cut("text").alias("shingles")), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs (u, v) at the similarity or above."""
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")) for x in ("u", "v"))
    both = pairs.join(b, "v").join(a, "u").withColumn("shared", F.size(F.array_intersect("of_u", "of_v")))
    whole = F.size("of_u") + F.size("of_v") - F.col("shared")
    return materialise(both.filter(F.col("shared") >= similarity * whole - 1e-9).select("u", "v"), "similar")


def _lists(postings: DataFrame) -> DataFrame:
    """A written table of ``postings`` (key, ...) with ``of``, the length of their list, where it is over one."""
    with scratch_scope(postings.sparkSession):
        counts = materialise(postings.groupBy("key").agg(F.count("*").alias("of")).filter("of > 1"), "list-sizes")
        return materialise(postings.join(counts, "key"), "lists", keep=True)


def _pairs(left: DataFrame, right: DataFrame, similarity: float) -> DataFrame:
    """Pairs of two sides of the same lists whose sizes allow the similarity and whose posting counts in the smaller set."""
    a, b = (side.select(*[F.col(c).alias(c if c == "key" else f"{c}_{x}") for c in side.columns]) for x, side in (("u", left), ("v", right)))
    counts = F.when(F.col("size_u") < F.col("size_v"), F.col("early_u")).when(F.col("size_u") > F.col("size_v"), F.col("early_v")).otherwise(F.col("early_u") | F.col("early_v"))
    fits = F.least("size_u", "size_v") >= similarity * F.greatest("size_u", "size_v") - 1e-9
    return a.join(b, "key").filter((F.col("node_u") != F.col("node_v")) & fits & counts)


def _tallied(lists: DataFrame, similarity: float) -> DataFrame:
    """A written table of the pairs (u, v) that share the guaranteed number of postings."""
    both = _pairs(lists, lists, similarity).filter("node_u < node_v").withColumn("smaller", F.least("size_u", "size_v"))
    tally = both.groupBy(F.col("node_u").alias("u"), F.col("node_v").alias("v")).agg(F.count("*").alias("shared"), F.min("smaller").alias("smaller"))
    return materialise(tally.filter(F.col("shared") >= F.when(F.col("smaller") >= MANY, SHARED).otherwise(1)).select("u", "v"), "tallied")


def by_fingerprint(distinct: DataFrame) -> DataFrame:
    """A written table of the pairs (u, v) of the nodes of ``distinct`` (node, fp, ...) that meet through their fingerprints.

    A fingerprint's smallest node meets the fingerprint's others, and that of each fingerprint that ``simhash.links`` links to it.
    """
    with scratch_scope(distinct.sparkSession):
        firsts = materialise(distinct.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
        a, b = (firsts.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}")) for x in ("u", "v"))
        near = simhash.links(firsts.select("fp")).join(a, "u").join(b, "v").select("first_u", "first_v")
        same = distinct.select("node", "fp").join(firsts, "fp").filter("node != first").select(F.col("first").alias("first_u"), F.col("node").alias("first_v"))
        pairs = near.unionByName(same).select(F.least("first_u", "first_v").alias("u"), F.greatest("first_u", "first_v").alias("v"))
        return materialise(pairs, "by-fingerprint", keep=True)


def _rarest_first(sets: DataFrame, most: int) -> DataFrame:
    """A written table of postings (key, node, size, early, at) of ``sets`` (node, n_first, n_early, shingles), ordered anew.

    Shingles that over ``most`` of these nodes have come last, rarest first; the others stay in their order.
    """
    with scratch_scope(sets.sparkSession):
        keys = sets.select(F.explode("shingles").alias("key"))
        parts = [keys.filter(F.pmod("key", F.lit(PASSES)) == i).groupBy("key").agg(F.count("*").alias("among")) for i in range(PASSES)]
        among = reduce(DataFrame.unionByName, [materialise(x.filter(F.col("among") > most), "frequent") for x in parts])
        own = sets.select("node", F.explode("shingles").alias("key")).join(among, "key").groupBy("node")
        own = materialise(own.agg(F.array_sort(F.collect_list(F.struct("among", "key"))).alias("frequent")), "frequent-by-node")  # one text's shingles
        last = F.coalesce(F.col("frequent.key"), F.array().cast("array<long>"))
        order = F.slice(F.concat(F.array_except("shingles", last), last), F.lit(1), F.col("n_first"))
        filed = sets.join(own, "node", "left").select("node", F.size("shingles").alias("size"), "n_early", F.posexplode(order).alias("at", "key"))
        return materialise(filed.select("key", "node", "size", (F.col("at") < F.col("n_early")).alias("early"), "at"), "postings-again", keep=True)


def links(docs: DataFrame, distinct: DataFrame, words: int = 5, similarity: float = 0.8, most: int = MOST) -> DataFrame:
    """(u, v) between the nodes of ``distinct`` (node, at, fp, size, early, first), enough to connect all whose similarity is at least that."""
    near = by_fingerprint(distinct)
    postings = distinct.select("node", "size", F.col("early").alias("n_early"), F.posexplode("first").alias("at", "key"))
    lists = _lists(postings.select("key", "node", "size", (F.col("at") < F.col("n_early")).alias("early")))
    pairs = materialise(near.unionByName(_tallied(lists.filter(F.col("of") <= most), similarity)).distinct(), "candidates")
    hot = materialise(lists.filter(F.col("of") > most).select("node").distinct(), "long")
    needed = pairs.select(F.explode(F.array("u", "v")).alias("node"), F.lit(False).alias("hot")).unionByName(hot.select("node", F.lit(True).alias("hot")))
    needed = needed.groupBy("node").agg(F.bool_or("hot").alias("hot"))
    nodes = distinct.select("node", "at", F.size("first").alias("n_first"), F.col("early").alias("n_early")).join(needed, "node")
    sets = _sets(docs, nodes, words)
    found = _verified(pairs, sets, similarity)
    if hot.isEmpty():
        return found

    lists = _lists(_rarest_first(sets.filter("hot"), most))
    again = _tallied(lists.filter(F.col("of") <= most), similarity).join(pairs, ["u", "v"], "left_anti")
    found = found.unionByName(_verified(again, sets, similarity))
    hot = materialise(lists.filter(F.col("of") > most).drop("of"), "still-long")
    if hot.isEmpty():
        return found

    leaders = F.array(*[F.min_by("node", F.xxhash64(F.lit(i), "node")) for i in range(LEADERS)])
    led = materialise(hot.groupBy("key").agg(leaders.alias("leaders")), "leaders")
    led = hot.join(led, "key").select(F.col("node").alias("v"), F.explode("leaders").alias("u")).filter("u != v").distinct()
    found = found.unionByName(_verified(materialise(led, "led"), sets, similarity))
    roots = connected_components(found, rounds=1, partial=True)  # what isn't joined yet is verified once more, no link hangs on it
    rooted = lists.join(hot.select("node").distinct(), "node").join(roots, "node", "left")
    rooted = materialise(rooted.withColumn("root", F.coalesce("root", "node")), "long-rooted")
    return found.unionByName(_verified(_apart(rooted, similarity), sets, similarity))


def _apart(lists: DataFrame, similarity: float) -> DataFrame:
    """A written table of the pairs (u, v) of ``lists`` (key, node, size, early, at, root) in different components that may reach the similarity.

    In each list those outside its largest component meet all others. Two sets in one order that share c elements up to places i and j
    share at most c + min(n_u - 1 - i, n_v - 1 - j) in all; what two similar sets share up to their last counted posting is counted.
    """
    counts = materialise(lists.groupBy("key", "root").agg(F.count("*").alias("n")), "root-counts")
    main = counts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1").select("key", "main")
    open_ = materialise(lists.select("key", "node", "size", "early", "at", "root").join(materialise(main, "main-roots"), "key"), "long-open")
    rest, side = open_.filter("root != main").drop("main"), open_.withColumn("rest", F.col("root") != F.col("main")).drop("main")
    met = _pairs(rest, side, similarity).filter((F.col("root_u") != F.col("root_v")) & (~F.col("rest_v") | (F.col("node_u") < F.col("node_v"))))
    first = F.col("node_u") < F.col("node_v")
    ends = [F.when(first, a).otherwise(b).alias(name) for name, a, b in (("u", F.col("node_u"), F.col("node_v")), ("v", F.col("node_v"), F.col("node_u")))]
    left = F.least(F.col("size_u") - F.col("at_u"), F.col("size_v") - F.col("at_v")) - 1
    both = met.select(*ends, left.alias("left"), F.least("size_u", "size_v").alias("smaller"), (F.col("size_u") + F.col("size_v")).alias("both"))
    tally = both.groupBy("u", "v").agg(F.count("*").alias("shared"), F.min("left").alias("left"), F.min("smaller").alias("smaller"), F.min("both").alias("both"))
    enough = F.col("shared") >= F.when(F.col("smaller") >= MANY, SHARED).otherwise(1)
    reach = F.col("shared") + F.col("left") >= similarity / (1 + similarity) * F.col("both") - 1e-9
    return materialise(tally.filter(enough & reach).select("u", "v"), "pairs-apart")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, most: int = MOST) -> DataFrame:
    """doc_id, text_hash, root (the component's smallest node) and component_id, its smallest doc_id."""
    spark = docs.sparkSession
    with scratch_scope(spark):
        with scratch_scope(spark):
            signed = materialise(_signed(docs.select("doc_id", "text"), words, similarity), "signed")
            prints = materialise(signed.select("doc_id", "text_hash", "node"), "prints", keep=True)
            best = F.min(F.struct("doc_id", "text_hash")).alias("at")
            distinct = signed.groupBy("node").agg(F.min("doc_id").alias("first_id"), best, *[F.first(c).alias(c) for c in ("fp", "size", "early", "first")])
            distinct = materialise(distinct, "nodes", keep=True)
        edges = links(docs, distinct, words, similarity, most)
        members = simhash.with_components(distinct.select("node", F.col("first_id").alias("first")), edges, "node")
        result = prints.select("doc_id", "text_hash", "node").join(members, "node").select("doc_id", "text_hash", "root", "component_id")
        return materialise(result, "similar-members", keep=True)
