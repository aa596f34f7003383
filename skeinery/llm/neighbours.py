"""Approximate nearest neighbours by low-dimensional stable projections indexed by a kd-tree.

Vectors are scaled to length 1, where the largest cosine is the smallest distance, and projected on a few Gaussian
(2-stable) directions: the projected squared distance over the true one follows a chi-square law with as many degrees
of freedom. The upper levels of one kd-tree over the projections are fitted on a bounded sample of distinct vectors (at
most ``SAMPLE``, those with the smallest hashes); they deal every row to one cell, and a cell's rows get the lower levels
where they lie. A query reads its own cell first, leaf by leaf in order of projected distance, verifying each neighbour on
its original vector, until the chi-square test says that a vector nearer than the k-th verified one would by now have been
met with the wanted probability. Then it goes on to every other cell that the same test leaves open, and to no other.

Cells have about ``CELL_ROWS`` rows while there are at most ``MAX_CELLS``; beyond that they are dealt into blocks of that
size by a hash, and a query reads all blocks of a cell. The queries sent to a cell are dealt into parts of about
``QUERY_ROWS``, each of which meets a copy of the cell's rows, so a task holds a bounded number of both. Broadcast are the
splits and the number of parts of each cell, both bounded by the number of cells. Equal vectors are kept once with the k + 1
smallest ids, which is all that the answer can hold.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, neither do rows with a
null id or another number of components than most (given as ``dims``, else the most frequent one, of equals the smaller);
components of any finite size are taken, vectors are scaled by a power of two first; repeated rows are
candidates of their own, but all rows with the query's id are the query's own; fewer candidates give fewer rows; ties
go to the smaller id; an empty table gives an empty table; other columns don't matter, and an id column may have any name
but those of the result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinery.llm._common import bounded_batches, materialise, scratch_scope

PROJECTIONS = 10
#: The chance with which a nearer neighbour should have been met before a query stops.
CONFIDENCE = 0.97
LEAF = 48
#: Rows in a cell, about; cells at most; vectors that the cells are fitted on at most.
CELL_ROWS, MAX_CELLS, SAMPLE = 4096, 1024, 20_000
#: Queries that meet a cell's rows in one task, about.
QUERY_ROWS = 4096
#: What rounding can make of a squared distance of 0 between vectors at length 1.
ROUNDING = 1e-12
SEED = 11


def chi_square_quantile(p: float, freedom: int) -> float:
    """x with P(chi-square <= x) = p, by bisection on the incomplete gamma series."""

    def cdf(x: float) -> float:
        if x <= 0:
            return 0.0
        a, z = freedom / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= z / n
            total += term
        return total * math.exp(-z + a * math.log(z) - math.lgamma(a))

    lo, hi = 0.0, 10.0 * freedom + 100
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def cosine(rows: np.ndarray, norms: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
    """Double precision, summed in the same order for every row, so equal vectors have equal values."""
    return (rows * query).sum(axis=1) / (norms * norm)


class Tree:
    """A kd-tree over projections: leaves of rows with their bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        order, self.cuts = np.arange(len(points)), [0]
        stack, leaves = [(0, len(points))], []
        while stack:
            lo, hi = stack.pop()
            own = order[lo:hi]
            spread = np.ptp(points[own], axis=0) if hi > lo else np.zeros(1)
            axis = int(spread.argmax())
            if hi - lo <= leaf or spread[axis] == 0:
                leaves.append((lo, hi))
                continue
            mid = (hi - lo) // 2
            order[lo:hi] = own[np.argpartition(points[own, axis], mid)]
            stack += [(lo + mid, hi), (lo, lo + mid)]
        self.order, self.leaves = order, leaves
        self.low = np.array([points[order[lo:hi]].min(axis=0) for lo, hi in leaves]).reshape(len(leaves), points.shape[1])
        self.high = np.array([points[order[lo:hi]].max(axis=0) for lo, hi in leaves]).reshape(len(leaves), points.shape[1])

    def distances(self, query: np.ndarray) -> np.ndarray:
        """Least squared distance from the query to each leaf's box."""
        gap = np.maximum(0, np.maximum(self.low - query, query - self.high))
        return (gap * gap).sum(axis=1)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """In double precision, each times a power of two that brings its largest component to below 1: nothing is rounded, and no square leaves a double's range."""
    vectors = vectors.astype(np.float64)
    _, power = np.frexp(np.abs(vectors).max(axis=1, initial=0))
    return np.ldexp(vectors, -power[:, None])


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def directions(dims: int, projections: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dims, projections))


def projected(vectors: np.ndarray, projections: int = PROJECTIONS) -> np.ndarray:
    """The projections of scaled vectors at length 1."""
    return (vectors / lengths(vectors)[:, None]) @ directions(vectors.shape[1], projections)


def reach(limit: float, kth):
    """The squared projected distance within which the chi-square test leaves a search open, given its k-th cosine."""
    return limit * (np.maximum(0, 2 - 2 * kth) + ROUNDING)


class Cells:
    """The upper levels of the tree: halves at the median of the widest axis, the fullest cell first, and each cell's box."""

    def __init__(self, points: np.ndarray, cells: int):
        d = points.shape[1]
        self.axis, self.cut, self.child = [], [], []  # of the inner nodes; a child below zero is cell -child - 1
        self.low, self.high = [np.full(d, -np.inf)], [np.full(d, np.inf)]
        parent: list[tuple[int, int] | None] = [None]
        own = [np.arange(len(points))]
        whole: set[int] = set()  # cells of points that are all alike
        while len(own) < cells and len(whole) < len(own):
            c = max((i for i in range(len(own)) if i not in whole), key=lambda i: len(own[i]))
            spread = np.ptp(points[own[c]], axis=0) if len(own[c]) else np.zeros(1)
            axis = int(spread.argmax())
            if len(own[c]) < 2 or spread[axis] == 0:
                whole.add(c)
                continue
            values = points[own[c], axis]
            cut = float(np.median(values))
            if not (values < cut).any():
                cut = float(values[values > cut].min())
            node, new = len(self.axis), len(own)
            self.axis.append(axis)
            self.cut.append(cut)
            self.child.append([-c - 1, -new - 1])
            if parent[c]:
                self.child[parent[c][0]][parent[c][1]] = node
            self.low.append(self.low[c].copy())
            self.high.append(self.high[c].copy())
            self.high[c][axis] = self.low[new][axis] = cut
            parent[c] = (node, 0)
            parent.append((node, 1))
            own[c], right = own[c][values < cut], own[c][values >= cut]
            own.append(right)
        self.axis, self.cut = np.array(self.axis, np.int64), np.array(self.cut)
        self.child, self.low, self.high = np.array(self.child, np.int64).reshape(-1, 2), np.array(self.low), np.array(self.high)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell that each point lies in."""
        at = np.zeros(len(points), np.int64)
        if not len(self.axis):
            return at
        open_ = np.arange(len(points))
        while len(open_):
            node = at[open_]
            at[open_] = self.child[node, (points[open_, self.axis[node]] >= self.cut[node]).astype(np.int64)]
            open_ = open_[at[open_] >= 0]
        return -at - 1

    def within(self, point: np.ndarray, far: float) -> np.ndarray:
        """The cells whose boxes are at most a squared distance of ``far`` away."""
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        return np.flatnonzero((gap * gap).sum(axis=1) <= far)


class Index:
    """The lower levels: one block of distinct vectors, the (id, number of rows) that have them, projections and tree."""

    def __init__(self, vectors: np.ndarray, members: list, k: int, projections: int = PROJECTIONS):
        self.k, self.vectors, self.norms, self.points = k, vectors, lengths(vectors), projected(vectors, projections)
        self.directions, self.tree = directions(vectors.shape[1], projections), Tree(self.points)
        # In the tree's order, so that a leaf is a slice.
        order = self.tree.order
        self.members = [members[i] for i in order.tolist()]
        self.points, self.vectors, self.norms = self.points[order], self.vectors[order], self.norms[order]

    def search(self, query_id: int, query: np.ndarray, limit: float, known: float = -math.inf) -> list[tuple[float, int]]:
        """The k nearest found as (cosine, id); ``limit`` is the chi-square quantile that ends the search, ``known`` the k-th cosine found elsewhere."""
        k = self.k
        norm = float(lengths(query[None])[0])
        at = (query / norm) @ self.directions
        bound = self.tree.distances(at)
        # Incremental: leaves by their least projected distance, until the next is too far; the further, the more at a
        # time. Of a leaf only rows whose own projected distance passes the test are verified.
        best: list[tuple[float, int]] = []
        order, step, done = np.argsort(bound, kind="stable"), 4, 0
        while done < len(order):
            kth = max(known, best[k - 1][0] if len(best) >= k else -math.inf)
            within = reach(limit, kth)
            if bound[order[done]] > within:
                break
            rows = np.concatenate([np.arange(*self.tree.leaves[i]) for i in order[done : done + step]])
            done, step = done + step, min(2 * step, 64)
            gap = self.points[rows] - at
            rows = rows[(gap * gap).sum(axis=1) <= within]
            got = cosine(self.vectors[rows], self.norms[rows], query, norm)
            near = got >= kth
            rows, got = rows[near], got[near]
            if len(rows) > 4 * k:
                cut = np.partition(got, len(got) - 2 * k)[len(got) - 2 * k]
                rows, got = rows[got >= cut], got[got >= cut]
            found = [(float(c), i) for c, row in zip(got.tolist(), rows.tolist()) for i, n in self.members[row] if i != query_id for _ in range(n)]
            best = sorted(best + found, key=lambda x: (-x[0], x[1]))[:k]
        return best


def valid(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v): the rows that take part, components as given."""
    v = F.col(vector_column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): each vector once, with the k + 1 smallest ids that have it and how many rows each (k at most)."""
    counted = rows.groupBy("v", "id").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
    first = counted.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("at") <= k + 1)
    return first.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("ids"))


def _matrix(column) -> np.ndarray:
    return scaled(np.array([np.asarray(v) for v in column]))


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    dims: int | None = None,
    cell_rows: int = CELL_ROWS,
    max_cells: int = MAX_CELLS,
    confidence: float = CONFIDENCE,
    projections: int = PROJECTIONS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), the neighbour's id under its own name, score: for each row where ``is_query`` (a function of the id column) holds."""
    if id_column in ("query_id", "rank", "score"):
        raise ValueError(f"the result has a column {id_column} of its own")
    spark = vectors.sparkSession
    bounded_batches(spark)
    limit = chi_square_quantile(confidence, projections)
    with scratch_scope(spark):
        rows = valid(vectors, id_column, vector_column)
        if dims is None:
            first = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
            dims = first.n if first else 0
        rows = rows.filter(F.size("v") == dims)
        points = materialise(distinct_vectors(rows, k), "points")
        # A query is its id and vector: rows that repeat an id with other vectors are queries of their own.
        asked = rows.filter(is_query(F.col("id"))).select("id", "v").distinct().withColumn("digest", F.xxhash64("v"))
        n = points.count()
        sample = points.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).toPandas()["v"]
        wanted = min(max_cells, max(1, -(-n // cell_rows)))
        cells = Cells(projected(_matrix(sample), projections) if len(sample) else np.zeros((0, projections)), wanted)
        blocks = max(1, -(-n // (cell_rows * len(cells.low))))
        shared = spark.sparkContext.broadcast(cells)

        @F.pandas_udf("int")
        def cell_of(v: pd.Series) -> pd.Series:
            return pd.Series(shared.value.of(projected(_matrix(v), projections)).astype("int32"))

        @F.pandas_udf("array<int>")
        def open_cells(v: pd.Series, kth: pd.Series) -> pd.Series:
            at, far = projected(_matrix(v), projections), reach(limit, kth.to_numpy())
            return pd.Series([shared.value.within(p, r).astype("int32") for p, r in zip(at, far)])

        placed = points.withColumns({"cell": cell_of("v"), "block": F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int")})
        placed = materialise(placed, "placed")
        every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
        asked = materialise(asked.withColumn("own", cell_of("v")), "queries")

        def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            names = ["query_id", "digest", "id", "score"]
            if not len(left) or not len(right):
                return pd.DataFrame({c: pd.Series(dtype="float64" if c == "score" else "int64") for c in names})
            index = Index(_matrix(left["v"]), [[(x["id"], x["n"]) for x in own] for own in left["ids"]], k, projections)
            out = []
            for i, h, q, kth in zip(right["id"], right["digest"], _matrix(right["v"]), right["kth"]):
                out += [(i, h, j, c) for c, j in index.search(int(i), q, limit, kth)]
            return pd.DataFrame(out, columns=names)

        def answered(sent: DataFrame) -> DataFrame:
            """What ``sent`` (id, digest, v, kth, cell) finds: blocks of each cell's rows by parts of the queries sent there."""
            parts = F.ceil(F.count("*") / F.lit(query_rows)).cast("int").alias("parts")
            load = F.broadcast(sent.groupBy("cell").agg(parts))  # a row for each cell
            left = placed.join(load, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            right = sent.join(load, "cell").withColumn("part", F.pmod(F.xxhash64("id", "digest"), F.col("parts")).cast("int"))
            right = right.select("id", "digest", "v", "kth", "cell", "part", every_block)
            tile = ["cell", "block", "part"]
            found = left.select(*tile, "v", "ids").groupBy(*tile).cogroup(right.groupBy(*tile))
            return found.applyInPandas(search, "query_id long, digest long, id long, score double")

        order = Window.partitionBy("query_id", "digest").orderBy(F.col("score").desc(), "id")
        best = F.row_number().over(order)
        nothing = F.lit(-math.inf)
        own = asked.select("id", "digest", "v", nothing.alias("kth"), F.col("own").alias("cell"))
        near = materialise(answered(own).withColumn("rank", best).filter(F.col("rank") <= k), "own-cell")
        kth = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), "digest", F.col("score").alias("kth"))
        known = asked.join(kth, ["id", "digest"], "left").withColumn("kth", F.coalesce("kth", nothing))
        known = materialise(known.withColumn("cells", open_cells("v", "kth")), "open-cells")
        far = answered(known.withColumn("cell", F.explode("cells")).filter("cell != own").select("id", "digest", "v", "kth", "cell"))
        found = near.drop("rank").unionByName(far)
        ranked = found.withColumn("rank", best).filter(F.col("rank") <= k)
        return materialise(ranked.select("query_id", "rank", F.col("id").alias(id_column), "score"), "nearest", keep=True)


__all__ = ["Cells", "Index", "Tree", "chi_square_quantile", "cosine", "materialise", "nearest", "valid"]
