"""Vector code compression: product quantisation in whole numbers, trained by reduction trees over columnar blocks.

Components become integers by floor(scale * x) and vectors are cut into equal consecutive parts, each with a codebook of
its own. The vectors lie in a written table of NumPy blocks, a column for each component. A training round is one RDD
treeAggregate over the blocks: a task adds up squared distances dimension by dimension, takes for every part the nearest
codebook entry, and adds parts and ones with np.add.at to int64 tensors of sums and counts, which a reduction tree merges.
All is exact: 32-bit numbers are used only where the largest components prove that no distance exceeds them.

Only codebooks and tensors (parts x entries x components) pass through the driver, whatever the corpus. Blocks are
bounded by rows, and nothing is grouped but errors by label, pre-aggregated.

Defined cases: vectors that are null or hold null or non-finite components take no part, neither do those with another
number of components than most have (of equally many the smaller number); that number must divide into the parts.
Components of an absolute value of 2^18 or more are an error, as their distances leave a long's range at the scale of
1024. Codebooks start with the smallest ids, null ids after all others, rows with equal ids by vector, all counted; fewer
vectors than entries give smaller codebooks. Null labels count as one label. Repeated rows are rows of their own. An
empty table gives an empty table. Columns are read by name; others don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.llm._common import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows in a block, and rows whose distances are in memory at once.
BLOCK_ROWS, AT_ONCE = 4096, 512
#: What a component may be at most, after scaling.
LARGEST = 1 << 28


def whole_numbers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) in double precision (exact for a power of two), as int32."""
    got = np.floor(vectors.astype(np.float64) * scale)
    if got.size and np.abs(got).max() >= LARGEST:
        raise ValueError(f"a component is too large: {scale} times its value must stay below {LARGEST}")
    return got.astype(np.int32)


def nearest(columns: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry (ties: the lower index) for rows given as ``columns`` (components x rows)."""
    dims, n = columns.shape
    widest = int(max(np.abs(columns).max(initial=0), np.abs(book).max(initial=0)))
    kind = np.int32 if dims * (2 * widest) ** 2 < 1 << 31 else np.int64
    columns, entries = columns.astype(kind), np.ascontiguousarray(book.T.astype(kind))
    index, error = np.empty(n, np.int64), np.empty(n, np.int64)
    for at in range(0, n, AT_ONCE):
        rows = columns[:, at : at + AT_ONCE]
        total = np.zeros((rows.shape[1], len(book)), kind)
        for x, entry in zip(rows, entries):
            gap = x[:, None] - entry[None, :]
            gap *= gap
            total += gap
        own = total.argmin(axis=1)
        index[at : at + AT_ONCE] = own
        error[at : at + AT_ONCE] = total[np.arange(len(own)), own]
    return index, error


def block_columns(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, "<i4").reshape(-1, rows) if rows else np.zeros((0, 0), np.int32)


def tally(tensors: tuple[np.ndarray, np.ndarray] | None, block, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``tensors`` (sums and counts by part and entry) with a block's parts added."""
    parts, entries, width = books.shape
    sums, counts = tensors or (np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64))
    columns = block_columns(block.data, block.rows)
    for p in range(parts):
        own = columns[p * width : (p + 1) * width]
        index, _ = nearest(own, books[p])
        np.add.at(sums[p], index, own.T)
        np.add.at(counts[p], index, 1)
    return sums, counts


def merge(a, b):
    """Two tasks' tensors; None of a task without blocks."""
    return a or b if a is None or b is None else (a[0] + b[0], a[1] + b[1])


def trained(books: np.ndarray, blocks: DataFrame, rounds: int = ROUNDS, depth: int = 2) -> np.ndarray:
    """The codebooks (parts x entries x components) after ``rounds`` over ``blocks`` (rows, data)."""
    rdd = blocks.select("rows", "data").rdd
    for _ in range(rounds):
        tensors = rdd.treeAggregate(None, partial(tally, books=books), merge, depth)
        if tensors is None:
            break
        sums, counts = tensors
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
    return books


def written_blocks(rows: DataFrame, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A written table of blocks of ``rows`` (id, label, v): ids and labels as arrays, their number, and the scaled components column by column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                v = part.column(2)
                matrix = v.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                data = np.ascontiguousarray(whole_numbers(matrix, scale).T.astype("<i4")).tobytes()
                ids, labels = (pa.array([part.column(i).to_pylist()], pa.list_(part.column(i).type)) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows]), pa.array([data], pa.binary()), ids, labels], names=["rows", "data", "ids", "labels"])

    label = rows.schema["label"].dataType.simpleString()
    return materialise(rows.select("id", "label", "v").mapInArrow(run, f"rows long, data binary, ids array<long>, labels array<{label}>"), "code-blocks")


def taking_part(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(id, label, v): the rows whose vectors hold finite components alone."""
    v = F.col(vector_column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"), v.alias("v")).filter(F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


def compress(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    dims: int | None = None,
) -> tuple[DataFrame, np.ndarray]:
    """((id, label, codes, error) for each vector, the codebooks): a code a part, and the squared distances summed over parts."""
    if not 1 <= entries <= 1 << 15:
        raise ValueError("entries must be from 1 to 32768")
    rows = taking_part(vectors, id_column, vector_column, label_column)
    if dims is None:
        first = rows.filter(F.size("v") > 0).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dims = first.n if first else parts
    if dims % parts:
        raise ValueError(f"{dims} components don't divide into {parts} parts")
    rows = rows.filter(F.size("v") == dims)
    # Those with the smallest ids: a top-k that Spark keeps by partition.
    seeds = [r.v for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    books = whole_numbers(np.array(seeds, np.float64).reshape(-1, dims), scale).astype(np.int64)
    books = np.ascontiguousarray(books.reshape(-1, parts, dims // parts).transpose(1, 0, 2))
    blocks = written_blocks(rows, scale)
    books = trained(books, blocks, rounds)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        width = books.shape[2]
        for batch in batches:
            for block in batch.to_pylist():
                columns = block_columns(block["data"], block["rows"])
                got = [nearest(columns[p * width : (p + 1) * width], book) for p, book in enumerate(books)]
                codes = pa.array(list(np.stack([i for i, _ in got], axis=1).astype(np.int16)), pa.list_(pa.int16()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block["ids"], pa.int64()), pa.array(block["labels"], label_kind), codes, pa.array(sum(e for _, e in got), pa.int64())], names=["id", "label", "codes", "error"]
                )

    from pyspark.sql.pandas.types import to_arrow_type

    label = rows.schema["label"].dataType
    label_kind = to_arrow_type(label)
    coded = blocks.mapInArrow(encode, f"id long, label {label.simpleString()}, codes array<smallint>, error long")
    return materialise(coded, "codes"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decode(coded: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``coded`` with the approximate vectors: codebook entries over the scale, each at the middle of its step."""
    table = (books + 0.5) / scale
    shared = coded.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("array<float>")
    def vector(codes: pa.Array) -> pa.Array:
        table = shared.value
        index = np.array(codes.to_pylist(), np.int64).reshape(-1, table.shape[0])
        return pa.array(list(np.concatenate([table[p][index[:, p]] for p in range(table.shape[0])], axis=1).astype(np.float32)), pa.list_(pa.float32()))

    return coded.withColumn("vector", vector(F.col("codes")))


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the errors summed over equal labels. Spark broadcasts the sums only while they are small, beyond that AQE splits hot labels."""
    sums = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    own = sums.select(F.col("label").alias("_label"), "label_error")
    return coded.join(own, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
