"""Chunks: greedy lines, sentence windows, and the routing of code files to the code chunker."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinery.functions.text import content_hash, is_code_file
from skeinery.operators.chunk_code import chunk_code

#: Rows and bytes that go to a Python worker at once; whole texts are rows, so this bounds what a worker holds.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20

_END = re.compile(r"[.!?]+\s+|\n\s*")


def bounded_batches(spark: SparkSession) -> None:
    """Spark reads these two settings when the result is run, so they stay set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def pieces_of(text: str, budget: int) -> list[str]:
    """The text cut between lines: each piece takes lines while they fit, at least one; a last piece of white space alone is dropped.

    The next cut is found on the lines' ends, so the work is linear in the text and every character is copied once.
    """
    lines = text.split("\n")
    ends = list(accumulate([*(len(x) + 1 for x in lines[:-1]), *([len(lines[-1])] if lines[-1] else [])]))
    out, done, begin = [], 0, 0
    while done < len(ends):
        done = max(done + 1, bisect_right(ends, begin + budget, done))
        out.append(text[begin : ends[done - 1]])
        begin = ends[done - 1]
    if out and not out[-1].strip(" \t\n\x0b\f\r"):
        out.pop()
    return out


def line_pieces(df: DataFrame, budget: int = 3200, text: str = "text") -> DataFrame:
    """``df`` with piece_no and piece: lines joined while they fit, with their newlines; a line over the budget stays whole."""
    bounded_batches(df.sparkSession)

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([pieces_of(t.as_py() or "", budget) for t in texts], pa.list_(pa.string()))

    return df.withColumn("_pieces", cut.asNondeterministic()(F.col(text))).select(*df.columns, F.posexplode("_pieces").alias("piece_no", "piece"))


def sentences(text: str) -> list[str]:
    """Sentences with what follows them, so that they join to the text again."""
    cuts = [0, *(m.end() for m in _END.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]


def sentence_windows(text: str, size: int = 800, overlap: int = 150, count: Callable[[str], int] = lambda s: len(s.split())) -> list[str]:
    """Windows of whole sentences of at most ``size`` tokens; each begins with the last sentences before it that fit ``overlap``.

    A sentence over the size is cut between words.
    """
    parts: list[tuple[str, int]] = []
    for s in sentences(text):
        n = count(s)
        if n <= size:
            parts.append((s, n))
            continue
        words = re.findall(r"\S+\s*", s)
        for at in range(0, len(words), size):
            piece = "".join(words[at : at + size])
            parts.append((piece, count(piece)))
    out, window, used = [], [], 0
    for s, n in parts:
        if window and used + n > size:
            out.append("".join(x for x, _ in window))
            kept, held = [], 0
            for x in reversed(window):
                if held + x[1] > overlap or held + x[1] + n > size:
                    break
                kept.append(x)
                held += x[1]
            window, used = kept[::-1], held
        window.append((s, n))
        used += n
    if "".join(x for x, _ in window).strip():
        out.append("".join(x for x, _ in window))
    return [w.strip() for w in out if w.strip()]


CHUNK = "file_path string, file_name string, file_hash string, chunk_no int, namespace string, type_name string, members string, text string"


def chunks(files: DataFrame, size: int = 800, overlap: int = 150, max_chars: int = 3200) -> DataFrame:
    """``files`` (file_path, file_name, text) as chunks with node_id: code files by their structure, the rest and what doesn't parse by sentences.

    Every chunk carries its file's hash, which isn't part of what is embedded.
    """
    bounded_batches(files.sparkSession)
    stamped = files.select("file_path", "file_name", content_hash(F.col("text")).alias("file_hash"), "text", is_code_file(F.col("file_name")).alias("code"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for f in batch.itertuples(index=False):
                text = f.text or ""
                got = chunk_code(text, max_chars) if f.code else None
                if got is None:
                    got = [(w, {}) for w in sentence_windows(text, size, overlap)]
                out += [(f.file_path, f.file_name, f.file_hash, i, m.get("namespace"), m.get("type_name"), m.get("members"), t) for i, (t, m) in enumerate(got)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHUNK.split(", ")]).astype({"chunk_no": "int32"})

    made = stamped.mapInPandas(run, CHUNK)
    return made.withColumn("node_id", F.sha2(F.concat_ws("\x1f", "file_path", F.col("chunk_no").cast("string")), 256))
