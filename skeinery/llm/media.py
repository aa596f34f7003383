"""Media columns: PNG files in binary columns, and what is computed from them.

The writer makes 8-bit greyscale PNG of 192 samples a row: zlib data in IDAT chunks, each with its checksum, rows
filtered by the one of None, Sub and Up with the smallest residuals. The reader takes any non-interlaced 8-bit
greyscale PNG: it tests every chunk's checksum and length, unfilters with numpy (all five filter types) and refuses
damaged files. The feature is a perceptual hash: area means on a 32 x 32 grid, cosine transform, 8 x 8 lowest
frequencies against their median, 64 bits in a binary column.

Defined cases: null text is the empty text; an empty text is one row of blanks; equal texts give equal files and
features; a null or damaged file gives null payload and feature and an error text; repeated rows, an empty table and
clashing column names are as anywhere.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.llm._common import bounded_batches, spare

WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT_BYTES = 1 << 16


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 padded with blanks to a positive multiple of the width, and the length before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, -(-len(raw) // WIDTH)) * WIDTH
    return raw.ljust(size, b" "), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return b"".join((struct.pack(">I", len(data)), kind, data, struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))))


def png_encode(payload: bytes, level: int = 6) -> bytes:
    """``payload``, a positive multiple of 192 bytes, as an 8-bit greyscale PNG."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = [rows, rows.copy(), rows.copy()]
    filtered[1][:, 1:] -= rows[:, :-1]
    filtered[2][1:] -= rows[:-1]
    # The usual heuristic: the filter whose residuals, taken as signed, are smallest.
    kind = min(range(3), key=lambda k: (int(np.abs(filtered[k].view(np.int8).astype(np.int16)).sum()), k))
    lines = np.empty((len(rows), WIDTH + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, filtered[kind]
    data = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    parts = [_chunk(b"IDAT", data[at : at + IDAT_BYTES]) for at in range(0, len(data), IDAT_BYTES)]
    return b"".join((SIGNATURE, _chunk(b"IHDR", head), *parts, _chunk(b"IEND", b"")))


def png_chunks(data: bytes) -> Iterator[tuple[bytes, memoryview]]:
    """Each chunk's kind and data; ValueError where a length or a checksum is wrong or the end is missing."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    view, at = memoryview(data), 8
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("truncated chunk")
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            raise ValueError("truncated chunk")
        body = view[at + 8 : at + 8 + size]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"checksum of {kind!r}")
        yield kind, body
        at += 12 + size
        if kind == b"IEND":
            return
    raise ValueError("no IEND")


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Undo PNG's row filters for samples of one byte; rows of a run with one filter go together where they can."""
    if (kinds > 4).any():
        raise ValueError("unknown filter")
    out = lines.copy()
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(kinds)]):
        kind, above = kinds[lo], out[lo - 1] if lo else np.zeros(lines.shape[1], np.uint8)
        if kind == 1:
            out[lo:hi] = np.cumsum(lines[lo:hi], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[lo:hi] = np.cumsum(lines[lo:hi], axis=0, dtype=np.uint8) + above
        elif kind > 2:
            for y in range(lo, hi):
                up, left, corner = above.tolist(), 0, 0
                row = lines[y].tolist()
                for x, value in enumerate(row):
                    guess = (left + up[x]) // 2 if kind == 3 else _paeth(left, up[x], corner)
                    corner, left = up[x], (value + guess) & 255
                    row[x] = left
                out[y] = row
                above = out[y]
    return out


def png_decode(data: bytes) -> np.ndarray:
    """The samples, height x width."""
    head, parts = None, []
    for kind, body in png_chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif not kind[0] & 32 and kind != b"IEND":
            raise ValueError(f"unknown critical chunk {kind!r}")
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale PNG without interlacing")
    width, height = head[:2]
    # No more is unpacked than the head says, whatever the stream holds.
    stream = zlib.decompressobj()
    unpacked = np.frombuffer(stream.decompress(b"".join(parts), height * (width + 1) + 1), np.uint8)
    if unpacked.size != height * (width + 1) or not stream.eof:
        raise ValueError("wrong amount of samples")
    lines = unpacked.reshape(height, width + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


@cache
def _cosines(n: int = 32, low: int = 8) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))


def _shrink(rows: np.ndarray, n: int) -> np.ndarray:
    """Area means of the rows on n places; rows are repeated where there are fewer."""
    cuts = np.arange(n + 1) * len(rows) // n
    if len(rows) < n:
        return rows[cuts[:-1]].astype(np.float64)
    return np.add.reduceat(rows, cuts[:-1], axis=0, dtype=np.float64) / np.diff(cuts)[:, None]


def dct_hash(samples: np.ndarray) -> bytes:
    small = _shrink(_shrink(samples, 32).T, 32).T
    c = _cosines()
    # Rounded, so that the comparison doesn't hang on the last digits.
    low = np.round(c @ small @ c.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def encode_png(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with the text's PNG file in a binary column (``media``, or that with a line before it where it is taken) and n_bytes, the length of the text in UTF-8."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("binary")
    def png(texts: pa.Array) -> pa.Array:
        return pa.array([png_encode(payload_of(t.as_py())[0]) for t in texts], pa.binary())

    return docs.withColumns({spare(docs.columns, media): png(F.col(text)), spare(docs.columns, "n_bytes"): F.coalesce(F.octet_length(text), F.lit(0)).cast("long")})


def decode_png(df: DataFrame, media: str = "media", into: str = "image") -> DataFrame:
    """``df`` with a struct of payload (the samples as bytes), feature (64 bits) and error, from the files of a binary column."""
    bounded_batches(df.sparkSession)
    kind = pa.struct([("payload", pa.binary()), ("feature", pa.binary()), ("error", pa.string())])

    @F.arrow_udf("payload binary, feature binary, error string")
    def image(files: pa.Array) -> pa.Array:
        out = []
        for f in files:
            data = f.as_py()
            try:
                samples = png_decode(data) if data is not None else None
                out.append((samples.tobytes(), dct_hash(samples), None) if samples is not None else (None, None, "null"))
            except (ValueError, zlib.error, struct.error) as e:
                out.append((None, None, str(e)))
        return pa.StructArray.from_arrays([pa.array([x[i] for x in out], t.type) for i, t in enumerate(kind)], fields=list(kind))

    return df.withColumn(spare(df.columns, into), image(F.col(media)))
