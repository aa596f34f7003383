import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from skeinery.llm import media, queries


@settings(max_examples=100, deadline=None)
@given(st.one_of(st.none(), st.text(max_size=700)))
def test_round_trip(text):
    payload, n = media.payload_of(text)
    raw = (text or "").encode()
    assert n == len(raw) and payload.rstrip(b" ") == raw.rstrip(b" ") and len(payload) % 192 == 0 and 0 <= len(payload) - n < 192 + (n == 0)
    samples = media.png_decode(media.png_encode(payload))
    assert samples.tobytes() == payload and samples.shape[1] == 192


def filtered(rows, kinds):
    """PNG's five filters, sample by sample."""
    out = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint8)
    for y, k in enumerate(kinds):
        out[y, 0] = k
        for x in range(rows.shape[1]):
            a = int(rows[y, x - 1]) if x else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out[y, x + 1] = (int(rows[y, x]) - (0, a, b, (a + b) // 2, paeth)[k]) % 256
    return out


def test_unfiltering_of_all_types():
    rows = np.random.default_rng(1).integers(0, 256, (20, 13), dtype=np.uint8)
    kinds = np.array([4, 3, 3, 0, 1, 1, 2, 2, 4, 4, 0, 0, 3, 2, 1, 4, 2, 2, 3, 0], np.uint8)
    lines = filtered(rows, kinds)
    assert (media.unfilter(lines[:, 0], lines[:, 1:]) == rows).all()


def test_every_damaged_byte_is_seen():
    data = media.png_encode(media.payload_of("some text")[0])
    for i in range(len(data)):
        bad = data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :]
        with pytest.raises((ValueError, zlib.error)):
            media.png_decode(bad)
    for n in range(len(data)):
        with pytest.raises((ValueError, zlib.error)):
            media.png_decode(data[:n])


def test_many_data_chunks_and_features():
    noise = np.random.default_rng(2).integers(0, 256, 192 * 4000, dtype=np.uint8)
    data = media.png_encode(noise.tobytes(), level=1)
    assert sum(k == b"IDAT" for k, _ in media.png_chunks(data)) > 5 and media.png_decode(data).tobytes() == noise.tobytes()
    y, x, r = np.arange(640)[:, None] / 640, np.arange(192)[None, :] / 192, np.random.default_rng(4)
    image = 128 + sum(r.normal(0, 9) * np.cos(np.pi * i * y) * np.cos(np.pi * j * x) for i in range(9) for j in range(9))
    bits = lambda x: np.unpackbits(np.frombuffer(media.dct_hash(np.clip(x, 0, 255).astype(np.uint8)), np.uint8))
    assert (bits(image) != bits(image + np.random.default_rng(3).normal(0, 2, image.shape))).sum() <= 12
    assert len(media.dct_hash(np.zeros((1, 192), np.uint8))) == 8


def test_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "é" * 40_000, "x"), (4, "a", "x"), (4, "a", "x"), (None, "a" * 192, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string")
    got = media.decode_png(media.encode_png(docs)).collect()
    assert got[0].asDict()["n_bytes"] == "x" and [r["_n_bytes"] for r in got] == [0, 0, 80_000, 1, 1, 192]
    for r in got:
        assert bytes(r.image.payload) == media.payload_of(r.text)[0] and r.image.error is None and len(r.image.feature) == 8
    assert got[0].media == got[1].media and got[3].image == got[4].image
    broken = spark.createDataFrame([(bytearray(b"no"),), (None,)], "media binary")
    assert [r.image.payload for r in media.decode_png(broken).collect()] == [None, None]
    assert media.decode_png(media.encode_png(docs.filter("false"))).count() == 0


def test_columns_that_are_there_stay_and_no_stream_unpacks_beyond_its_head(spark):
    docs = spark.createDataFrame([(1, "some text", "mine", "mine too")], "doc_id long, text string, media string, image string")
    got = media.encode_png(docs)
    assert got.columns == ["doc_id", "text", "media", "image", "_media", "n_bytes"]
    row = media.decode_png(got, media="_media").first()
    assert (row.media, row.image) == ("mine", "mine too") and bytes(row._image.payload).startswith(b"some text ")
    import struct
    import zlib

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    bomb = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 4, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(50 << 20))) + chunk(b"IEND", b"")
    with pytest.raises(ValueError):
        media.png_decode(bomb)


def test_the_registered_query(spark, sf):
    import hashlib
    import zlib

    from skeinery.llm import queries

    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op10_media_columns(spark, sf).collect():
        data = texts[r.doc_id]
        padded = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r.media_bytes > 0 and len(r.media_sha256) == 64 and len(r.feature) == 16


def test_the_query_reads_stored_files(spark, sf, monkeypatch):
    """Encoded once and written; what is read back comes from the table, damage and all."""
    plan = queries.op10_media_columns(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "png(" not in plan
    write = queries.materialise
    spoil = F.expr("substring(media, 1, octet_length(media) - 13)")
    monkeypatch.setattr(queries, "materialise", lambda df, tag: write(df.withColumn("media", F.when(F.col("doc_id") % 2 == 0, spoil).otherwise(F.col("media"))), tag))
    rows = queries.op10_media_columns(spark, sf).collect()
    assert [(r.doc_id, r.media_bytes, r.payload_bytes) for r in rows if (r.payload_sha256 is None) != (r.doc_id % 2 == 0)] == []
