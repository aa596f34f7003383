import base64
import hashlib
import io

import pytest

from pyspark.sql import functions as F

from skeinery.llm import queries, warc

SCHEMA = "page_id long, url string, html string"


def brute(rows, least=0):
    first, out = {}, []
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= least:
            first[b] = min([x for x in (first.get(b), p) if x is not None], default=None)
    for p, _, h in rows:
        b = (h or "").encode()
        refers = first.get(b) if len(b) >= least and first.get(b) != p else None
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def result(chunks):
    return sorted(((r.page_id, r.payload_bytes, r.digest_so_far, r.record_type, r.refers_to) for r in chunks.filter("last").collect()), key=repr)


ROWS = [(3, "http://a/ b\r\n", "same"), (1, None, "same"), (2, "http://é/", None), (5, "u", ""), (None, "u", "same"), (7, "u", "é" * 70_000), (8, "u", "x" * 33), (9, "u", "\r\n\r\nWARC/1.1\r\n")]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    manifest = warc.write_archives(spark.createDataFrame(ROWS, SCHEMA), min_bytes=least, chunk_bytes=1000)
    got = warc.read_archives(manifest, chunk_bytes=1000)
    assert result(got) == brute(ROWS, least)
    whole = {}
    for r in sorted(got.collect(), key=lambda r: r.chunk_no):
        if r.record_type == "response":
            assert len(r.data) <= 1000
            whole[r.page_id] = whole.get(r.page_id, b"") + r.data
            assert base64.b32encode(hashlib.sha1(whole[r.page_id]).digest()).decode() == r.digest_so_far
    assert whole[7].decode() == "é" * 70_000 and whole[9] == b"\r\n\r\nWARC/1.1\r\n"


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert result(warc.read_archives(warc.write_archives(pages), with_data=False)) == brute([(r.page_id, r.url, r.html) for r in pages.collect()])


def test_empty_repeated_and_damaged(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert warc.read_archives(warc.write_archives(none)).count() == 0
    twice = [(4, "u", "x"), (4, "u", "x"), (6, "u", "x")]
    assert result(warc.read_archives(warc.write_archives(spark.createDataFrame(twice, SCHEMA)))) == brute(twice)
    row = warc.write_archives(spark.createDataFrame([(1, "u", "some text")], SCHEMA)).first()
    import gzip

    data = bytearray(gzip.decompress(open(row.archive, "rb").read()))
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response")
    data[data.index(b"some")] = 0
    with pytest.raises(ValueError, match="damaged"):
        list(warc.read_records(io.BytesIO(gzip.compress(bytes(data))), 1))


def test_a_very_long_payload_and_clashing_names(spark):
    text = "0123456789abcdef" * (3 << 20)  # 48 MB
    pages = spark.range(3).select(F.col("id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.when(F.col("id") > 0, F.repeat(F.lit("0123456789abcdef"), 3 << 20)).otherwise("x").alias("html"), F.lit(1).alias("row"), F.lit(2).alias("data"), F.lit("k").alias("sha1"))
    chunks = warc.read_archives(warc.write_archives(pages), with_data=False)
    assert result(chunks) == brute([(0, None, "x"), (1, None, text), (2, None, text)])
    assert sorted(r.chunk_no for r in chunks.filter("page_id = 1").collect()) == list(range(48))


def test_the_registered_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = sorted(map(tuple, queries.op6_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    assert got == brute([(r.page_id, r.url, r.html) for r in pages.collect()])
