"""WARC archives as chunked record tables.

A page's payload is cut into (record, chunk number, bytes) rows in the very scan that reads it; only chunks move between
tasks, and neither a writer nor a reader holds more than one chunk of a record. Which payloads were seen before (same
length and SHA-1) is decided first, on a narrow table of keys; records that repeat one become revisits of the one with the
smallest page_id, and give no chunks. Writer and reader carry the digest from chunk to chunk; at a payload's end it must be
what was announced. A reader hands out the chunk rows again, each with the SHA-1 of the payload up to and with that chunk.

Archives are gzip files with a member for each record, written straight to the shared folder through pyarrow's file
systems under names no other attempt uses; the manifest, a table that Spark commits, names the files that count, so a
lost or repeated task leaves at most an unnamed file. Archives are read by byte ranges of the manifest.

Defined cases: null html is the empty payload; a null url gets the target urn:page:<page_id>; a null page_id is kept
as null and is never what others refer to unless all are null (then all are responses); rows that repeat the smallest
page_id with an equal payload are all responses; payloads may be as long as a cell can be; other columns, whatever their
names, are no part of a record and are left out; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.llm._common import bounded_batches, materialise, scratch_path, scratch_scope

CHUNK_BYTES = 1 << 20
#: Archive bytes that one reading task takes, about.
SPLIT_BYTES = 32 << 20
#: Reading tasks at most; beyond it a task reads several splits, one after the other.
MAX_READERS = 20_000
LEVEL = 4
_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122

MANIFEST = "archive string, offset long, length long, page_id long"
CHUNKS = "page_id long, url string, record_type string, refers_to long, chunk_no long, last boolean, bytes_so_far long, digest_so_far string, payload_bytes long, data binary"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'{page_id}/{digest}')}>"


def records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes and sha1 (hex) of ``pages`` (page_id, url, html), as they are scanned."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    return whole.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(k, k_null, k_sha1, refers_to): the page_ids (k, or null) whose payload of that digest revisits another page's."""
    keys = materialise(records(pages).select("page_id", "payload_bytes", "sha1"), "warc-keys")
    firsts = keys.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_bytes", "sha1").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    # Both sides of the join are written tables, so AQE can split a payload that a third of the pages share.
    firsts = materialise(firsts.filter("n > 1").drop("n"), "warc-firsts")
    revisits = keys.join(firsts, ["payload_bytes", "sha1"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = revisits.select(F.coalesce("page_id", F.lit(-1)).alias("k"), F.col("page_id").isNull().alias("k_null"), F.col("sha1").alias("k_sha1"), "refers_to")
    return materialise(revisits.distinct(), "warc-revisits")


def chunked(pages: DataFrame, revisits: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk rows of each record, a record's in one partition and in order; a revisit is one row without data.

    Rows that repeat a page_id with one payload are told apart by ``row``, which need not be the same in another run.
    """
    n = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("payload_bytes") / chunk_bytes).cast("long"))
    rows = records(pages).withColumn("row", F.monotonically_increasing_id())
    # Within one stage: the payload is a variable of the generated loop, not a column of its output.
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    data = F.substring("payload", (F.col("chunk_no") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes))
    rows = rows.select("page_id", "url", "payload_bytes", "sha1", "row", "chunk_no", data.alias("data"))
    on = (F.coalesce("page_id", F.lit(-1)) == F.col("k")) & (F.col("page_id").isNull() == F.col("k_null")) & (F.col("sha1") == F.col("k_sha1"))
    rows = rows.join(revisits, on, "left").filter(F.col("refers_to").isNull() | (F.col("chunk_no") == 0))
    rows = rows.withColumn("data", F.when(F.col("refers_to").isNull(), F.col("data"))).drop("k", "k_null", "k_sha1")
    # A record's chunks come from one task and have one key, so they stay together however AQE reads the shuffle.
    return rows.sortWithinPartitions("row", "chunk_no")


def _head(page_id, url, payload_bytes: int, digest: str, refers_to, date: str) -> bytes:
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if refers_to is not None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("X-Refers-To-Page", str(refers_to)),
        ]
    fields += [
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("X-Null-Url", str(int(url is None))),
        ("X-Payload-Length", str(payload_bytes)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + (payload_bytes if refers_to is None else 0))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Write the pages' records; the manifest, a row for each record, is a written table."""
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = folder or scratch_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, path = fs.FileSystem.from_uri(folder)
        name = f"{path}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        out, at, begun, pack, sha, got = None, 0, 0, None, None, 0
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if out is None:
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(name, compression=None)
                if row["chunk_no"] == 0:
                    pack, begun, sha, got = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), at, hashlib.sha1(), 0
                    digest = base32_sha1(bytes.fromhex(row["sha1"]))
                    at += out.write(pack.compress(_head(row["page_id"], row["url"], row["payload_bytes"], digest, row["refers_to"], date)))
                data = row["data"] or b""
                at += out.write(pack.compress(data))
                sha.update(data)
                got += len(data)
                if row["refers_to"] is not None or got >= row["payload_bytes"]:
                    if row["refers_to"] is None and (got != row["payload_bytes"] or sha.hexdigest() != row["sha1"]):
                        raise ValueError(f"the chunks of page {row['page_id']} aren't its payload")
                    at += out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                    done.append((name, begun, at - begun, row["page_id"]))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["archive", "offset", "length", "page_id"])
        if out is not None:
            out.close()

    with scratch_scope(spark):
        manifest = chunked(pages, decide(pages, min_bytes), chunk_bytes).mapInArrow(write, MANIFEST)
        # The names are paths within the file system of the folder.
        return materialise(manifest, "warc-manifest", keep=True).withColumn("folder", F.lit(folder))


class _Member:
    """One gzip member of a stream, unpacked piece by piece."""

    def __init__(self, stream, rest: bytes):
        self.stream, self.rest, self.unpack, self.ready = stream, rest, zlib.decompressobj(31), b""

    def more(self) -> bool:
        if self.unpack.eof:
            return False
        raw = self.unpack.unconsumed_tail or self.rest or self.stream.read(1 << 18)
        if not self.unpack.unconsumed_tail:
            self.rest = b""
        if not raw:
            raise ValueError("archive ends within a record")
        self.ready += self.unpack.decompress(raw, 1 << 18)
        if self.unpack.eof:
            self.rest = self.unpack.unused_data
        return True

    def until(self, mark: bytes) -> bytes:
        while mark not in self.ready:
            if not self.more():
                raise ValueError("record without a head")
        head, _, self.ready = self.ready.partition(mark)
        return head

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self.more():
                raise ValueError("record ends early")
        out, self.ready = self.ready[:n], self.ready[n:]
        return out


def read_records(stream, limit: int, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> Iterator[tuple]:
    """The chunk rows of ``limit`` records from where ``stream`` stands; ValueError where a payload isn't what its head says."""
    rest = b""
    for _ in range(limit):
        member = _Member(stream, rest)
        lines = member.until(b"\r\n\r\n").decode().split("\r\n")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        left = int(head["Content-Length"]) - len(http := member.until(b"\r\n\r\n")) - 4
        page_id = int(head["X-Page-Id"]) if head["X-Page-Id"].strip() else None
        url = None if head["X-Null-Url"] == "1" else head["WARC-Target-URI"]
        said, total, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"]), head["WARC-Type"]
        refers_to = int(head["X-Refers-To-Page"]) if kind == "revisit" else None
        if kind == "revisit":
            yield page_id, url, kind, refers_to, 0, True, total, said, total, None
        else:
            sha, got, k = hashlib.sha1(), 0, 0
            while True:
                data = member.take(min(chunk_bytes, left))
                left -= len(data)
                got += len(data)
                sha.update(data)
                if not left and (base32_sha1(sha.digest()) != said or got != total):
                    raise ValueError(f"payload of page {page_id} is damaged ({http[:20]!r})")
                yield page_id, url, kind, None, k, not left, got, base32_sha1(sha.digest()), total, data if with_data else None
                k += 1
                if not left:
                    break
        if member.take(4) != b"\r\n\r\n":
            raise ValueError("record without an end")
        while member.more():
            pass
        rest = member.rest


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunk rows of the archives that ``manifest`` names."""
    bounded_batches(manifest.sparkSession)
    split = F.floor(F.col("offset") / SPLIT_BYTES)
    splits = manifest.groupBy("folder", "archive", split.alias("split")).agg(F.min("offset").alias("begin"), F.count("*").alias("n"))
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    kinds = [types[x.split()[1]] for x in CHUNKS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            for job in batch.to_pylist():
                system, _ = fs.FileSystem.from_uri(job["folder"])
                rows, held = [], 0
                with system.open_input_file(job["archive"]) as stream:
                    stream.seek(job["begin"])
                    for row in read_records(stream, job["n"], chunk_bytes, with_data):
                        rows.append(row)
                        held += len(row[-1] or b"") + 200
                        if held > 4 << 20:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    # A row is 32 MB of work but a few bytes: the number of tasks is given, or else AQE would put all rows into one.
    splits = materialise(splits, "warc-splits")
    return splits.repartition(min(MAX_READERS, max(1, splits.count()))).mapInArrow(read, CHUNKS)
