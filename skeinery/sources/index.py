"""Versioned indexes of immutable segments, with an atomic pointer.

<root>/segments-<name>/<id>/ holds a segment: chunks (sorted by file_path, with Bloom filters), the keyword index in blocks,
its frequencies and totals, and tombstones, the files whose chunks in earlier segments are dead.
<root>/<name>-YYYYMMDD-HHMMSS/version.json lists a version's segments, <root>/CURRENT-<name> names the live version.

An update writes one segment with the changed and new files' chunks and one tombstone for each changed or deleted file;
nothing unchanged is chunked, embedded, tokenised or written. A read takes all segments and leaves out the dead. So that
they stay few, an update merges the last segments while the last isn't well smaller than the one before it (their
stored chunks and postings, without what is dead), and all of them when half the chunks are dead.

Writers hold a lease that expires, and move the pointer only if it still names the version they began with. A version
that a reader has pinned stays until it lets go or its mark expires. All through Hadoop's file system, so any store works
whose create and rename are atomic.
"""

from __future__ import annotations

import copy
import json
import logging
import re
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinery.operators import catalog, manifest
from skeinery.operators.chunk import chunks as make_chunks
from skeinery.operators.embed import Embedder, with_embedding
from skeinery.operators.retrieve import Blocks, Postings, build_postings, in_blocks, term_frequencies
from skeinery.sources.files_on import Store
from skeinery.sources.vectors import VectorTable

log = logging.getLogger(__name__)

#: Seconds that a lease and a reader's mark hold.
LEASE_SECONDS, READ_SECONDS = 3600, 3600
#: A last segment of over this share of the one before it is merged with it.
MERGE_SHARE = 0.5
TOMBSTONES = "file_path string"


class IndexMissing(RuntimeError):
    pass


class IndexBusy(RuntimeError):
    """Another writer holds the lease, or has moved the pointer meanwhile."""


@dataclass(frozen=True)
class Segment:
    """What version.json says of a segment: its chunks, and how many chunks of earlier segments its tombstones have killed."""

    id: str
    chunks: int
    killed: int


class VersionedIndex:
    def __init__(self, spark: SparkSession, root: str, name: str, embedder: Embedder, chunker: Callable[..., DataFrame] = make_chunks, vectors: VectorTable | None = None):
        """``chunker`` takes files (file_path, file_name, text) and its own options, and returns what ``chunk.chunks`` returns. ``vectors`` remembers embedded texts."""
        self.spark, self.root, self.name, self.embedder, self.chunker, self.vectors = spark, root.rstrip("/"), name, embedder, chunker, vectors
        self.store, self._pinned = Store(spark, self.root), None

    # -- catalog
    def current(self) -> str | None:
        """The live version's name; of a pinned index its own."""
        text = self._pinned or self.store.read(f"CURRENT-{self.name}")
        return text.strip() if text else None

    def versions(self) -> list[str]:
        return [n for n in self.store.folders() if re.match(catalog.build_pattern(self.name), n)]

    def _new_version(self) -> str:
        taken = set(self.versions())
        while (name := catalog.new_build_name(self.name, datetime.now(timezone.utc))) in taken:
            time.sleep(0.2)  # names are by the second
        return name

    def segments(self, version: str | None = None) -> list[Segment]:
        """The segments of a version (the live one), oldest first."""
        version = version or self.current()
        text = self.store.read(f"{version}/version.json") if version else None
        if text is None:
            raise IndexMissing(f"no index {self.name} under {self.root}; build it first")
        return [Segment(**s) for s in json.loads(text)["segments"]]

    def _folder(self, segment: str) -> str:
        return f"segments-{self.name}/{segment}"

    @contextmanager
    def lease(self, seconds: float = LEASE_SECONDS) -> Iterator[str]:
        """Be the only writer. An expired lease is taken over: renaming it away succeeds for one of those who try."""
        name, own = f"LEASE-{self.name}", uuid.uuid4().hex
        text = json.dumps({"owner": own, "until": time.time() + seconds})
        if not self.store.create(name, text):
            held = self.store.read(name)
            if not held or json.loads(held)["until"] > time.time():
                raise IndexBusy(f"another writer holds index {self.name}")
            gone = f"{name}.{own}"
            taken = self.store.take(name, gone)
            self.store.delete(gone)
            if not taken or not self.store.create(name, text):
                raise IndexBusy(f"another writer has taken over index {self.name}")
        try:
            yield own
        finally:
            if self._holds(own):
                self.store.delete(name)

    def _holds(self, own: str) -> bool:
        held = self.store.read(f"LEASE-{self.name}")
        return bool(held) and json.loads(held)["owner"] == own

    @contextmanager
    def reading(self, seconds: float = READ_SECONDS) -> Iterator[VersionedIndex]:
        """The index as it is now, kept whole for lazy reads until the end, or until the mark expires."""
        while True:
            version = self.current()
            if version is None:
                raise IndexMissing(f"no index {self.name} under {self.root}; build it first")
            mark = f"READ-{self.name}/{version}.{uuid.uuid4().hex}"
            self.store.create(mark, json.dumps({"until": time.time() + seconds}))
            if self.store.exists(f"{version}/version.json"):
                break
            self.store.delete(mark)  # swept before the mark was there; there is a newer one
        pinned = copy.copy(self)
        pinned._pinned = version
        try:
            yield pinned
        finally:
            self.store.delete(mark)

    def _read_versions(self) -> set[str]:
        """Versions with a mark that holds; expired marks go."""
        out = set()
        for mark in self.store.files(f"READ-{self.name}"):
            text = self.store.read(f"READ-{self.name}/{mark}")
            if text and json.loads(text)["until"] > time.time():
                out.add(mark.rsplit(".", 1)[0])
            elif text:
                self.store.delete(f"READ-{self.name}/{mark}")
        return out

    def promote(self, version: str, base: str | None, own: str) -> None:
        """Point at ``version`` if the pointer still names ``base`` and the lease is ours, then sweep what nobody reads."""
        if not self._holds(own) or self.current() != base:
            raise IndexBusy(f"index {self.name} has changed meanwhile")
        self.store.replace(f"CURRENT-{self.name}", version, f"CURRENT-{self.name}.{version}")
        self._sweep(version)

    def _sweep(self, live: str) -> None:
        kept = {live} | self._read_versions()
        for old in self.versions():
            if old not in kept:
                self.store.delete(old)
        named = {s.id for v in self.versions() for s in self.segments(v)}
        for segment in self.store.folders(f"segments-{self.name}"):
            if segment not in named:  # replaced, or left by a writer that failed: we hold the lease
                self.store.delete(self._folder(segment))

    # -- write
    def _write_segment(self, chunks: DataFrame, dead: list[str] | DataFrame | None = None, base: list[Segment] | None = None, postings: DataFrame | None = None) -> Segment:
        """A segment of ``chunks``; ``dead`` (file_path) are tombstones for the segments of ``base``. ``postings`` are those of ``chunks`` where they are known."""
        segment = uuid.uuid4().hex
        folder = f"{self.root}/{self._folder(segment)}"
        try:
            # Sorted by file, with Bloom filters: a filter on files skips row groups.
            ordered = chunks.repartitionByRange("file_path").sortWithinPartitions("file_path")
            ordered.write.option("parquet.bloom.filter.enabled#file_path", "true").option("parquet.block.size", str(16 << 20)).parquet(f"{folder}/chunks")
            stored = self.spark.read.schema(chunks.schema).parquet(f"{folder}/chunks")
            (build_postings(stored).postings if postings is None else postings).write.parquet(f"{folder}/flat")
            flat = self.spark.read.parquet(f"{folder}/flat")
            own = term_frequencies(flat).select("term", F.col("df").cast("long").alias("df"))
            own.write.parquet(f"{folder}/own")
            own = self.spark.read.schema(own.schema).parquet(f"{folder}/own")
            # By term, so that a search reads the row groups of its terms.
            in_blocks(flat, own).drop("segment").repartitionByRange("term", "bucket").sortWithinPartitions("term", "bucket").write.parquet(f"{folder}/blocks")
            counts = stored.agg(F.count("*").alias("n_docs")).crossJoin(flat.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_terms")))  # one row each
            killed = 0
            if dead is not None:
                dead.select("file_path").write.parquet(f"{folder}/tombstones")
                # What the dead chunks counted is taken off; only changed and deleted files are read again.
                tombs = self.spark.read.schema(TOMBSTONES).parquet(f"{folder}/tombstones")
                lost = self.chunks(segments=base).select("node_id", "file_path", "text").join(tombs, "file_path", "left_semi")
                gone = build_postings(lost).postings
                lost_terms = term_frequencies(gone).select("term", (-F.col("df")).cast("long").alias("df"))
                own = own.unionByName(lost_terms)
                less = lost.agg((-F.count("*")).alias("n_docs")).crossJoin(gone.agg((-F.coalesce(F.sum("tf"), F.lit(0))).alias("n_terms")))
                counts = counts.unionByName(less)
            own.write.parquet(f"{folder}/frequencies")
            counts.write.parquet(f"{folder}/totals")
            for part in ("flat", "own"):
                self.store.delete(f"{self._folder(segment)}/{part}")
            rows = [r.n_docs for r in self.spark.read.parquet(f"{folder}/totals").select("n_docs").collect()]  # one or two
            n = sum(x for x in rows if x > 0)
            killed = -sum(x for x in rows if x < 0)
            return Segment(segment, n, killed)
        except BaseException:
            self.store.delete(self._folder(segment))
            raise

    def _publish(self, segments: list[Segment], base: str | None, own: str) -> str:
        version = self._new_version()
        try:
            self.store.create(f"{version}/version.json", json.dumps({"segments": [asdict(s) for s in segments]}))
            self.promote(version, base, own)
        except BaseException:
            if self.current() != version:
                self.store.delete(version)
            raise
        return version

    def _drop(self, segments: list[Segment]) -> None:
        for s in segments:
            self.store.delete(self._folder(s.id))

    def _merged(self, segments: list[Segment]) -> list[Segment]:
        """``segments`` with the last ones merged where there are too many or too much is dead."""
        total = sum(s.chunks for s in segments)
        at = len(segments) - 1
        if 2 * sum(s.killed for s in segments) > total:
            at = 0
        size = sum(s.chunks for s in segments[at:])
        while at > 0 and size > MERGE_SHARE * segments[at - 1].chunks:
            at -= 1
            size += segments[at].chunks
        if at == len(segments) - 1:
            return segments
        kept, last = segments[:at], segments[at:]
        live, flat = self.chunks(segments=last), self.blocks(segments=last).flat().postings
        dead = None
        if kept:
            dead = self._tombstones(last).select("file_path").distinct()
        return [*kept, self._write_segment(live, dead, kept, postings=flat)]

    def _embedded(self, files: DataFrame, **chunking) -> DataFrame:
        chunks = self.chunker(files, **chunking)
        if self.vectors is None:
            return with_embedding(chunks, self.embedder)
        return self.vectors.embedded(chunks, self.embedder)

    def build(self, files: DataFrame, overwrite: bool = False, **chunking) -> str:
        """A full build from ``files`` (file_path, file_name, text)."""
        base = self.current()
        if base is not None and not overwrite:
            raise FileExistsError(f"index {self.name} exists; pass overwrite=True")
        with self.lease() as own:
            segment = self._write_segment(self._embedded(files, **chunking))
            try:
                return self._publish([segment], base, own)
            except BaseException:
                self._drop([segment])
                raise

    def update(self, files: DataFrame, keep_missing: bool = False, **chunking) -> str | None:
        """An incremental build: only changed and new files are read, and written; None when nothing changed.

        With ``keep_missing`` files that aren't in ``files`` stay.
        """
        base = self.current()
        if base is None:
            return self.build(files, overwrite=True, **chunking)
        with self.lease() as own:
            if self.current() != base:
                raise IndexBusy(f"index {self.name} has changed meanwhile")
            before, changes = self.segments(base), self.diff(files)
            if keep_missing:
                changes = changes.filter("status != 'deleted'")
            changes = changes.persist()
            made: list[Segment] = []
            try:
                if changes.isEmpty():
                    log.info("index %s: nothing to do", self.name)
                    return None
                wanted = files.join(manifest.to_reindex(changes), "file_path", "left_semi")
                columns = self.chunks(segments=before).columns
                rebuilt = self._embedded(wanted, **chunking).select(*columns)
                made = [self._write_segment(rebuilt, manifest.to_delete(changes), before)]
                after = self._merged([*before, *made])
                made += [s for s in after if s not in before and s not in made]
                return self._publish(after, base, own)
            except BaseException:
                self._drop(made)
                raise
            finally:
                changes.unpersist()

    def delete(self, paths: list[str]) -> str | None:
        """Files leave the index by a segment of tombstones alone; None where none of them is in it."""
        base = self.current()
        with self.lease() as own:
            before = self.segments(base)
            found = self.chunks(segments=before, paths=paths).select("file_path").distinct()
            if found.isEmpty():
                return None
            segment = self._write_segment(self.chunks(segments=before).limit(0), found, before)
            try:
                return self._publish([*before, segment], base, own)
            except BaseException:
                self._drop([segment])
                raise

    def diff(self, files: DataFrame) -> DataFrame:
        new = files.select("file_path", F.sha2("text", 256).alias("file_hash"))
        return manifest.diff(manifest.manifest(self.chunks()), new)

    # -- read
    def _parts(self, part: str, segments: list[Segment]) -> list[DataFrame]:
        """The part's table of each segment, with the segment's number."""
        return [self.spark.read.parquet(f"{self.root}/{self._folder(s.id)}/{part}").withColumn("segment", F.lit(i)) for i, s in enumerate(segments)]

    def _tombstones(self, segments: list[Segment]) -> DataFrame:
        """(file_path, before): a file's chunks in segments of a smaller number are dead."""
        with_tombs = [(i, s) for i, s in enumerate(segments) if self.store.exists(f"{self._folder(s.id)}/tombstones")]
        parts = [self.spark.read.schema(TOMBSTONES).parquet(f"{self.root}/{self._folder(s.id)}/tombstones").withColumn("before", F.lit(i)) for i, s in with_tombs]
        if not parts:
            return self.spark.createDataFrame([], TOMBSTONES + ", before int")
        return reduce(DataFrame.unionByName, parts).groupBy("file_path").agg(F.max("before").alias("before"))

    def _numbered(self, segments: list[Segment], paths: list[str] | None = None, live: bool = True) -> DataFrame:
        rows = reduce(DataFrame.unionByName, self._parts("chunks", segments))
        if paths is not None:
            # Pushed to the scans: Bloom filters and the order by file skip row groups.
            rows = rows.filter(F.col("file_path").isin(list(paths)) if len(paths) != 1 else F.col("file_path") == paths[0])
        if not any(s.killed for s in segments[1:]):
            return rows if live else rows.limit(0)
        tombs = self._tombstones(segments).withColumnRenamed("file_path", "_dead")
        return rows.join(tombs, (F.col("file_path") == F.col("_dead")) & (F.col("segment") < F.col("before")), "left_anti" if live else "left_semi")

    def chunks(self, paths: list[str] | None = None, segments: list[Segment] | None = None) -> DataFrame:
        """All chunks that count, or those of ``paths``; Parquet reads only the columns that are used."""
        rows = self._numbered(self.segments() if segments is None else segments, paths)
        return rows.drop("segment").withColumn("text", F.coalesce("text", F.lit("")))

    def blocks(self, segments: list[Segment] | None = None) -> Blocks:
        """The keyword index of the chunks that count."""
        segments = self.segments() if segments is None else segments
        all_of = lambda part: reduce(DataFrame.unionByName, self._parts(part, segments))
        counts = all_of("totals").agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("n_terms"))
        mean = F.when(F.col("n_docs") > 0, F.col("n_terms").cast("double") / F.col("n_docs"))
        frequencies = all_of("frequencies").select("term", "df")
        if len(segments) > 1:
            frequencies = frequencies.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        dead = self._numbered(segments, live=False).select("segment", "node_id") if any(s.killed for s in segments[1:]) else None
        return Blocks(all_of("blocks"), frequencies, counts.select("n_docs", mean.alias("avgdl")), dead)

    def postings(self) -> Postings:
        return self.blocks().flat()

    def check(self) -> None:
        if self.chunks().select("node_id").isEmpty():
            raise IndexMissing(f"index {self.name} has no chunks; run the build again")
