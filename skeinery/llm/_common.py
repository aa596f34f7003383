"""What the operators share: table access, the shared folder and bounded batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that go to a Python worker at once; with whole texts as rows this bounds a worker's memory.
BATCH_ROWS = 256
#: Bytes that go to a Python worker at once.
BATCH_BYTES = 4 << 20
#: Stands for a null id where ids are join keys or are ordered: below every other id.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds, by rows and by bytes. Spark reads these two settings when the result is run, so they stay set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, in local mode alone, a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.conf.get("skeinery.scratch.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="skeinery-")
        spark.conf.set("skeinery.scratch.dir", folder)
        atexit.register(_delete_local, folder[7:])
    return folder.rstrip("/")


def _delete_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, under the application's id, so that one delete clears what an application has left."""
    return f"{shared_dir(spark)}/skeinery/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: The scopes around the running code, innermost last: each thread has its own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` writes within are deleted at the end, but for those written with ``keep``."""
    own: list[str] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in own:
            remove(spark, path)


def in_scope(path: str, keep: bool = False) -> None:
    """Have the present scope (with ``keep`` the one around it) delete ``path``; without a scope it stays for whoever reads the result."""
    scopes = _scopes.get()
    at = len(scopes) - 1 - keep
    if at >= 0:
        scopes[at].append(path)


def materialise(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    in_scope(path, keep)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffles of what is run within go when it has ended, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def spare(columns: list[str], stem: str) -> str:
    """A column name that none of ``columns`` has."""
    taken = {c.lower() for c in columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name


def uniform(seed: int, *cols: Column) -> Column:
    """A number from 0 to below 1 on a grid of 1/1024, fixed by the seed and the columns."""
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1024)) + F.lit(0.5)) / F.lit(1024.0)


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z, nothing else: texts of ASCII alone take the fast way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, upper, upper.lower()))


class Buckets:
    """Bucketed, sorted tables in the shared folder: joins and groups on the keys neither shuffle nor sort them. All go at the end."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark, self.n = spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._paths: dict[str, str] = {}

    def save(self, rows: DataFrame, keys: list[str]) -> str:
        """The name of a table of ``rows``, which lie in their buckets' partitions."""
        name = f"skeinery_{uuid.uuid4().hex}"
        self._paths[name] = scratch_path(self.spark, "buckets")
        with in_written_order(self.spark):
            rows.write.bucketBy(self.n, *keys).sortBy(*keys).option("path", self._paths[name]).saveAsTable(name)
        return name

    def write(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        return self.spark.table(self.save(rows.repartition(self.n, *keys), keys))

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self._paths.pop(name))

    def close(self) -> None:
        for name in list(self._paths):
            self.drop(name)

    def __enter__(self) -> Buckets:
        return self

    def __exit__(self, *_) -> None:
        self.close()


@contextmanager
def in_written_order(spark: SparkSession) -> Iterator[None]:
    """Scans of bucketed tables give their rows in the order they were written in."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
