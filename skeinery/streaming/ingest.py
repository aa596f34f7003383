"""Optional: keep an index up to date from a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinery.sources.index import VersionedIndex

FILES = "file_path string, file_name string, text string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of Parquet tables of files."""
    return spark.readStream.schema(FILES).parquet(path)


def upsert(index: VersionedIndex, files: DataFrame) -> str | None:
    """Replace the chunks of the batch's files whose text changed; other files stay. Of a file that comes twice the one with the largest hash counts, whatever the order."""
    last = files.groupBy("file_path").agg(F.max_by(F.struct("file_name", "text"), F.sha2("text", 256)).alias("f")).select("file_path", "f.*")
    if index.current() is None:
        return None if files.isEmpty() else index.build(last, overwrite=True)
    return index.update(last, keep_missing=True)


def run(index: VersionedIndex, files: DataFrame, checkpoint: str, available_now: bool = True):
    """The streaming query; a batch that is repeated after a failure finds its files unchanged."""
    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: upsert(index, df) and None)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
