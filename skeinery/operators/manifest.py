"""Which files changed, and what an index holds after that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(chunks: DataFrame) -> DataFrame:
    """(file_path, file_hash), one row for each path that isn't null."""
    return chunks.filter(F.col("file_path").isNotNull()).groupBy("file_path").agg(F.max("file_hash").alias("file_hash"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, status): changed, new or deleted; unchanged files have no row.

    Presence is told by a mark, not by the hash: a stored null against a real hash is a change.
    """
    left = old.select("file_path", F.col("file_hash").alias("old_hash"), F.lit(True).alias("in_old"))
    right = new.select("file_path", F.col("file_hash").alias("new_hash"), F.lit(True).alias("in_new"))
    status = (
        F.when(F.col("in_old").isNull(), "new")
        .when(F.col("in_new").isNull(), "deleted")
        .when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "changed")
    )
    return left.join(right, "file_path", "full").select("file_path", status.alias("status")).filter("status IS NOT NULL")


def to_reindex(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("status").isin("changed", "new")).select("file_path")


def to_delete(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("status").isin("changed", "deleted")).select("file_path")


def delete_files(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    return chunks.join(paths.select("file_path"), "file_path", "left_anti")


def apply(chunks: DataFrame, changes: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """The index afterwards: what stays, and the rebuilt chunks of changed and new files."""
    return delete_files(chunks, to_delete(changes)).unionByName(rebuilt.join(to_reindex(changes), "file_path", "left_semi"))
