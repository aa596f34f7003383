"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, in local mode alone, a folder of our own that goes with the process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="skeinery-engine-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


_own: list[str] = []


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder, under the application's id: lineage ends there. It stays for whoever reads the result."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/skeinery/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
