"""Files to index: recursive whole-text scan with an extension list and excluded paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What is indexed, and what never is.
EXTENSIONS = (".cs", ".csproj", ".sln", ".slnx")
EXCLUDED = (
    "*/bin/*",
    "*/obj/*",
    "*/node_modules/*",
    ".git/*",
    ".vs/*",
    ".run/*",
    "build/*",
    "dist/*",
    "packages/*",
    "*/TestResults/*",
    "*/PackageRoot/*",
    "*.snk",
)


def glob_pattern(glob: str) -> str:
    """A glob as an anchored pattern for relative paths: * is anything, also /. A leading */ also matches at the root."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob.removeprefix("*/"))
    return ("^(?:.*/)?" if glob.startswith("*/") else "^") + body + "$"


def is_wanted(path: Column, extensions=EXTENSIONS, excluded=EXCLUDED) -> Column:
    """The predicate on relative paths."""
    fits = F.lit(False)
    for e in extensions:
        fits = fits | path.endswith(e)
    for g in excluded:
        fits = fits & ~path.rlike(glob_pattern(g))
    return fits


def load(spark: SparkSession, root: str, extensions=EXTENSIONS, excluded=EXCLUDED) -> DataFrame:
    """(file_path relative to ``root``, file_name, text)"""
    read = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    rows = read.load(root).select("value", F.col("_metadata.file_path").alias("full"), F.col("_metadata.file_name").alias("file_name"))
    jvm_root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = jvm_root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(jvm_root).toUri().getPath().rstrip("/")
    path = F.regexp_replace(F.url_decode(F.regexp_replace(F.replace(F.col("full"), F.lit("+"), F.lit("%2B")), "^[a-zA-Z]+:(//[^/]*)?", "")), "^" + re.escape(base) + "/", "")
    return rows.select(path.alias("file_path"), F.url_decode(F.replace("file_name", F.lit("+"), F.lit("%2B"))).alias("file_name"), F.col("value").alias("text")).filter(is_wanted(F.col("file_path"), extensions, excluded))
