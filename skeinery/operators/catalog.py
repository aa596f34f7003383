"""Names of index versions as data: which one is active, which go after a publication."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build_pattern(name: str) -> str:
    """Matches the builds of ``name`` and no sibling's."""
    return "^" + re.escape(name) + r"-\d{8}-\d{6}$"


def new_build_name(name: str, now: datetime | None = None) -> str:
    return f"{name}-{(now or datetime.now(timezone.utc)):%Y%m%d-%H%M%S}"


def resolve_active(collections: DataFrame, aliases: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (name) with active: an alias' target, else the collection of that name, else null."""
    targets = aliases.select(F.col("alias").alias("name"), "target")
    real = collections.select(F.col("name").alias("real"))
    return asked.join(targets, "name", "left").join(real, F.col("name") == F.col("real"), "left").select("name", F.coalesce("target", "real").alias("active"))


def swept(collections: DataFrame, aliases: DataFrame, alias: str, new: str) -> DataFrame:
    """(name): what goes when ``alias`` moves to ``new``: older builds, and a real collection that has the alias' name."""
    is_alias = aliases.filter(F.col("alias") == alias).select(F.lit(True).alias("is_alias")).limit(1)
    old = collections.filter((F.col("name") != new) & F.col("name").rlike(build_pattern(alias))).select("name")
    legacy = collections.filter(F.col("name") == alias).join(is_alias, F.lit(True), "left").filter("is_alias IS NULL").select("name")
    return old.unionByName(legacy)
