"""The flag table: queries, counts, clearing, archiving.

Flags are stored flat (entry columns + flag columns) and partitioned by
``flagged_date`` so that time filters prune whole folders.  M2/M3 write new
versions and never overwrite the path they read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.config import NS_PER_DAY
from vigilspark.functions.columns import utc_date_ns


def flag_query(flags: DataFrame, level: str | None = None, since_ns: int | None = None) -> DataFrame:
    """Optional level filter, ``flagged_at >= since_ns`` (inclusive)."""
    out = flags
    if level is not None:
        out = out.filter(F.col("level") == F.lit(level))
    if since_ns is not None:
        out = out.filter(F.col("flagged_at") >= F.lit(int(since_ns)))
    return out


def flag_listing(flags: DataFrame, **kw) -> DataFrame:
    """M1: flags in insertion order (newest last)."""
    return flag_query(flags, **kw).orderBy("flagged_at", "timestamp_ns", "pattern_key")


def flag_counts(flags: DataFrame) -> DataFrame:
    """A10: count per level plus the total (level NULL) via ROLLUP."""
    return flags.rollup("level").agg(F.count(F.lit(1)).alias("n"))


def flag_clear(flags: DataFrame, level: str | None = None) -> DataFrame:
    """M2: the flags that remain after clearing all or one level.

    The caller writes the result as a new version; removed = before - after.
    """
    if level is None:
        return flags.limit(0)
    return flags.filter(F.col("level") != F.lit(level))


def flag_archive_split(flags: DataFrame, as_of_ns: int, days: int) -> DataFrame:
    """M3: tag each flag with its destination; ``flagged_at < as_of - days``
    goes to the archive, the rest stays live.  Nothing is lost."""
    cutoff = int(as_of_ns) - int(days) * NS_PER_DAY
    return flags.withColumn(
        "destination", F.when(F.col("flagged_at") < F.lit(cutoff), F.lit("archive")).otherwise(F.lit("live")))


def nest_entry(flags: DataFrame) -> DataFrame:
    """Interchange layout: ``entry`` as a nested struct, as in the JSON lines
    files of the original tool."""
    return flags.select(
        F.struct("timestamp_ns", "source", "raw", "priority").alias("entry"),
        "level", "flagged_at", "pattern_key", "hit_count", "note")


def flatten_entry(nested: DataFrame) -> DataFrame:
    return nested.select("entry.timestamp_ns", "entry.source", "entry.raw", "entry.priority",
                         "level", "flagged_at", "pattern_key", "hit_count", "note")


def with_flag_date(flags: DataFrame) -> DataFrame:
    return flags.withColumn("flagged_date", utc_date_ns("flagged_at"))
