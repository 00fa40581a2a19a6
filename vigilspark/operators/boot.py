"""Boot-window keyword statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.config import AlertRules, MAX_BOOT_WINDOW_SECONDS, MAX_TRACKED_BOOTS
from vigilspark.operators.match import keyword_hits


def in_boot_window(entries: DataFrame, window_seconds: int = MAX_BOOT_WINDOW_SECONDS) -> DataFrame:
    """boot id present and monotonic time (µs) below the window.

    ``monotonic_us`` may be a string from a journal export; it is cast with
    ``try_cast`` so unparsable values drop the row.
    """
    mono = F.col("monotonic_us").try_cast("long")
    return entries.filter(F.col("boot_id").isNotNull() & (F.col("boot_id") != "")
                          & (mono < F.lit(int(window_seconds) * 1_000_000)))


def boot_window_stats(entries: DataFrame, rules: AlertRules,
                      window_seconds: int = MAX_BOOT_WINDOW_SECONDS) -> DataFrame:
    """Hits, first and last hit per (boot, keyword) inside the boot window."""
    hits = keyword_hits(in_boot_window(entries, window_seconds), rules,
                        keep=["boot_id", "timestamp_ns"])
    return (hits.groupBy("boot_id", "keyword")
            .agg(F.count(F.lit(1)).alias("hits"),
                 F.min("timestamp_ns").alias("first_seen_ns"),
                 F.max("timestamp_ns").alias("last_seen_ns")))


def _by_boot(stats: DataFrame) -> DataFrame:
    """One row per boot: when it was first recorded, and its keywords (as many as there are rules)."""
    columns = [c for c in stats.columns if c != "boot_id"]
    return stats.groupBy("boot_id").agg(F.min("first_seen_ns").alias("boot_first_ns"), F.collect_list(F.struct(*columns)).alias("_kw"))


def _spread(boots: DataFrame, columns: list) -> DataFrame:
    return boots.select("boot_id", F.explode("_kw").alias("_k")).select(
        *[F.col("boot_id") if c == "boot_id" else F.col(f"_k.{c}").alias(c) for c in columns])


def merge_boot_stats(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new boot stats as one: hits add up, first and last hits widen."""
    return old.unionByName(new.select(*old.columns)).groupBy("boot_id", "keyword").agg(
        F.sum("hits").alias("hits"), F.min("first_seen_ns").alias("first_seen_ns"), F.max("last_seen_ns").alias("last_seen_ns"))


def retained_boot_stats(stats: DataFrame, keep: int = MAX_TRACKED_BOOTS) -> DataFrame:
    """Boot stats of the ``keep`` boots first recorded most recently (a top-k over boots)."""
    newest = _by_boot(stats).orderBy(F.col("boot_first_ns").desc(), F.col("boot_id").desc()).limit(int(keep))
    return _spread(newest, stats.columns)


def boot_summary(stats: DataFrame) -> DataFrame:
    """Keywords of the newest boot, by hits descending then first hit."""
    newest = _by_boot(stats).agg(F.max_by(F.struct("boot_id", "_kw"), F.struct("boot_first_ns", "boot_id")).alias("b")).select("b.*")
    return _spread(newest, stats.columns).orderBy(F.col("hits").desc(), F.col("first_seen_ns").asc(), F.col("keyword"))
