"""Keyword matching and keyword statistics.

Matching is a literal, case-insensitive substring test of every active
keyword against the line; a keyword's exclusion phrase drops that one
(line, keyword) pair.  The small keyword list is compiled into literal
``contains`` expressions, so matching is a map-side projection inside
whole-stage codegen: no join and no shuffle.  Only matching pairs are
exploded, so the row count after the explode is the number of hits, not
lines x keywords.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.config import AlertRules
from vigilspark.functions.columns import lower_raw, matched_keywords


def keyword_hits(entries: DataFrame, rules: AlertRules, keep=None) -> DataFrame:
    """One row per (entry, matched active keyword) — F2 + F3.

    ``keep`` lists the entry columns to carry (default: all).  ``raw`` can be
    dropped here and re-joined later by ``seq`` for the few rows that fire.
    """
    keep = list(keep) if keep is not None else entries.columns
    # lower(raw) once per line, then every keyword tests the same value
    low = entries.select(*keep, lower_raw("raw").alias("_low"))
    words = matched_keywords(F.col("_low"), rules.active_keywords, rules.exclusions)
    return low.select(*keep, F.explode(words).alias("keyword"))


def aggregate_hits(entries: DataFrame, rules: AlertRules, keep=None) -> DataFrame:
    """matches of the aggregate (quarantined) keywords, no exclusions."""
    keep = list(keep) if keep is not None else entries.columns
    low = entries.select(*keep, lower_raw("raw").alias("_low"))
    words = matched_keywords(F.col("_low"), list(rules.aggregate))
    return low.select(*keep, F.explode(words).alias("keyword"))


def keyword_stats(hits: DataFrame, key: str = "source") -> DataFrame:
    """A4: hits and latest timestamp per (source, keyword).

    Partial aggregation runs before the shuffle; the output is tiny
    (sources x keywords).
    """
    return (hits.groupBy(key, "keyword")
            .agg(F.count(F.lit(1)).alias("hits"),
                 F.max("timestamp_ns").alias("last_seen_ns")))


def merge_keyword_stats(old: DataFrame, new: DataFrame) -> DataFrame:
    """A4 merge: hits add up, last seen is the later one."""
    return (old.unionByName(new)
            .groupBy("source", "keyword")
            .agg(F.sum("hits").cast("long").alias("hits"),
                 F.max("last_seen_ns").alias("last_seen_ns")))


def keyword_hit_count(stats: DataFrame, probes: DataFrame) -> DataFrame:
    """Look-up of hits for (source, keyword) probes; unseen pairs give 0."""
    return (probes.join(stats, ["source", "keyword"], "left")
            .select("source", "keyword", F.coalesce("hits", F.lit(0)).cast("long").alias("hits")))


def first_seen(hits: DataFrame) -> DataFrame:
    """A5: earliest keyword hit (over hits only, not over all entries)."""
    return hits.agg(F.coalesce(F.min("timestamp_ns"), F.lit(0)).cast("long").alias("first_seen_ns"))


def source_list(baseline: DataFrame, kw_stats: DataFrame) -> DataFrame:
    """Distinct sources present in the baseline or the keyword stats."""
    return baseline.select("source").unionByName(kw_stats.select("source")).distinct()
