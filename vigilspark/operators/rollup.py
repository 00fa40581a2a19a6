"""Aggregate (quarantined) keyword rollups.

Each aggregate keyword is counted in fixed event-time intervals anchored at
``anchor_ns``; empty intervals emit nothing.  A summary row has level
AGGREGATE, source ``aggregate``, raw = keyword, hit_count = n, and both
timestamp and flagged_at at the interval end.  Intervals may differ per
keyword, so the bucket is integer arithmetic on ns instead of ``window()``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.config import AlertRules, NS_PER_SECOND
from vigilspark.operators.alerts import _case
from vigilspark.operators.match import aggregate_hits


def rollup_counts(entries: DataFrame, rules: AlertRules, anchor_ns: int) -> DataFrame:
    """(keyword, interval_s, end_ns, n): matching lines per interval; counts of parts of the input add up."""
    hits = aggregate_hits(entries, rules, keep=["timestamp_ns"])
    interval_s = _case(F.col("keyword"), dict(rules.aggregate)).cast("long")
    rel = hits.select("keyword", interval_s.alias("interval_s"), (interval_s * NS_PER_SECOND).alias("interval_ns"),
                      (F.col("timestamp_ns") - F.lit(int(anchor_ns))).alias("rel_ns"))
    # exact floor division on BIGINT ns (intervals differ per keyword)
    end = F.expr("((rel_ns - pmod(rel_ns, interval_ns)) div interval_ns + 1) * interval_ns") + F.lit(int(anchor_ns))
    return rel.groupBy("keyword", "interval_s", end.alias("end_ns")).agg(F.count(F.lit(1)).alias("n"))


def rollup_flags(counts: DataFrame) -> DataFrame:
    """One AGGREGATE flag per counted interval."""
    return counts.select(
        F.col("end_ns").alias("timestamp_ns"),
        F.lit("aggregate").alias("source"),
        F.col("keyword").alias("raw"),
        F.lit(None).cast("int").alias("priority"),
        F.lit("AGGREGATE").alias("level"),
        F.col("end_ns").alias("flagged_at"),
        F.concat(F.lit("aggregate:"), F.col("keyword")).alias("pattern_key"),
        F.col("n").cast("int").alias("hit_count"),
        F.format_string("%d hits aggregated over the last %ds (quarantined keyword)",
                        F.col("n"), F.col("interval_s")).alias("note"))


def aggregate_rollup(entries: DataFrame, rules: AlertRules, anchor_ns: int) -> DataFrame:
    return rollup_flags(rollup_counts(entries, rules, anchor_ns))
