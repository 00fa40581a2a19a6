"""Schemas of the engine's tables.

Timestamps are kept as nanoseconds in BIGINT columns; Spark timestamps are
microseconds, so keys never round-trip through ``ts``.
"""

from pyspark.sql import types as T

LOG_ENTRY = T.StructType([
    T.StructField("timestamp_ns", T.LongType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("raw", T.StringType(), False),
    T.StructField("priority", T.IntegerType(), True),
])

# Journal export: every field is a string, never inferred.
JOURNAL_RECORD = T.StructType([
    T.StructField("__REALTIME_TIMESTAMP", T.StringType()),
    T.StructField("__MONOTONIC_TIMESTAMP", T.StringType()),
    T.StructField("_BOOT_ID", T.StringType()),
    T.StructField("_SYSTEMD_UNIT", T.StringType()),
    T.StructField("SYSLOG_IDENTIFIER", T.StringType()),
    T.StructField("MESSAGE", T.StringType()),
    T.StructField("PRIORITY", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])

FLAGGED = T.StructType([
    T.StructField("entry", LOG_ENTRY, False),
    T.StructField("level", T.StringType(), False),
    T.StructField("flagged_at", T.LongType(), False),
    T.StructField("pattern_key", T.StringType(), False),
    T.StructField("hit_count", T.IntegerType(), False),
    T.StructField("note", T.StringType(), True),
])

BASELINE = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("slot_key", T.StringType(), False),
    T.StructField("count", T.LongType(), False),
    T.StructField("mean", T.DoubleType(), False),
    T.StructField("m2", T.DoubleType(), False),
])

KEYWORD_STATS = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("keyword", T.StringType(), False),
    T.StructField("hits", T.LongType(), False),
    T.StructField("last_seen_ns", T.LongType(), False),
])

BOOT_STATS = T.StructType([
    T.StructField("boot_id", T.StringType(), False),
    T.StructField("keyword", T.StringType(), False),
    T.StructField("hits", T.LongType(), False),
    T.StructField("first_seen_ns", T.LongType(), False),
    T.StructField("last_seen_ns", T.LongType(), False),
])

RULE_ROW = T.StructType([
    T.StructField("keyword", T.StringType(), False),
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("level", T.StringType(), True),
    T.StructField("required_count", T.IntegerType(), True),
    T.StructField("total_samples", T.IntegerType(), True),
    T.StructField("window_seconds", T.LongType(), True),
    T.StructField("exclusion", T.StringType(), True),
    T.StructField("agg_interval_seconds", T.LongType(), True),
    T.StructField("note", T.StringType(), True),
])
