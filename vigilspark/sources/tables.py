"""Readers for the driver's parquet tables and the events -> log-entry mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.functions.columns import floor_div, ntz_micros, ts_to_ns


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_as_entries(events: DataFrame, keep=()) -> DataFrame:
    """Map ``events`` rows onto log entries.

    timestamp_ns = µs of ``ts`` (UTC) x 1000, seq = event_id,
    source = 'svc_' || user_id % 8, raw = event_type || ': ' || props,
    priority error 3 / purchase 5 / else 6, boot_id = 'boot_' || UTC date,
    monotonic_us = µs since that day's midnight.
    ``ts`` (TIMESTAMP_NTZ) is read as a UTC wall clock and all calendar
    fields come from integer arithmetic, so the session time zone does not
    matter.  Only projected columns are read from the parquet scan.
    """
    if events.schema["ts"].dataType.typeName() == "timestamp_ntz":
        us = ntz_micros("ts")
    else:
        us = F.unix_micros(F.col("ts"))
    day_us = 86_400 * 1_000_000
    base = events.select(
        *keep,
        us.alias("_us"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("svc_"), (F.col("user_id") % 8).cast("string")).alias("source"),
        F.concat(F.col("event_type"), F.lit(": "), F.col("props")).alias("raw"),
        F.when(F.col("event_type") == "error", 3)
         .when(F.col("event_type") == "purchase", 5)
         .otherwise(6).cast("int").alias("priority"))
    day = floor_div("_us", day_us)
    return base.select(
        *keep,
        (F.col("_us") * F.lit(1000)).alias("timestamp_ns"),
        "seq", "source", "raw", "priority",
        F.concat(F.lit("boot_"), F.date_format(F.date_from_unix_date(day.cast("int")), "yyyy-MM-dd")).alias("boot_id"),
        (F.col("_us") - day * F.lit(day_us)).alias("monotonic_us"))


def load_entries(spark: SparkSession, sf_dir: str, since_ns: int | None = None,
                 until_ns: int | None = None) -> DataFrame:
    """Entries of ``events``, optionally restricted to ``[since_ns, until_ns)``.

    The bounds are also stated on the raw ``ts`` column so that the parquet
    scan prunes row groups (a predicate on the derived ns column cannot be
    pushed); the exact ns filter is kept on top.
    """
    events = read_table(spark, sf_dir, "events")
    if since_ns is not None:
        events = events.filter(F.col("ts") >= _ntz_literal(since_ns))
    if until_ns is not None:
        events = events.filter(F.col("ts") < _ntz_literal(until_ns))
    out = events_as_entries(events)
    if since_ns is not None:
        out = out.filter(F.col("timestamp_ns") >= F.lit(int(since_ns)))
    if until_ns is not None:
        out = out.filter(F.col("timestamp_ns") < F.lit(int(until_ns)))
    return out


def _ntz_literal(ns: int):
    """UTC wall-clock literal (µs) of a ns instant, as TIMESTAMP_NTZ."""
    import datetime as dt
    us = int(ns) // 1000
    d = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)
    return F.lit(d.isoformat(sep=" ")).cast("timestamp_ntz")


def document_lines(documents: DataFrame) -> DataFrame:
    """S3 shape over ``documents``: one row per text line, whole texts.

    ``source`` is the document's source column, ``seq`` the line number
    inside the document, ``timestamp_ns`` unknown (null) as for flat files.
    """
    return (documents
            .select("doc_id", "source", F.posexplode(F.split(F.col("text"), "\n", -1)).alias("line_no", "raw"))
            .select("doc_id", "source", "line_no", "raw"))

__all__ = ["read_table", "events_as_entries", "load_entries", "document_lines", "ts_to_ns"]
