"""End-to-end jobs: history seeding (batch) and live monitoring (streaming).

``seed_job``: journal export -> entries -> hourly counts, keyword stats,
boot-window stats and confidence -> the state tables, written as one new
version folder; with an earlier version it goes on from there.
``monitor_job``: journal folder stream -> flags, and the sums that the same
tables are made of.  ``merge_live_job`` adds these sums to a version of the
tables, ``score_job`` scores the hours that closed.  ``close_job`` turns closed rollups into flags, moves old flags to the
archive and adds up the sums of many batches.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilspark.config import (AlertRules, DEFAULT_MIN_SAMPLES, DEFAULT_RETENTION_DAYS, DEFAULT_SENSITIVITY, MAX_BOOT_WINDOW_SECONDS,
                               MAX_TRACKED_BOOTS, NS_PER_DAY, NS_PER_SECOND)
from vigilspark.functions.columns import confidence, confidence_pct, monitoring_active, slot_key_ns
from vigilspark.operators import baseline, boot, match
from vigilspark.session import materialize
from vigilspark.sources import journal, store
from vigilspark.sources.versions import VersionedTable
from vigilspark.streaming import stream

#: Micro-batches read at most so many new files.
FILES_PER_TRIGGER = 64


def seed_job(spark: SparkSession, journal_path: str, out_path: str, rules: AlertRules, as_of_ns: int,
             boot_window_seconds: int = MAX_BOOT_WINDOW_SECONDS, boots_kept: int = MAX_TRACKED_BOOTS,
             previous: str | None = None, observed: DataFrame | None = None) -> DataFrame:
    """Seed (or continue) the baseline from a journal export.

    With ``previous`` (an earlier version folder) only records that it doesn't
    hold yet are added, whatever their time: seeding an export in parts, in
    any order, equals seeding it whole, and seeding it again changes nothing.
    A record that an export holds n times counts n times; of several exports,
    the one that holds it most often counts.  ``observed`` (start_ns, end_ns)
    adds to the time of direct observation.  Returns the one-row meta table.
    """
    good, _ = journal.split_rejects(journal.parse_lines(spark.read.text(journal_path)))
    entries = journal.journal_entries(good)
    old = store.load_baseline(spark, previous) if previous else None
    if old:
        entries = materialize(entries.groupBy(*entries.columns).agg(F.count(F.lit(1)).alias("n")))  # parsed once
        held = entries.select(*store.SEEN_KEYS, "n")
    else:
        entries = materialize(entries)
        held = _held_records(entries)
    days = store.seen_days(entries)
    if old:
        before = store.read_seen(spark, previous, days)  # only the days of this export
        if before is None:
            raise ValueError(f"{previous} doesn't tell which records it holds; seed again from the whole export")
        entries = entries.join(before.withColumnRenamed("n", "before"), store.SEEN_KEYS, "left") \
            .withColumn("n", F.col("n") - F.coalesce("before", F.lit(0))).where("n > 0").drop("before")
        held = held.unionByName(before)
    store.write_seen(spark, out_path, held.groupBy(*store.SEEN_KEYS).agg(F.max("n").alias("n")), days, previous)
    if old:
        entries = materialize(entries.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n", "copy"))
    hourly = entries.groupBy("source", F.expr("timestamp_ns - pmod(timestamp_ns, 3600000000000L)").alias("hour_ns")).agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp_ns").alias("earliest_ns"), F.max("timestamp_ns").alias("newest_ns"))
    hits = match.keyword_hits(entries, rules, keep=["source", "timestamp_ns"])
    kw = hits.groupBy("source", "keyword").agg(F.count(F.lit(1)).alias("hits"), F.max("timestamp_ns").alias("last_seen_ns"),
                                               F.min("timestamp_ns").alias("first_seen_ns"))
    boots = boot.boot_window_stats(entries, rules, boot_window_seconds)
    observed_ns = observed.agg(F.coalesce(F.sum(F.col("end_ns") - F.col("start_ns")), F.lit(0)).cast("long").alias("v")).first()[0] \
        if observed is not None else 0
    if old:
        hourly = hourly.unionByName(old["hourly"]).groupBy("source", "hour_ns").agg(
            F.sum("n").alias("n"), F.min("earliest_ns").alias("earliest_ns"), F.max("newest_ns").alias("newest_ns"))
        kw = kw.unionByName(old["keyword_first"]).groupBy("source", "keyword").agg(
            F.sum("hits").alias("hits"), F.max("last_seen_ns").alias("last_seen_ns"), F.min("first_seen_ns").alias("first_seen_ns"))
        boots = boot.merge_boot_stats(old["boot_stats"], boots)
        observed_ns += old["meta"].select("observed_ns").first()[0]
    hourly, kw = materialize(hourly), materialize(kw)  # small: sources by hours, sources by keywords
    base = baseline.slot_baseline(hourly.select("source", "hour_ns", "n").withColumn("slot_key", slot_key_ns("hour_ns")))
    return _save(spark, out_path, base, hourly, kw, boot.retained_boot_stats(boots, boots_kept), observed_ns, as_of_ns,
                 _live_batch(old) if old else -1)


def _held_records(entries: DataFrame) -> DataFrame:
    """(SEEN_KEYS, n): how often each record is there, told by its keys, a hash of all its columns and which of them are null; texts aren't shuffled."""
    nulls = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in entries.columns])
    told = entries.select(*store.SEEN_KEYS, F.xxhash64(*entries.columns).alias("_hash"), nulls.alias("_nulls"))
    # by SEEN_KEYS, by which they are added up next
    return told.repartition(*store.SEEN_KEYS).groupBy(*told.columns).agg(F.count(F.lit(1)).alias("n")).select(*store.SEEN_KEYS, "n")


def _live_batch(old: dict) -> int:
    """The last live batch that a version holds."""
    return old["meta"].first()["live_batch"] if "live_batch" in old["meta"].columns else -1


def _save(spark: SparkSession, out_path: str, base: DataFrame, hourly: DataFrame, kw: DataFrame, boots: DataFrame,
          observed_ns: int, as_of_ns: int, live_batch: int) -> DataFrame:
    """Write a version of the state tables; its one-row meta table."""
    ends = hourly.agg(F.min("earliest_ns").alias("earliest_ns"), F.max("newest_ns").alias("newest_ns"))
    days = ends.select("earliest_ns", "newest_ns", F.lit(int(observed_ns)).cast("long").alias("observed_ns"),
                       F.coalesce((F.lit(int(as_of_ns)) - F.col("earliest_ns")) / F.lit(float(NS_PER_DAY)), F.lit(0.0)).alias("seed_days"),
                       (F.lit(int(observed_ns)) / F.lit(float(NS_PER_DAY))).alias("direct_days"))
    meta = days.withColumn("confidence", confidence("seed_days", "direct_days")).select(
        kw.agg(F.coalesce(F.min("first_seen_ns"), F.lit(0)).alias("v")).scalar().alias("first_seen_ns"),
        "seed_days", "direct_days", "confidence", confidence_pct("confidence").alias("confidence_pct"),
        monitoring_active("confidence").alias("monitoring_active"), "earliest_ns", "newest_ns", "observed_ns",
        F.lit(int(live_batch)).cast("long").alias("live_batch"))
    store.save_baseline(out_path, base, kw, boots, meta, hourly)
    return spark.read.parquet(os.path.join(out_path, "meta"))


def merge_live_job(spark: SparkSession, state_dir: str, previous: str, out_path: str, as_of_ns: int,
                   boots_kept: int = MAX_TRACKED_BOOTS) -> DataFrame:
    """A version of the state tables that also holds what the live job counted since ``previous``.

    ``previous`` names the last batch that it holds; the batches behind it that
    all tables of sums have are added, each once, however often this runs.
    Hours are summed anew, so a late row changes its hour's sample, and only the
    (source, slot) pairs with new rows get their mean and spread worked out
    again.  Observed time and confidence grow with the batches.
    """
    names = ("hourly", "keyword_stats", "boot_stats", "observed", "seen")
    old = store.load_baseline(spark, previous)
    after = _live_batch(old)
    tables = {n: VersionedTable(spark, os.path.join(state_dir, n)) for n in names}
    upto = min(t.current().marks.get("batch", -1) for t in tables.values())
    new = {}
    for name, table in tables.items():
        folders = [f for f in stream.batch_folders(table, after)[0] if stream.folder_batches(f)[0] <= upto]
        if any(stream.folder_batches(f)[1] > upto for f in folders):
            raise ValueError(f"{table.path}: a folder goes over batch {upto}, which other tables don't have yet")
        new[name] = stream.added_up(table.read(stream.schema_of(name), folders=folders), name)
    fresh = materialize(new["hourly"])
    hourly = materialize(stream.added_up(old["hourly"].unionByName(fresh), "hourly"))
    kw = materialize(stream.added_up(old["keyword_first"].unionByName(new["keyword_stats"]), "keyword_stats"))
    boots = boot.retained_boot_stats(boot.merge_boot_stats(old["boot_stats"], new["boot_stats"]), boots_kept)
    records = materialize(new["seen"])
    days = store.seen_days(records)
    store.write_seen(spark, out_path, stream.added_up(records.unionByName(store.read_seen(spark, previous, days)), "seen"), days, previous)
    touched = fresh.select("source", slot_key_ns("hour_ns").alias("slot_key")).distinct()
    again = hourly.select("source", "hour_ns", "n").withColumn("slot_key", slot_key_ns("hour_ns")).join(touched, ["source", "slot_key"], "left_semi")
    base = old["baseline"].join(touched, ["source", "slot_key"], "left_anti").unionByName(
        baseline.slot_baseline(again).select(*old["baseline"].columns))
    observed_ns = old["meta"].first()["observed_ns"] + new["observed"].agg(
        F.coalesce(F.sum(F.col("end_ns") - F.col("start_ns")), F.lit(0)).cast("long")).first()[0]
    return _save(spark, out_path, base, hourly, kw, boots, observed_ns, as_of_ns, max(upto, after))


#: What ``score_job`` keeps of an hour.
SCORED = "source string, hour_ns long, slot_key string, n long, samples long, mean double, stddev double, anomalous boolean"


def score_job(spark: SparkSession, state_dir: str, baseline_path: str, as_of_ns: int, grace_seconds: int = 3600,
              min_samples: int = DEFAULT_MIN_SAMPLES, sensitivity: float = DEFAULT_SENSITIVITY) -> DataFrame:
    """D2 live: score the hours that closed since the last pass against the baseline version in force; all scored hours.

    An hour closes ``grace_seconds`` after its end, and is scored once, with
    all its rows that came until then; a later row no longer changes it.
    Scored hours lie in a table with versions, whose mark says up to where
    they go, so a pass that failed is simply run again.
    """
    table = VersionedTable(spark, os.path.join(state_dir, "scored"))
    schema = T.StructType.fromDDL(SCORED)
    hour = 3600 * NS_PER_SECOND
    closing = (int(as_of_ns) - int(grace_seconds) * NS_PER_SECOND) // hour * hour
    upto = table.current().marks.get("upto")
    if upto is None or closing > upto:
        hours = stream.hourly_state(spark, state_dir).where(F.col("hour_ns") < closing)
        hours = hours if upto is None else hours.where(F.col("hour_ns") >= upto)
        state = store.load_baseline(spark, baseline_path)
        scored = baseline.anomaly_scored(hours, state["baseline"], state["meta"], min_samples, sensitivity)
        scored = scored.withColumn("samples", F.coalesce("samples", F.lit(0)).cast("long")).select(*schema.fieldNames())
        table.append(scored, marks={"upto": closing})
    return table.read(schema)


def monitor_job(spark: SparkSession, journal_dir: str, state_dir: str, rules: AlertRules, anchor_ns: int,
                trigger: dict | None = None, boot_window_seconds: int = MAX_BOOT_WINDOW_SECONDS,
                pauses: DataFrame | None = None, files_per_trigger: int = FILES_PER_TRIGGER):
    """Start the live queries; returns the list of StreamingQuery handles.

    ``trigger`` defaults to a 10-second processing-time tick (the original
    tool's status tick); tests pass ``{"availableNow": True}``.  Alerts run
    on the block fold, whose state is a table named by batch: a replayed
    micro-batch counts the same hits and flags nothing twice.
    """
    trigger = trigger or {"processingTime": "10 seconds"}
    paths = {name: os.path.join(state_dir, name) for name in ("flags", "held", "archive", "cleared")}
    parsed = journal.read_parsed_stream(spark, journal_dir, files_per_trigger)
    sink = stream.block_alert_sink(paths["flags"], paths["held"], rules, (paths["archive"], paths["cleared"]), pauses)
    alerts = (journal.live_entries(parsed).writeStream.outputMode("append").foreachBatch(sink)
              .option("checkpointLocation", os.path.join(state_dir, "_ck_flags")).trigger(**trigger).start())
    sums = (parsed.writeStream.outputMode("append")
            .foreachBatch(stream.state_sink(state_dir, rules, anchor_ns, boot_window_seconds, pauses))
            .option("checkpointLocation", os.path.join(state_dir, "_ck_state")).trigger(**trigger).start())
    return [alerts, sums]


def close_job(spark: SparkSession, state_dir: str, as_of_ns: int, retention_days: int = DEFAULT_RETENTION_DAYS,
              folded_upto: int = -1) -> dict:
    """The periodic pass: rollups that ended become flags of the same table
    (once each), flags older than ``retention_days`` move to the archive, and
    the sums of many batches become one folder.

    The live table goes on under its name with a new version, so the live job
    and the next pass see what this one did; flags appended meanwhile stay.
    ``folded_upto`` is the last batch that a stored baseline holds: sums aren't
    added up over it."""
    live, archive = os.path.join(state_dir, "flags"), os.path.join(state_dir, "archive")
    known = store.dedup_keys(spark, live, archive, os.path.join(state_dir, "cleared"))
    fresh = materialize(stream.closed_rollups(spark, state_dir, as_of_ns).join(known, ["timestamp_ns", "pattern_key"], "left_anti"))
    if not fresh.isEmpty():
        store.append_flags(fresh, live)
    archived = store.archive_live(spark, live, archive, as_of_ns, retention_days)
    return {"live": live, "archived": archived, "compacted": stream.compact_sums(spark, state_dir, folded_upto)}


def journal_export(events: DataFrame) -> DataFrame:
    """Journal JSON lines derived from the driver's ``events`` table (used to
    exercise the jobs on real data), blank and broken lines included."""
    from vigilspark.plans.catalogue import journal_fixture
    return journal_fixture(events).select("value")
