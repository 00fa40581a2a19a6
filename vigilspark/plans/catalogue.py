"""The query catalogue: every operator of the engine as a named query over
the driver's tables (whole tables, whole texts).

Each function takes ``(spark, sf_dir)`` and returns a DataFrame; the
matching DuckDB SQL lives in :mod:`vigilspark.plans.oracle`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.config import AlertRules, NS_PER_DAY, NS_PER_SECOND
from vigilspark.functions.columns import floor_div
from vigilspark.operators import alerts, baseline, boot, flags, match, report, retention, rollup, threshold
from vigilspark.operators.rules import rule_coverage
from vigilspark.operators.rules_table import table_hits
from vigilspark.session import checkpoint_dir, materialize
from vigilspark.plans import params as P
from vigilspark.sources import journal, store
from vigilspark.sources.arrival import ArrivalCursor
from vigilspark.sources.tables import document_lines, events_as_entries, load_entries, read_table


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_entries(read_table(spark, sf_dir, "events"))


def _r6(c: str):
    return F.round(F.col(c), 6).alias(c)


# --- sources / projections --------------------------------------------------

def q_log_entries(spark, sf_dir):
    return _entries(spark, sf_dir)


def journal_fixture(events: DataFrame) -> DataFrame:
    """Journal JSON lines built from ``events`` with some rows broken on
    purpose: blank line (k 0), cut JSON (k 1), non-numeric timestamp (k 2),
    missing unit (k 3), missing message (k 4), non-integer priority (k 5)."""
    # one projection of events: the entry columns plus the props they came from
    e = events_as_entries(events, keep=["props"])
    k = F.col("props")
    us = floor_div("timestamp_ns", 1000).cast("string")
    js = F.to_json(F.struct(
        F.when(k == '{"k": 2}', F.concat(F.lit("x"), us)).otherwise(us).alias("__REALTIME_TIMESTAMP"),
        F.col("monotonic_us").cast("string").alias("__MONOTONIC_TIMESTAMP"),
        F.col("boot_id").alias("_BOOT_ID"),
        F.when(k == '{"k": 3}', F.lit(None)).otherwise(F.concat("source", F.lit(".service"))).alias("_SYSTEMD_UNIT"),
        F.col("source").alias("SYSLOG_IDENTIFIER"),
        F.when(k == '{"k": 4}', F.lit(None)).otherwise(F.col("raw")).alias("MESSAGE"),
        F.when(k == '{"k": 5}', F.lit("x")).otherwise(F.col("priority").cast("string")).alias("PRIORITY")))
    value = (F.when(k == '{"k": 0}', F.lit(""))
             .when(k == '{"k": 1}', F.substring(js, 1, 20))
             .otherwise(js))
    return e.select("seq", value.alias("value"))


def q_journal_parse(spark, sf_dir):
    lines = journal_fixture(read_table(spark, sf_dir, "events"))
    good, _ = journal.split_rejects(journal.parse_lines(lines))
    return journal.journal_entries(good, keep=["seq"])


def q_journal_alerts(spark, sf_dir):
    """The alert pipeline over the parsed journal export.  As in the original
    tool every journal row has source 'journalctl', so each keyword is a
    single hot pattern key holding all its hits."""
    lines = journal_fixture(read_table(spark, sf_dir, "events"))
    good, _ = journal.split_rejects(journal.parse_lines(lines))
    return alerts.alert_pipeline(journal.journal_entries(good, keep=["seq"]), P.RULES)


def q_reject_split(spark, sf_dir):
    lines = journal_fixture(read_table(spark, sf_dir, "events"))
    return journal.reject_counts(journal.parse_lines(lines))


# --- keywords ----------------------------------------------------------------

def q_keyword_hits(spark, sf_dir):
    return match.keyword_hits(_entries(spark, sf_dir), P.RULES, keep=["seq", "timestamp_ns", "source"])


def q_keyword_stats(spark, sf_dir):
    return match.keyword_stats(match.keyword_hits(_entries(spark, sf_dir), P.RULES,
                                                  keep=["source", "timestamp_ns"]))


def q_keyword_first_seen(spark, sf_dir):
    return match.first_seen(match.keyword_hits(_entries(spark, sf_dir), P.RULES, keep=["timestamp_ns"]))


def q_source_list(spark, sf_dir):
    e = _entries(spark, sf_dir)
    b = baseline.slot_baseline(baseline.hourly_counts(e))
    ks = match.keyword_stats(match.keyword_hits(e, P.RULES, keep=["source", "timestamp_ns"]))
    return match.source_list(b, ks)


def q_line_keyword_hits(spark, sf_dir):
    """Flat-text lines of ``documents`` matched against the document keywords."""
    lines = document_lines(read_table(spark, sf_dir, "documents"))
    rules = AlertRules(watched=P.DOC_KEYWORDS, critical=[])
    words = rules.active_keywords
    hits = match.keyword_hits(lines.select("doc_id", "source", "raw"),
                              AlertRules(watched=words, critical=[]), keep=["doc_id", "source"])
    return (hits.groupBy("source", "keyword")
            .agg(F.count(F.lit(1)).alias("line_hits"),
                 F.countDistinct("doc_id").alias("doc_hits")))


# --- baseline and anomalies ------------------------------------------------

def q_hourly_counts(spark, sf_dir):
    return baseline.hourly_counts(_entries(spark, sf_dir))


def q_slot_baseline(spark, sf_dir):
    b = baseline.with_stddev(baseline.slot_baseline(baseline.hourly_counts(_entries(spark, sf_dir))))
    return b.select("source", "slot_key", "count", _r6("mean"), _r6("m2"), _r6("stddev"))


def q_baseline_merge(spark, sf_dir):
    first = baseline.slot_baseline(baseline.hourly_counts(load_entries(spark, sf_dir, until_ns=P.MERGE_SPLIT_NS)))
    second = baseline.slot_baseline(baseline.hourly_counts(load_entries(spark, sf_dir, since_ns=P.MERGE_SPLIT_NS)))
    m = baseline.merge_baselines(first, second)
    return m.select("source", "slot_key", "count", _r6("mean"), _r6("m2"))


def q_anomaly_online(spark, sf_dir):
    a = baseline.anomaly_online(baseline.hourly_counts(_entries(spark, sf_dir)),
                                P.ANOMALY_MIN_SAMPLES, P.ANOMALY_SENSITIVITY)
    return a.select("source", "hour_ns", "slot_key", "n", "prior_samples",
                    _r6("prior_mean"), _r6("prior_stddev"), "anomalous")


def q_anomaly_scored(spark, sf_dir):
    """Train on the weeks before TRAIN_END, score the hours after it."""
    train_e = load_entries(spark, sf_dir, until_ns=P.TRAIN_END_NS)
    test_e = load_entries(spark, sf_dir, since_ns=P.TRAIN_END_NS)
    b = baseline.slot_baseline(baseline.hourly_counts(train_e))
    conf = baseline.confidence_report(
        baseline.seed_days(train_e, P.TRAIN_END_NS),
        baseline.direct_observation_days(_observation_log(train_e)))
    s = baseline.anomaly_scored(baseline.hourly_counts(test_e), b, conf,
                                P.ANOMALY_MIN_SAMPLES, P.ANOMALY_SENSITIVITY)
    return s.select("source", "hour_ns", "slot_key", "n", F.coalesce("samples", F.lit(0)).alias("samples"),
                    _r6("mean"), _r6("stddev"), "anomalous")


def _observation_log(entries: DataFrame) -> DataFrame:
    """One observed interval per UTC day: first to last entry of that day."""
    return (entries.groupBy("boot_id")
            .agg(F.min("timestamp_ns").alias("start_ns"), F.max("timestamp_ns").alias("end_ns")))


def _confidence(e: DataFrame) -> DataFrame:
    return baseline.confidence_report(baseline.seed_days(e, P.AS_OF_NS),
                                      baseline.direct_observation_days(_observation_log(e)))


def q_confidence_report(spark, sf_dir):
    c = _confidence(_entries(spark, sf_dir))
    return c.select(_r6("seed_days"), _r6("direct_days"), _r6("confidence"), "confidence_pct", "monitoring_active")


def q_status_report(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return report.status_report(_buffer_entries(spark, sf_dir), _confidence(e), _pipeline(e))


# --- alerts -------------------------------------------------------------------

def _pipeline(e: DataFrame, levels=None, keywords=None) -> DataFrame:
    return alerts.alert_pipeline(e, P.RULES, levels=levels, keywords=keywords)


def q_triage_alerts(spark, sf_dir):
    return alerts.with_alert_line(_pipeline(_entries(spark, sf_dir), levels=["TRIAGE"]))


def q_pattern_watch_alerts(spark, sf_dir):
    e = _entries(spark, sf_dir)
    rules = P.RULES
    standard = [k for k in rules.active_keywords
                if k not in rules.critical_keywords and k not in rules.noisy]
    return _pipeline(e, levels=["PATTERN_WATCH"], keywords=standard)


def q_noisy_alerts(spark, sf_dir):
    return _pipeline(_entries(spark, sf_dir), levels=["PATTERN_WATCH"], keywords=list(P.RULES.noisy))


def q_correlation_alerts(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return alerts.correlation_alerts(e, P.RULES, P.RULES.correlation[0])


def q_correlation_span_alerts(spark, sf_dir):
    """T6 with the documented intent: the retained hits must come from at
    least two of the group's sources."""
    import dataclasses
    g = dataclasses.replace(P.RULES.correlation[0], min_distinct_sources=2)
    return alerts.correlation_alerts(_entries(spark, sf_dir), P.RULES, g)


def q_alert_pipeline(spark, sf_dir):
    return _pipeline(_entries(spark, sf_dir))


def q_error_alerts_1h(spark, sf_dir):
    """The extra case: 3 of 5 within 3600 s for ``error`` without exclusion."""
    rules = AlertRules(watched=["error"], critical=[])
    return alerts.single_threshold_alerts(_entries(spark, sf_dir), rules, "error", P.EXTRA_THRESHOLD)


def q_window_hit_count(spark, sf_dir):
    e = _entries(spark, sf_dir)
    hits = match.keyword_hits(e, P.RULES, keep=["timestamp_ns", "seq", "source"])
    hits = hits.filter(F.col("keyword") == "error").select(
        "timestamp_ns", "seq", F.concat_ws(":", "source", "keyword").alias("pattern_key"))
    return threshold.window_hit_count(hits, P.HIT_WINDOW_SECONDS, ("pattern_key",))


def _daily_resets(hits: DataFrame) -> DataFrame:
    """Reset every pattern key at the start of each UTC day it has hits on."""
    return (hits.select("pattern_key", "level", (floor_div("timestamp_ns", NS_PER_DAY) * F.lit(NS_PER_DAY)).alias("at_ns"))
            .distinct())


def q_pattern_reset(spark, sf_dir):
    """Standard threshold for ``error`` with every key reset at the start of
    each UTC day it has hits on."""
    e = _entries(spark, sf_dir)
    rules = P.RULES
    hits = match.keyword_hits(e, rules, keep=list(alerts.PAYLOAD))
    hits = alerts.stored_hits(hits.filter(F.col("keyword") == "error").select(
        *alerts.PAYLOAD, F.concat_ws(":", "source", "keyword").alias("pattern_key"),
        F.lit("PATTERN_WATCH").alias("level")))
    keyed = hits.select("pattern_key", "level", "timestamp_ns", "seq", "rid")
    fires = threshold.threshold_fires(keyed, rules.thresholds["PATTERN_WATCH"], ("pattern_key", "level"),
                                      resets=_daily_resets(keyed))
    return alerts.flagged_rows(fires.withColumn("note", F.lit(rules.tier_of("error")[2])), hits)


def q_aggregate_rollup(spark, sf_dir):
    return rollup.aggregate_rollup(_entries(spark, sf_dir), P.RULES, P.AGG_ANCHOR_NS)


# --- boot windows -------------------------------------------------------------

def _boot_stats(spark, sf_dir):
    return boot.boot_window_stats(_entries(spark, sf_dir), P.RULES, P.BOOT_WINDOW_SECONDS)


def q_boot_window_stats(spark, sf_dir):
    return _boot_stats(spark, sf_dir)


def q_boot_retained(spark, sf_dir):
    return boot.retained_boot_stats(_boot_stats(spark, sf_dir), P.BOOTS_KEPT)


def q_boot_summary(spark, sf_dir):
    return boot.boot_summary(_boot_stats(spark, sf_dir))


# --- buffer / retention -----------------------------------------------------------

def _buffer_entries(spark, sf_dir):
    cutoff = P.AS_OF_NS - P.RETENTION_HOURS * 3600 * 10**9
    return retention.rolling_window(load_entries(spark, sf_dir, since_ns=cutoff), P.AS_OF_NS, P.RETENTION_HOURS)


def q_rolling_window(spark, sf_dir):
    return _buffer_entries(spark, sf_dir)


def q_capped_buffer(spark, sf_dir):
    return retention.capped_buffer(_buffer_entries(spark, sf_dir), P.BUFFER_CAP)


def q_incremental_batch(spark, sf_dir):
    e = _entries(spark, sf_dir)
    hwm = e.filter(F.col("timestamp_ns") < P.INCREMENTAL_HWM_BEFORE_NS).agg(F.max("seq"))
    return retention.incremental_batch(e, hwm).select("seq", "timestamp_ns", "source")


def q_pause_filtered(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return retention.pause_filtered(e, retention.pause_frame(spark, P.PAUSES)).select("seq", "timestamp_ns", "source")


# --- flag table ---------------------------------------------------------------------

def q_flag_query(spark, sf_dir):
    return flags.flag_query(_pipeline(_entries(spark, sf_dir)), level="PATTERN_WATCH", since_ns=P.FLAG_SINCE_NS)


def q_flag_counts(spark, sf_dir):
    return flags.flag_counts(_pipeline(_entries(spark, sf_dir)))


def q_flag_archive_split(spark, sf_dir):
    return flags.flag_archive_split(_pipeline(_entries(spark, sf_dir)), P.AS_OF_NS, P.ARCHIVE_DAYS)


def q_flag_clear(spark, sf_dir):
    return flags.flag_clear(_pipeline(_entries(spark, sf_dir)), level="TRIAGE")


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def q_flag_store_roundtrip(spark, sf_dir):
    """S5 + F7: pipeline flags appended to the date-partitioned store, read
    back for one level since a date (partition pruning + pushed filter)."""
    path = _scratch(spark, "flags")
    store.write_flags(_pipeline(_entries(spark, sf_dir)), path)
    return store.read_flags(spark, path, since_ns=P.FLAG_SINCE_NS, level="PATTERN_WATCH")


def q_buffer_snapshot_load(spark, sf_dir):
    """The 48 h buffer written as JSON lines and loaded again one day
    later: rows that expired in between are discarded on load."""
    path = _scratch(spark, "buffer")
    store.write_buffer(_buffer_entries(spark, sf_dir), path)
    good, _ = store.read_buffer(spark, path, P.AS_OF_NS + P.SNAPSHOT_LOAD_DELAY_NS, P.RETENTION_HOURS)
    return good


def q_history_seed(spark, sf_dir):
    """The journal export of ``events`` seeded into the four state
    tables (written to the checkpoint folder); the stored meta row plus the
    sizes of the stored baseline and keyword tables."""
    from vigilspark.plans.jobs import journal_export, seed_job
    src = _scratch(spark, "journal")
    journal_export(read_table(spark, sf_dir, "events")).write.text(src)
    out = _scratch(spark, "seed")
    meta = seed_job(spark, src, out, P.RULES, P.AS_OF_NS, boot_window_seconds=P.BOOT_WINDOW_SECONDS)
    state = store.load_baseline(spark, out)
    return meta.select(
        "first_seen_ns", _r6("seed_days"), _r6("direct_days"), _r6("confidence"), "confidence_pct",
        "monitoring_active",
        state["baseline"].agg(F.count(F.lit(1))).scalar().alias("baseline_rows"),
        state["baseline"].agg(F.sum("count")).scalar().alias("hour_samples"),
        state["keyword_stats"].agg(F.count(F.lit(1))).scalar().alias("keyword_rows"))


def q_correlation_three_sources(spark, sf_dir):
    """T6 over more than two sources: the retained hits must come from all three."""
    return alerts.correlation_alerts(_entries(spark, sf_dir), P.RULES, P.THREE_SOURCES)


def q_dedup_rerun(spark, sf_dir):
    """T5: the whole input once more after its first half was flagged, with every
    fifth entry repeated at the same time."""
    e = _entries(spark, sf_dir)
    again = e.unionByName(e.where("seq % 5 = 0").withColumn("seq", F.col("seq") + 1_000_000_000))
    prior = materialize(_pipeline(again.where(F.col("timestamp_ns") < P.MERGE_SPLIT_NS)))
    return alerts.alert_pipeline(again, P.RULES, prior_flags=prior)


def q_mixed_source_alerts(spark, sf_dir):
    """S4 + T9: the journal and the lines of ``documents`` as text files, whose
    lines all bear their file's time, in one alert pipeline."""
    lines = journal_fixture(read_table(spark, sf_dir, "events"))
    good, _ = journal.split_rejects(journal.parse_lines(lines))
    text = document_lines(read_table(spark, sf_dir, "documents")).select(
        (F.lit(P.AGG_ANCHOR_NS) + F.expr("doc_id div 3") * NS_PER_SECOND).alias("timestamp_ns"),
        (F.col("doc_id") * 1048576 + F.col("line_no")).alias("seq"), F.concat("source", F.lit(".log")).alias("source"), "raw")
    return alerts.alert_pipeline(store.union_sources(journal.journal_entries(good, keep=["seq"]), text), P.MIXED_RULES)


def _flag_table(spark, sf_dir) -> str:
    """A stored flag table of the pipeline's flags."""
    path = _scratch(spark, "flags")
    store.write_flags(_pipeline(_entries(spark, sf_dir)), path)
    return path


def q_flag_table_counts(spark, sf_dir):
    """A10: alerts and AGGREGATE summaries in one stored table, counted by level."""
    path = _flag_table(spark, sf_dir)
    store.write_flags(rollup.aggregate_rollup(_entries(spark, sf_dir), P.RULES, P.AGG_ANCHOR_NS), path)
    return flags.flag_counts(flags.flag_listing(store.read_flags(spark, path)))


def q_archive_move(spark, sf_dir):
    """M3 over a stored table: what is live and what is archived afterwards, and how many flags moved."""
    live, archive, after = _flag_table(spark, sf_dir), _scratch(spark, "archive"), _scratch(spark, "flags")
    moved = store.archive_flags(spark, live, archive, after, P.AS_OF_NS, P.ARCHIVE_DAYS)
    both = store.read_flags(spark, archive).withColumn("destination", F.lit("archive")).unionByName(
        store.read_flags(spark, after).withColumn("destination", F.lit("live")))
    return both.withColumn("moved", F.lit(moved).cast("long"))


def q_clear_rewrite(spark, sf_dir):
    """M2 over a stored table: the flags that remain, and how many were removed."""
    live, after = _flag_table(spark, sf_dir), _scratch(spark, "flags")
    removed = store.clear_flags(spark, live, after, level="TRIAGE")
    return store.read_flags(spark, after).withColumn("removed", F.lit(removed).cast("long"))


def q_seed_in_two_parts(spark, sf_dir):
    """The journal seeded up to a day with a third of the later rows, then all of it, so that many of the
    second part's rows are late or tied; the contents of all state tables."""
    from vigilspark.plans.jobs import journal_export, seed_job
    events, version = read_table(spark, sf_dir, "events"), None
    whole = _scratch(spark, "journal")
    until = F.timestamp_micros(F.lit(P.MERGE_SPLIT_NS // 1000)).cast("timestamp_ntz")
    journal_export(events.where((F.col("ts") < until) | (F.pmod(F.xxhash64(*events.columns), F.lit(3)) == 0))).write.text(whole)
    for part in range(2):
        if part:  # the second export holds everything, the part seen before included
            whole = _scratch(spark, "journal")
            journal_export(events).write.text(whole)
        out = _scratch(spark, "seed")
        seed_job(spark, whole, out, P.RULES, P.AS_OF_NS, boot_window_seconds=P.BOOT_WINDOW_SECONDS, previous=version)
        version = out
    return _state_rows(store.load_baseline(spark, version))


def _state_rows(state: dict) -> DataFrame:
    """Contents of all state tables in one layout."""
    long0, none = F.lit(0).cast("long"), F.lit(0.0)
    return (state["baseline"].select(F.lit("baseline").alias("kind"), F.col("slot_key").alias("a"), F.col("source").alias("b"),
                                     F.col("count").alias("n"), F.round("mean", 6).alias("x"), long0.alias("t"))
            .unionByName(state["keyword_stats"].select(F.lit("keyword").alias("kind"), F.col("source").alias("a"), F.col("keyword").alias("b"),
                                                       F.col("hits").alias("n"), none.alias("x"), F.col("last_seen_ns").alias("t")))
            .unionByName(state["boot_stats"].select(F.lit("boot").alias("kind"), F.col("boot_id").alias("a"), F.col("keyword").alias("b"),
                                                    F.col("hits").alias("n"), none.alias("x"), F.col("first_seen_ns").alias("t")))
            .unionByName(state["meta"].select(F.lit("meta").alias("kind"), F.lit("").alias("a"), F.lit("").alias("b"), long0.alias("n"),
                                              F.round("seed_days", 6).alias("x"), F.col("first_seen_ns").alias("t"))))


# --- arrival, versions, live tables ------------------------------------------------

def _journal_files(spark, lines: DataFrame, path: str, at_s: int) -> None:
    """Write journal lines in order of ``seq`` to files whose times rise with their names, as a log shipper leaves them."""
    lines.repartitionByRange("seq").sortWithinPartitions("seq").select("value").write.mode("append").text(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    found = sorted((f.getPath().getName(), f.getModificationTime(), f.getPath()) for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    for i, (_, at_ms, file) in enumerate(f for f in found if f[1] >= P.FIXTURE_FILES_BEFORE_MS):
        fs.setTimes(file, (at_s + i) * 1000, -1)


def _split_journal(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Journal lines of events before and from MERGE_SPLIT on."""
    events = read_table(spark, sf_dir, "events")
    until = F.timestamp_micros(F.lit(P.MERGE_SPLIT_NS // 1000)).cast("timestamp_ntz")
    return journal_fixture(events.where(F.col("ts") < until)), journal_fixture(events.where(F.col("ts") >= until))


def _two_passes(spark, sf_dir):
    """The journal taken in two passes, files added in between: the entries of both."""
    path, cursor = _scratch(spark, "journal"), ArrivalCursor(spark, _scratch(spark, "cursor"))
    passes = []
    for lines, at_s in zip(_split_journal(spark, sf_dir), (1_000_000, 2_000_000)):
        _journal_files(spark, lines, path, at_s)
        fresh, _, commit = journal.new_entries(spark, path, cursor)
        passes.append(fresh)
        commit()
    fresh, _, _ = journal.new_entries(spark, path, cursor)
    return passes[0], passes[1].unionByName(fresh)


def q_journal_incremental(spark, sf_dir):
    """S1 + R4: what a second pass over a journal folder takes, files added since, and a third one (nothing), numbered by arrival."""
    return _two_passes(spark, sf_dir)[1]


def q_journal_capped(spark, sf_dir):
    """R2 over journal files: the newest entries by arrival of both passes."""
    first, second = _two_passes(spark, sf_dir)
    return retention.capped_buffer(first.unionByName(second), P.BUFFER_CAP)


def q_text_log_lines(spark, sf_dir):
    """S3: the lines of ``documents`` as flat log files, taken by two passes of a cursor, the second after more files came:
    every line, how often it is there, and how many numbers its copies got."""
    path, cursor, parts = _scratch(spark, "text"), ArrivalCursor(spark, _scratch(spark, "cursor")), []
    lines = document_lines(read_table(spark, sf_dir, "documents"))
    for rest in range(2):
        lines.where(F.pmod("doc_id", F.lit(2)) == rest).select("raw").write.mode("append").text(path)
        fresh, commit = store.new_text_lines(spark, path, cursor)
        parts.append(fresh)
        commit()
    both = parts[0].unionByName(parts[1])
    return both.groupBy("raw").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("seq").alias("numbers"))


def q_archive_live(spark, sf_dir):
    """M3 on the live table: its folders appended as micro-batches, one of them replayed, two archive passes."""
    live, archive = _scratch(spark, "flags"), _scratch(spark, "archive")
    rows = materialize(_pipeline(_entries(spark, sf_dir)))
    for batch in (0, 1, 1):
        store.append_flags(rows.where(F.pmod(F.hash("pattern_key", "timestamp_ns"), F.lit(2)) == batch), live, "alerts", batch)
    moved = sum(store.archive_live(spark, live, archive, P.AS_OF_NS, P.ARCHIVE_DAYS) for _ in range(2))
    both = store.read_flags(spark, archive).withColumn("destination", F.lit("archive")).unionByName(
        store.read_flags(spark, live).withColumn("destination", F.lit("live")))
    return both.withColumn("moved", F.lit(moved).cast("long"))


def q_anomaly_two_parts(spark, sf_dir):
    """D3 over runs: the hours before a day scored from nothing, those after it from the state that the first left."""
    first = baseline.hourly_counts(load_entries(spark, sf_dir, until_ns=P.MERGE_SPLIT_NS))
    second = baseline.hourly_counts(load_entries(spark, sf_dir, since_ns=P.MERGE_SPLIT_NS))
    kept = materialize(baseline.slot_baseline(first))
    args = (P.ANOMALY_MIN_SAMPLES, P.ANOMALY_SENSITIVITY)
    both = baseline.anomaly_continued(first, kept.limit(0), *args).unionByName(baseline.anomaly_continued(second, kept, *args))
    return both.select("source", "hour_ns", "slot_key", "n", "prior_samples", _r6("prior_mean"), _r6("prior_stddev"), "anomalous")


def q_live_anomalies(spark, sf_dir):
    """D2 live: hours of two live stretches scored in two passes against a seeded baseline; the second stretch brings late rows
    of hours that the first pass left open."""
    from vigilspark.plans.jobs import score_job, seed_job
    from vigilspark.streaming.stream import state_sink
    before, later = _split_journal(spark, sf_dir)
    src, version, state = (_scratch(spark, n) for n in ("journal", "seed", "live"))
    before.select("value").write.text(src)
    seed_job(spark, src, version, P.RULES, P.AS_OF_NS, boot_window_seconds=P.BOOT_WINDOW_SECONDS)
    good, _ = journal.split_rejects(journal.parse_lines(later))
    rows = materialize(journal.journal_entries(good))
    at, day = F.col("timestamp_ns"), P.TRAIN_END_NS - NS_PER_DAY
    early = (at < day) | ((at < P.TRAIN_END_NS) & (F.pmod(F.xxhash64("seq"), F.lit(3)) > 0))
    sink = state_sink(state, P.RULES, P.AGG_ANCHOR_NS, P.BOOT_WINDOW_SECONDS)
    for batch, (part, as_of) in enumerate(((early, day), (~early, P.AS_OF_NS + NS_PER_DAY))):
        sink(rows.where(part), batch)
        scored = score_job(spark, state, version, as_of, 0, P.ANOMALY_MIN_SAMPLES, P.ANOMALY_SENSITIVITY)
    return scored.select("source", "hour_ns", "slot_key", "n", "samples", _r6("mean"), _r6("stddev"), "anomalous")


def _timed_lines(lines: DataFrame) -> DataFrame:
    """(value, late): live lines but for those of bad time, which would get the time of this run, and whether they are of the later stretch.

    A conditional ``explode``, as in ``split_rejects``: a filter would be pushed below the projection that makes the lines, and
    make each of them several times."""
    cut = F.expr(f"get_json_object(value, '$.__REALTIME_TIMESTAMP') >= '{P.TRAIN_END_NS // 1000}'")
    row = F.struct("value", F.coalesce(cut, F.lit(False)).alias("late"))
    kept = F.when(~F.col("value").contains('"__REALTIME_TIMESTAMP":"x'), row)
    return lines.select(F.explode(F.array_compact(F.array(kept))).alias("_r")).select("_r.value", "_r.late")


def q_live_baseline_merge(spark, sf_dir):
    """A baseline seeded from the journal up to a day, and the live sums of two later stretches folded into it:
    the contents of all state tables, and the time observed."""
    from vigilspark.plans.jobs import merge_live_job, seed_job
    from vigilspark.streaming.stream import compact_sums, state_sink
    before, later = _split_journal(spark, sf_dir)
    src, version, state, folder = (_scratch(spark, n) for n in ("journal", "seed", "live", "incoming"))
    before.select("value").write.text(src)
    seed_job(spark, src, version, P.RULES, P.AS_OF_NS, boot_window_seconds=P.BOOT_WINDOW_SECONDS)
    timed = materialize(_timed_lines(later))
    for part in (timed.where(~F.col("late")), timed.where("late")):
        part.select("value").write.mode("append").text(folder)
        (journal.read_journal_stream(spark, folder).writeStream.foreachBatch(state_sink(state, P.RULES, P.AGG_ANCHOR_NS, P.BOOT_WINDOW_SECONDS))
         .option("checkpointLocation", state + "/_ck").trigger(availableNow=True).start().awaitTermination())
        merged = _scratch(spark, "seed")
        merge_live_job(spark, state, version, merged, P.AS_OF_NS)
        version = merged
    compact_sums(spark, state, at_least=2)
    tables = store.load_baseline(spark, version)
    return _state_rows(tables).unionByName(tables["meta"].select(
        F.lit("observed").alias("kind"), F.lit("").alias("a"), F.lit("").alias("b"), F.lit(0).cast("long").alias("n"),
        F.round("confidence", 6).alias("x"), F.col("observed_ns").alias("t")))


# --- rules --------------------------------------------------------------------------

def q_rules_table_hits(spark, sf_dir):
    """F2 + F3 with a rules table: every word of ``benchmark`` is a keyword, long ones barred by a shorter one, over all lines of ``documents``."""
    words = read_table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("keyword")).where("length(keyword) > 2")
    rules = words.distinct().withColumn("exclusion", F.when(F.length("keyword") > 6, F.substring("keyword", 3, 4)).otherwise(
        F.when(F.length("keyword") == 4, F.lit("license"))))
    hits = table_hits(document_lines(read_table(spark, sf_dir, "documents")), rules, keep=["doc_id", "source"])
    return hits.groupBy("source", "keyword").agg(F.count(F.lit(1)).alias("line_hits"), F.countDistinct("doc_id").alias("doc_hits"))


def q_rule_coverage(spark, sf_dir):
    return rule_coverage(spark, _entries(spark, sf_dir), P.RULES)


QUERIES = {
    "log_entries": q_log_entries,
    "journal_parse": q_journal_parse,
    "reject_split": q_reject_split,
    "journal_alerts": q_journal_alerts,
    "keyword_hits": q_keyword_hits,
    "keyword_stats": q_keyword_stats,
    "keyword_first_seen": q_keyword_first_seen,
    "source_list": q_source_list,
    "line_keyword_hits": q_line_keyword_hits,
    "hourly_counts": q_hourly_counts,
    "slot_baseline": q_slot_baseline,
    "baseline_merge": q_baseline_merge,
    "anomaly_online": q_anomaly_online,
    "anomaly_scored": q_anomaly_scored,
    "confidence_report": q_confidence_report,
    "status_report": q_status_report,
    "triage_alerts": q_triage_alerts,
    "pattern_watch_alerts": q_pattern_watch_alerts,
    "noisy_alerts": q_noisy_alerts,
    "correlation_alerts": q_correlation_alerts,
    "correlation_span_alerts": q_correlation_span_alerts,
    "alert_pipeline": q_alert_pipeline,
    "error_alerts_1h": q_error_alerts_1h,
    "window_hit_count": q_window_hit_count,
    "pattern_reset": q_pattern_reset,
    "aggregate_rollup": q_aggregate_rollup,
    "boot_window_stats": q_boot_window_stats,
    "boot_retained": q_boot_retained,
    "boot_summary": q_boot_summary,
    "rolling_window": q_rolling_window,
    "capped_buffer": q_capped_buffer,
    "incremental_batch": q_incremental_batch,
    "pause_filtered": q_pause_filtered,
    "flag_query": q_flag_query,
    "flag_counts": q_flag_counts,
    "flag_archive_split": q_flag_archive_split,
    "flag_clear": q_flag_clear,
    "rule_coverage": q_rule_coverage,
    "rules_table_hits": q_rules_table_hits,
    "flag_store_roundtrip": q_flag_store_roundtrip,
    "buffer_snapshot_load": q_buffer_snapshot_load,
    "history_seed": q_history_seed,
    "correlation_three_sources": q_correlation_three_sources,
    "dedup_rerun": q_dedup_rerun,
    "mixed_source_alerts": q_mixed_source_alerts,
    "flag_table_counts": q_flag_table_counts,
    "archive_move": q_archive_move,
    "clear_rewrite": q_clear_rewrite,
    "seed_in_two_parts": q_seed_in_two_parts,
    "journal_incremental": q_journal_incremental,
    "journal_capped": q_journal_capped,
    "text_log_lines": q_text_log_lines,
    "archive_live": q_archive_live,
    "live_baseline_merge": q_live_baseline_merge,
    "anomaly_two_parts": q_anomaly_two_parts,
    "live_anomalies": q_live_anomalies,
}
