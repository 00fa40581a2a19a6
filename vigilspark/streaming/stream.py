"""Structured Streaming forms of the operators.

Alerts keep state per (pattern_key, level) in ``applyInPandasWithState``: the
hits counted since the last fire, at most ``samples``, and the times that
fired lately.  Inside a micro-batch hits are taken in (timestamp_ns, seq)
order; across micro-batches arrival order applies, and every arriving row
counts: there is no watermark, so neither a late row nor one whose bad
timestamp was replaced by the ingest time makes others be dropped.  There is
one small row of state for each key, that is for each source and keyword.

Counts (hourly, keyword, boot window, rollup, records, observation) need no
streaming state: each micro-batch adds one folder of its own sums to a table
with versions, a replay adds nothing, readers add them up, and
``compact_sums`` makes one folder of many.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from vigilspark.config import AlertRules, NS_PER_SECOND, Threshold
from vigilspark.functions.columns import slot_key_ns
from vigilspark.operators import boot, match, rollup
from vigilspark.operators.retention import pause_filtered
from vigilspark.schemas import BOOT_STATS
from vigilspark.sources.journal import live_entries, reject_counts
from vigilspark.sources.tables import events_as_entries
from vigilspark.session import materialize
from vigilspark.sources.versions import Superseded, Version, VersionedTable

_STATE = T.StructType([
    T.StructField("held", T.ArrayType(T.LongType())),
    T.StructField("fired", T.ArrayType(T.LongType())),
])

#: How much longer than its window a key's fired times are remembered; the sink holds later repeats against the table.
MEMORY_NS = 3600 * NS_PER_SECOND


def entries_stream(spark: SparkSession, events_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Log entries from a folder of ``events`` parquet files, as a stream."""
    schema = spark.read.parquet(events_dir).schema
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return events_as_entries(reader.load(events_dir))


def fires_in(times: np.ndarray, held: np.ndarray, fired: np.ndarray, k: int, n: int, w_ns: int):
    """([(number in ``times``, hits counted)], hits held after, times fired).

    ``held`` are the hits counted since the last fire, in arrival order.  Hits
    whose time has fired don't count; one fires when ``k`` of the last ``n``
    counted ones, itself included, lie within ``w_ns`` up to it.
    """
    if w_ns == 0 or (k <= 1 <= n):
        new, first = np.unique(times, return_index=True)
        rows = np.sort(first[~np.isin(new, fired)])
        return [(int(i), 1) for i in rows], held[:0], np.concatenate([fired, times[rows]])
    counted = np.flatnonzero(~np.isin(times, fired))
    seq = np.concatenate([held, times[counted]])
    out, done, start = [], list(fired), 0
    if n < k:
        return out, seq[len(seq) - n:] if n else seq[:0], fired
    if (np.diff(seq) >= 0).all():
        # in order: a hit can fire if the k-th newest up to it is in the window
        near = np.flatnonzero(seq[k - 1:] - seq[:max(0, len(seq) - k + 1)] <= w_ns) + k - 1
        at = np.searchsorted(near, len(held))
        while at < len(near):
            j = int(near[at])
            out.append((int(counted[j - len(held)]), k))
            done.append(int(seq[j]))
            start = int(np.searchsorted(seq, seq[j], side="right"))  # the rest of its time is skipped
            at = int(np.searchsorted(near, start + k - 1))
    else:
        skip = set()
        for j in range(len(held), len(seq)):
            if int(seq[j]) in skip:
                continue
            window = [i for i in range(start, j + 1) if int(seq[i]) not in skip][-n:]
            inside = int(np.count_nonzero((seq[window] >= seq[j] - w_ns) & (seq[window] <= max(seq[j], seq[window].max()))))
            if inside >= k:
                out.append((int(counted[j - len(held)]), inside))
                done.append(int(seq[j]))
                skip.add(int(seq[j]))
                start = j + 1
        seq = np.array([x for i, x in enumerate(seq.tolist()) if i < start or x not in skip], dtype=np.int64)
        start = min(start, len(seq))
    left = seq[start:]
    return out, left[max(0, len(left) - n):], np.array(done, dtype=np.int64)


def stream_threshold(hits: DataFrame, threshold: Threshold | None = None, keys=("pattern_key", "level"),
                     payload=()) -> DataFrame:
    """T2/T3 over a stream: fired hits ``keys + (timestamp_ns, seq, hit_count)``
    plus the ``payload`` columns of the fired rows.

    With ``threshold=None`` the hits carry their own ``k``, ``n`` and ``w_ns``
    columns (constant per key), so one stateful operator serves every tier.
    """
    keys = list(keys)
    payload = [c for c in payload if c not in keys and c not in ("timestamp_ns", "seq")]
    out_schema = T.StructType([hits.schema[c] for c in keys] + [
        T.StructField("timestamp_ns", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("hit_count", T.IntegerType()),
    ] + [hits.schema[c] for c in payload])
    if threshold is not None:
        hits = (hits.withColumn("k", F.lit(int(threshold.required)))
                .withColumn("n", F.lit(int(threshold.samples)))
                .withColumn("w_ns", F.lit(int(threshold.window_ns))))

    def fold(key, batches: Iterator[pd.DataFrame], state):
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["timestamp_ns", "seq"], kind="stable").reset_index(drop=True)
        k, n, w_ns = (int(pdf[c].iloc[0]) for c in ("k", "n", "w_ns"))
        held, fired = (np.array(x or [], dtype=np.int64) for x in (state.get if state.exists else ([], [])))
        times = pdf["timestamp_ns"].to_numpy(dtype=np.int64)
        new, held, fired = fires_in(times, held, fired, k, n, w_ns)
        newest = max(times.max(), *(x.max() for x in (held, fired) if len(x))) if len(held) or len(fired) else times.max()
        state.update((held.tolist(), fired[fired >= newest - w_ns - MEMORY_NS].tolist()))
        if new:
            out = pdf.loc[[i for i, _ in new], keys + ["timestamp_ns", "seq"] + payload].copy()
            out["hit_count"] = [c for _, c in new]
            yield out[[f.name for f in out_schema.fields]]

    return hits.groupBy(*keys).applyInPandasWithState(fold, out_schema, _STATE, "append", GroupStateTimeout.NoTimeout)


def stream_alert_pipeline(entries: DataFrame, rules: AlertRules, prior_flags: DataFrame | None = None) -> DataFrame:
    """T9 over a stream: keyword match, exclusions, tiers and every threshold
    in one stateful operator keyed by (pattern_key, level).  ``flagged_at`` is
    the entry's timestamp, as in batch, so batch and stream agree.

    ``prior_flags`` (a static table that doesn't change while the checkpoint
    lives) is anti-joined before counting: a hit flagged in an earlier run is
    skipped, not counted again."""
    from vigilspark.operators.alerts import PAYLOAD, _case, dedup, tiered_hits
    hits, _ = tiered_hits(entries, rules, keep=PAYLOAD)
    hits = dedup(hits, prior_flags)
    tiers = rules.tiers()
    kw = F.col("keyword")
    hits = (hits.withColumn("k", _case(kw, {t[0]: int(t[2].required) for t in tiers}).cast("int"))
            .withColumn("n", _case(kw, {t[0]: int(t[2].samples) for t in tiers}).cast("int"))
            .withColumn("w_ns", _case(kw, {t[0]: int(t[2].window_ns) for t in tiers}).cast("long")))
    fired = stream_threshold(hits, None, ("pattern_key", "level", "note"), payload=["source", "raw", "priority"])
    return fired.select("timestamp_ns", "source", "raw", "priority", "level",
                        F.col("timestamp_ns").alias("flagged_at"), "pattern_key", "hit_count", "note")


def flag_sink(path: str, stream: str = "alerts"):
    """S5 for streams: a ``foreachBatch`` writer that appends each micro-batch's
    flags once, as a new version of the table.  A replayed batch (after a
    failure, from the checkpoint) is told by its number.  Rows whose
    (timestamp_ns, pattern_key, level) already sit in the table are dropped."""
    from vigilspark.sources.store import append_flags, read_flags

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            earliest = batch.agg(F.min("flagged_at")).first()[0]
            if earliest is not None:
                # only flags at or after the batch's earliest flag can collide with
                # it: read just those date partitions, not the whole growing table
                seen = read_flags(spark, path, since_ns=earliest).select("timestamp_ns", "pattern_key", "level")
                append_flags(batch.join(seen, ["timestamp_ns", "pattern_key", "level"], "left_anti"), path, stream, batch_id)
        finally:
            batch.unpersist()

    return write


# ------------------------------------------------------------- live block fold

#: Hits that may still count towards a fire.
HELD = "pattern_key string, level string, note string, tgroup int, timestamp_ns long, seq long, source string, raw string, priority int"


def block_alert_sink(flags_path: str, state_path: str, rules: AlertRules, memory_paths=(), pauses: DataFrame | None = None,
                     block_rows: int | None = None, stream: str = "alerts"):
    """T9 live on the block fold: a ``foreachBatch`` writer of entries.

    A micro-batch's hits and the hits that earlier ones left counting are folded
    by ``grouped_threshold_fires``: positions over range partitions, blocks,
    composed tables.  So a key with any number of hits, in any order, never
    meets in one task.  Inside that, time order applies: a late hit counts
    in its place in time among the hits left, and the hit that completes a
    threshold fires, be it a held one.  What was flagged in the table, the
    archive and the cleared flags is never counted or flagged again.

    What a batch leaves is a table with versions, at most ``samples`` newest hits
    of each key behind its last fire, marked with the batch.  Flags are
    appended first, under the batch's name; a batch replayed after that
    works from the same state, without its own flags, and appends nothing twice.
    """
    from vigilspark.operators.alerts import PAYLOAD, _immediate_flags, dedup, flagged_rows, stored_hits, tiered_hits
    from vigilspark.operators.threshold import grouped_threshold_fires, is_immediate
    from vigilspark.sources.store import append_flags, read_flags
    schema = T.StructType.fromDDL(HELD)
    keys = ["pattern_key", "level", "note"]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = VersionedTable(spark, state_path)
        version = state.current()
        if version.marks.get(stream, -1) >= batch_id:
            return
        heard = batch if pauses is None else pause_filtered(batch, pauses)
        hits, gid = tiered_hits(heard, rules, keep=PAYLOAD)
        hits = materialize(hits.select(*schema.fieldNames()))
        earliest = hits.agg(F.min("timestamp_ns")).first()[0]
        if earliest is None:
            state.commit(marks={stream: batch_id})
            return
        live = VersionedTable(spark, flags_path).current()
        before = Version(live.number, tuple(f for f in live.folders if f != f"{stream}-{batch_id:012d}"), live.marks)
        known = read_flags(spark, flags_path, since_ns=earliest, version=before)
        for path in memory_paths:
            known = known.unionByName(read_flags(spark, path, since_ns=earliest))
        fresh = dedup(hits, known)
        groups = {i: th for th, i in gid.items()}
        windowed = {i: th for i, th in groups.items() if not is_immediate(th)}
        flags = _immediate_flags(fresh.where(~F.col("tgroup").isin(list(windowed))))
        rows = stored_hits(state.read(schema, version).unionByName(fresh.where(F.col("tgroup").isin(list(windowed)))))
        fires = materialize(grouped_threshold_fires(rows.select(*keys, "tgroup", "timestamp_ns", "seq", "rid"), windowed, keys, None, block_rows)) \
            if windowed else None
        left = rows
        if fires is not None:
            flags = flags.unionByName(flagged_rows(fires.drop("tgroup"), rows))
            last = fires.groupBy(*keys).agg(F.max("timestamp_ns").alias("_fired"))
            left = rows.join(last, keys, "left").where("_fired is null or timestamp_ns > _fired")
        samples = F.create_map(*[F.lit(x) for i, th in windowed.items() for x in (i, max(int(th.samples), int(th.required)))]) if windowed else F.lit(None)
        newest = Window.partitionBy(*keys).orderBy(F.desc("timestamp_ns"), F.desc("seq"), F.desc("rid"))
        most = max([int(th.samples) for th in windowed.values()] + [int(th.required) for th in windowed.values()] + [0])
        left = left.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most)
        if windowed:
            left = left.where(F.col("_n") <= samples[F.col("tgroup")])
        append_flags(flags, flags_path, stream, batch_id)
        state.commit([state.write(left.select(*schema.fieldNames()), f"{stream}-{batch_id:012d}")], version.folders, {stream: batch_id})
        state.prune()

    return write


# ------------------------------------------------------------------ state sums

#: Name -> (columns, how the sums of several folders become one: group columns and aggregates; without them rows are kept).
SUMS = {
    "hourly": ("source string, hour_ns long, n long, earliest_ns long, newest_ns long", ["source", "hour_ns"],
               ["sum(n) as n", "min(earliest_ns) as earliest_ns", "max(newest_ns) as newest_ns"]),
    "keyword_stats": ("source string, keyword string, hits long, last_seen_ns long, first_seen_ns long", ["source", "keyword"],
                      ["sum(hits) as hits", "max(last_seen_ns) as last_seen_ns", "min(first_seen_ns) as first_seen_ns"]),
    "boot_stats": (BOOT_STATS, ["boot_id", "keyword"],
                   ["sum(hits) as hits", "max(last_seen_ns) as last_seen_ns", "min(first_seen_ns) as first_seen_ns"]),
    "observed": ("start_ns long, end_ns long", [], []),
    "rollup": ("keyword string, interval_s long, end_ns long, n long", ["keyword", "interval_s", "end_ns"], ["sum(n) as n"]),
    "outcomes": ("outcome string, n long", ["outcome"], ["sum(n) as n"]),
    "seen": ("source string, timestamp_ns long, seq long, n long", ["source", "timestamp_ns", "seq"], ["sum(n) as n"]),
}


def batch_sums(entries: DataFrame, rules: AlertRules, boot_window_seconds: int, heard: DataFrame | None = None) -> dict:
    """Name -> sums of ``entries``, but for the rollup; those in a pause (not in ``heard``) count for the boot stats and as seen only."""
    heard = entries if heard is None else heard
    hits = match.keyword_hits(heard, rules, keep=["source", "timestamp_ns"])
    return {
        "hourly": heard.groupBy("source", F.expr("timestamp_ns - pmod(timestamp_ns, 3600000000000L)").alias("hour_ns")).agg(
            F.count(F.lit(1)).alias("n"), F.min("timestamp_ns").alias("earliest_ns"), F.max("timestamp_ns").alias("newest_ns")),
        "keyword_stats": hits.groupBy("source", "keyword").agg(
            F.count(F.lit(1)).alias("hits"), F.max("timestamp_ns").alias("last_seen_ns"), F.min("timestamp_ns").alias("first_seen_ns")),
        "boot_stats": boot.boot_window_stats(entries, rules, boot_window_seconds),
        "seen": entries.groupBy("source", "timestamp_ns", "seq").agg(F.count(F.lit(1)).alias("n")),
    }


def state_sink(state_dir: str, rules: AlertRules, anchor_ns: int, boot_window_seconds: int, pauses: DataFrame | None = None):
    """``foreachBatch`` writer of a micro-batch's sums: hourly counts, keyword
    stats, boot-window stats, rollups, records and the observed stretch of time.

    A batch is of entries, or of parsed journal lines: then how many were
    loaded, and rejected for which reason, is kept too.  Each is a table with
    versions, to which a batch adds one folder, once.  Entries in a pause are
    left out of all but the boot stats and the records."""
    def write(batch: DataFrame, batch_id: int) -> None:
        if "reject_reason" in batch.columns:
            VersionedTable(batch.sparkSession, f"{state_dir.rstrip('/')}/outcomes").append_batch(reject_counts(batch), "batch", batch_id)
            batch = live_entries(batch)
        batch.persist()
        try:
            heard = batch if pauses is None else pause_filtered(batch, pauses)
            sums = batch_sums(batch, rules, boot_window_seconds, heard)
            sums["observed"] = heard.agg(F.min("timestamp_ns").alias("start_ns"), F.max("timestamp_ns").alias("end_ns")).where("start_ns is not null")
            if rules.aggregate:
                sums["rollup"] = rollup.rollup_counts(heard, rules, anchor_ns)
            for name, df in sums.items():
                VersionedTable(batch.sparkSession, f"{state_dir.rstrip('/')}/{name}").append_batch(df, "batch", batch_id)
        finally:
            batch.unpersist()

    return write


def schema_of(name: str) -> T.StructType:
    found = SUMS[name][0]
    return T.StructType.fromDDL(found) if isinstance(found, str) else found


def folder_batches(folder: str) -> tuple[int, int]:
    """First and last batch of a folder of sums: ``batch-<n>``, or ``batches-<a>-<b>`` where several were added up."""
    numbers = [int(x) for x in folder.split("-")[1:]]
    return numbers[0], numbers[-1]


def batch_folders(table: VersionedTable, after: int = -1) -> tuple[list[str], int]:
    """(folders of batches behind ``after``, the last batch in them)."""
    found = [f for f in table.current().folders if folder_batches(f)[1] > after]
    if any(folder_batches(f)[0] <= after for f in found):
        raise ValueError(f"{table.path}: a folder goes over batch {after}")
    return found, max([after, *(folder_batches(f)[1] for f in found)])


def added_up(rows: DataFrame, name: str) -> DataFrame:
    _, keys, sums = SUMS[name]
    return rows.groupBy(*keys).agg(*[F.expr(s) for s in sums]).select(*schema_of(name).fieldNames()) if keys else rows


def compact_sums(spark: SparkSession, state_dir: str, after: int = -1, at_least: int = 8) -> dict:
    """Add up the folders of batches behind ``after`` in each table of sums that has ``at_least`` of them; name -> folders replaced.

    A table that another pass changed meanwhile is left as it is.
    """
    done = {}
    for name in SUMS:
        table = VersionedTable(spark, f"{state_dir.rstrip('/')}/{name}")
        folders, last = batch_folders(table, after)
        if len(folders) < max(2, at_least):
            continue
        first = min(folder_batches(f)[0] for f in folders)
        made = table.write(added_up(table.read(schema_of(name), folders=folders), name), f"batches-{first:012d}-{last:012d}")
        try:
            table.commit([made], folders)
        except Superseded:
            continue
        table.prune()
        done[name] = len(folders)
    return done


def _sums(spark: SparkSession, state_dir: str, name: str) -> DataFrame:
    return VersionedTable(spark, f"{state_dir.rstrip('/')}/{name}").read(schema_of(name))


def hourly_state(spark: SparkSession, state_dir: str) -> DataFrame:
    """A1: entries per (source, hour) so far."""
    return added_up(_sums(spark, state_dir, "hourly"), "hourly").select("source", "hour_ns", "n").withColumn("slot_key", slot_key_ns("hour_ns"))


def keyword_state(spark: SparkSession, state_dir: str) -> DataFrame:
    """A4: keyword stats so far."""
    return added_up(_sums(spark, state_dir, "keyword_stats"), "keyword_stats").select("source", "keyword", "hits", "last_seen_ns")


def boot_state(spark: SparkSession, state_dir: str, boots_kept: int | None = None) -> DataFrame:
    """Boot-window stats so far; R5: of the newest ``boots_kept`` boots."""
    stats = added_up(_sums(spark, state_dir, "boot_stats"), "boot_stats")
    return stats if boots_kept is None else boot.retained_boot_stats(stats, boots_kept)


def outcome_counts(spark: SparkSession, state_dir: str) -> DataFrame:
    """Journal lines loaded, and rejected by reason, so far; a bad timestamp is loaded with the micro-batch time."""
    return added_up(_sums(spark, state_dir, "outcomes"), "outcomes")


def observation_log(spark: SparkSession, state_dir: str) -> DataFrame:
    """(start_ns, end_ns) of every micro-batch."""
    return _sums(spark, state_dir, "observed")


def closed_rollups(spark: SparkSession, state_dir: str, as_of_ns: int) -> DataFrame:
    """AGGREGATE flags of the intervals that ended by ``as_of_ns``."""
    parts = _sums(spark, state_dir, "rollup")
    counts = parts.where(F.col("end_ns") <= int(as_of_ns)).groupBy("keyword", "interval_s", "end_ns").agg(F.sum("n").alias("n"))
    return rollup.rollup_flags(counts)
