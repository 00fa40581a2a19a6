"""Batch = stream: the streaming forms over a folder of time-ordered files."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import BASE_NS, SEC, entries_df, fires_by_definition

from vigilspark.config import AlertRules, Threshold
from vigilspark.operators.alerts import single_threshold_alerts
from vigilspark.operators.baseline import hourly_counts
from vigilspark.operators.boot import boot_window_stats
from vigilspark.operators.match import keyword_hits, keyword_stats
from vigilspark.operators.retention import pause_filtered, pause_frame
from vigilspark.operators.rollup import aggregate_rollup
from vigilspark.plans import params as P
from vigilspark.sources.tables import events_as_entries
from vigilspark.plans.jobs import monitor_job
from vigilspark.sources.journal import read_journal_stream
from vigilspark.sources.store import read_flags
from vigilspark.streaming.stream import (
    block_alert_sink, boot_state, closed_rollups, entries_stream, fires_in, flag_sink, hourly_state, keyword_state, observation_log, state_sink,
    stream_alert_pipeline, stream_threshold)

SF = "/root/testdata/sf0.01"


def _split_events(spark, out):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    for i, (lo, hi) in enumerate([("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"),
                                  ("2024-01-21", "2024-02-01")]):
        (ev.filter((F.col("ts") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("ts") < F.lit(hi).cast("timestamp_ntz")))
         .coalesce(1).write.parquet(os.path.join(out, f"part{i}")))
    # one flat folder of files, named in time order
    flat = os.path.join(out, "flat")
    os.makedirs(flat)
    for i in range(3):
        d = os.path.join(out, f"part{i}")
        f = [x for x in os.listdir(d) if x.endswith(".parquet")][0]
        os.link(os.path.join(d, f), os.path.join(flat, f"{i:03d}.parquet"))
    return flat


def _run(df, name, ckpt, mode="append"):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_stream_threshold_equals_batch(spark, tmpdir_path):
    flat = _split_events(spark, tmpdir_path)
    rules = AlertRules(watched=["error"], critical=[])
    th = Threshold(3, 5, 3600)
    e = entries_stream(spark, flat, max_files_per_trigger=1)
    hits = (keyword_hits(e, rules, keep=["timestamp_ns", "seq", "source"])
            .select("timestamp_ns", "seq", F.concat_ws(":", "source", "keyword").alias("pattern_key"),
                    F.lit("PATTERN_WATCH").alias("level")))
    got = _run(stream_threshold(hits, th), "t_fires", os.path.join(tmpdir_path, "ck1"))
    batch = single_threshold_alerts(events_as_entries(spark.read.parquet(f"{SF}/events.parquet")),
                                    rules, "error", th)
    g = {(r.pattern_key, r.timestamp_ns) for r in got.collect()}
    b = {(r.pattern_key, r.timestamp_ns) for r in batch.collect()}
    assert len(b) == 88 and g == b


def _sums(spark, entries, state, ckpt, pauses=None):
    q = (entries.writeStream.foreachBatch(state_sink(state, P.RULES, P.AGG_ANCHOR_NS, 3600, pauses))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()


def same(got, want):
    want = want.select(*got.columns)
    return got.count() == want.count() and got.exceptAll(want).count() == 0


def test_state_sums_equal_batch(spark, tmpdir_path):
    flat, state = _split_events(spark, tmpdir_path), os.path.join(tmpdir_path, "state")
    batch = events_as_entries(spark.read.parquet(f"{SF}/events.parquet"))
    for run in range(2):  # the second run replays every batch under its own number
        _sums(spark, entries_stream(spark, flat, 1), state, os.path.join(tmpdir_path, f"ck{run}"))
        assert same(hourly_state(spark, state), hourly_counts(batch))
        assert same(keyword_state(spark, state), keyword_stats(keyword_hits(batch, P.RULES, keep=["source", "timestamp_ns"])))
        assert same(boot_state(spark, state), boot_window_stats(batch, P.RULES, 3600))
        assert same(closed_rollups(spark, state, 2**62), aggregate_rollup(batch, P.RULES, P.AGG_ANCHOR_NS))
    assert observation_log(spark, state).count() == 3
    half = closed_rollups(spark, state, P.MERGE_SPLIT_NS)
    assert 0 < half.count() < closed_rollups(spark, state, 2**62).count()
    assert half.where(F.col("flagged_at") > P.MERGE_SPLIT_NS).count() == 0


def test_pauses_leave_boot_stats_alone(spark, tmpdir_path):
    flat, state = _split_events(spark, tmpdir_path), os.path.join(tmpdir_path, "state")
    batch = events_as_entries(spark.read.parquet(f"{SF}/events.parquet"))
    pauses = pause_frame(spark, P.PAUSES)
    _sums(spark, entries_stream(spark, flat, 1), state, os.path.join(tmpdir_path, "ck"), pauses)
    assert same(hourly_state(spark, state), hourly_counts(pause_filtered(batch, pauses)))
    assert same(boot_state(spark, state), boot_window_stats(batch, P.RULES, 3600))


def _journal(path, times, name):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        for t in times:
            stamp = str(t * 1_000_000) if isinstance(t, int) else t
            f.write(json.dumps({"__REALTIME_TIMESTAMP": stamp, "_SYSTEMD_UNIT": "a", "MESSAGE": "error x"}) + "\n")


def test_a_bad_timestamp_loses_nothing_and_stops_nothing(spark, tmpdir_path):
    src, state, sink = (os.path.join(tmpdir_path, x) for x in ("journal", "state", "flags"))
    start = 1_704_067_200
    rules = AlertRules(watched=["error"], critical=[], thresholds={"PATTERN_WATCH": Threshold(3, 5, 600)})
    for hour in range(6):
        _journal(src, [start + 3600 * hour + i for i in range(3)] + (["bad"] if hour == 0 else []), f"{hour}.json")
    _journal(src, [start + 7, start + 8, start + 9], "9late.json")
    entries = read_journal_stream(spark, src, 1)
    _sums(spark, entries, state, os.path.join(tmpdir_path, "ck"))
    hours = {r.hour_ns: r.n for r in hourly_state(spark, state).collect()}
    assert sum(hours.values()) == 6 * 3 + 1 + 3 and hours[start * 10**9] == 6
    q = (stream_alert_pipeline(entries, rules).writeStream.foreachBatch(flag_sink(sink))
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck2")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert read_flags(spark, sink).count() == 7  # one each hour, and one of the late file


def test_a_replayed_batch_adds_no_flag(spark, tmpdir_path):
    """The sink wrote, the driver died before the batch was committed, and the job starts again."""
    src, state = os.path.join(tmpdir_path, "journal"), os.path.join(tmpdir_path, "state")
    start = 1_704_067_200
    rules = AlertRules(watched=["error"], critical=[], thresholds={"PATTERN_WATCH": Threshold(3, 5, 600)})
    _journal(src, [start, start + 1], "0.json")
    run = lambda: [q.awaitTermination() for q in monitor_job(spark, src, state, rules, 0, {"availableNow": True})]
    run()
    _journal(src, [start + 2, start + 3], "1.json")
    run()
    commits = os.path.join(state, "_ck_flags", "commits")
    for name in ("1", ".1.crc"):
        if os.path.exists(os.path.join(commits, name)):
            os.remove(os.path.join(commits, name))
    run()
    got = read_flags(spark, os.path.join(state, "flags")).collect()
    assert [r.timestamp_ns for r in got] == [(start + 2) * 10**9]


@pytest.mark.parametrize("seed", range(6))
def test_fires_in_batches_equal_one_pass(seed):
    rng = np.random.default_rng(seed)
    k = int(rng.integers(1, 5))
    n, w = k + int(rng.integers(0, 3)), int(rng.choice([0, 3, 20])) * SEC
    times = np.sort(rng.integers(0, 200, 120)) * SEC
    held = fired = np.zeros(0, dtype=np.int64)
    got, at = [], 0
    for part in np.split(times, [7, 8, 60]):
        new, held, fired = fires_in(part, held, fired, k, n, w)
        got += [(int(part[i]), c) for i, c in new]
    assert got == [(t, c) for t, _, c in fires_by_definition([(int(t), i, "") for i, t in enumerate(times)], k, n, w // SEC)]
    late, held, fired = fires_in(times[:5], held, fired, k, n, w)
    assert not {int(times[i]) for i, _ in late} & {t for t, _ in got}  # what fired before doesn't fire again


def test_stream_alert_pipeline_into_flag_sink_equals_batch(spark, tmpdir_path):
    from vigilspark.operators.alerts import alert_pipeline
    from vigilspark.sources.store import read_flags
    from vigilspark.streaming.stream import flag_sink, stream_alert_pipeline
    flat = _split_events(spark, tmpdir_path)
    sink = os.path.join(tmpdir_path, "flags")
    for run in range(2):      # the second run replays everything: the sink must not duplicate
        e = entries_stream(spark, flat, max_files_per_trigger=1)
        q = (stream_alert_pipeline(e, P.RULES).writeStream.outputMode("append")
             .foreachBatch(flag_sink(sink))
             .option("checkpointLocation", os.path.join(tmpdir_path, f"ck_sink{run}"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
    got = read_flags(spark, sink)
    batch = alert_pipeline(events_as_entries(spark.read.parquet(f"{SF}/events.parquet")), P.RULES)
    assert got.count() == batch.count() == 3060
    assert got.exceptAll(batch.select(*got.columns)).count() == 0


def test_stream_journal_source(spark, tmpdir_path):
    import json
    from vigilspark.sources.journal import read_journal_stream
    src = os.path.join(tmpdir_path, "journal")
    os.makedirs(src)
    rec = {"__REALTIME_TIMESTAMP": "1704067200000000", "_SYSTEMD_UNIT": "a.service", "MESSAGE": "error x"}
    with open(os.path.join(src, "0.json"), "w") as f:
        f.write("\n".join([json.dumps(rec), "", "{cut", json.dumps({**rec, "__REALTIME_TIMESTAMP": "bad"})]) + "\n")
    out = _run(read_journal_stream(spark, src), "t_journal", os.path.join(tmpdir_path, "ckj"))
    rows = out.orderBy("timestamp_ns").collect()
    assert len(rows) == 2                      # blank and cut JSON rejected
    assert rows[0].timestamp_ns == 1704067200000000000
    assert rows[1].timestamp_ns > 1704067200000000000   # bad timestamp -> ingest time
    assert {r.raw for r in rows} == {"a.service: error x"}


def test_stream_skips_hits_flagged_in_an_earlier_run(spark, tmpdir_path):
    from vigilspark.operators.alerts import alert_pipeline
    from vigilspark.sources.store import dedup_keys, read_flags, write_flags
    from vigilspark.streaming.stream import stream_alert_pipeline
    flat = _split_events(spark, tmpdir_path)
    batch_e = events_as_entries(spark.read.parquet(f"{SF}/events.parquet"))
    sink = os.path.join(tmpdir_path, "flags")
    first = alert_pipeline(batch_e, P.RULES)
    write_flags(first, sink)
    e = entries_stream(spark, flat, max_files_per_trigger=1)
    again = _run(stream_alert_pipeline(e, P.RULES, prior_flags=dedup_keys(spark, sink)), "t_again",
                 os.path.join(tmpdir_path, "ck_again"))
    seen = {(r.timestamp_ns, r.pattern_key) for r in read_flags(spark, sink).collect()}
    new = {(r.timestamp_ns, r.pattern_key) for r in again.collect()}
    assert not (seen & new)
    # the same as the batch pipeline given the same prior flags
    expect = alert_pipeline(batch_e, P.RULES, prior_flags=dedup_keys(spark, sink))
    assert new == {(r.timestamp_ns, r.pattern_key) for r in expect.collect()}


# ------------------------------------------------------------- live block fold

def _flags_of(spark, path):
    from vigilspark.sources.store import read_flags
    return sorted(map(tuple, read_flags(spark, path).collect()), key=str)


def _in_order(spark, entries, rules, path, cuts, **kw):
    sink = block_alert_sink(f"{path}/flags", f"{path}/held", rules, (f"{path}/archive",), block_rows=50, **kw)
    edges = [None, *cuts, None]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        part = entries if a is None else entries.where(F.col("timestamp_ns") >= a)
        sink(part if b is None else part.where(F.col("timestamp_ns") < b), i)
    return sink


def test_block_fold_over_batches_equals_the_whole(spark, tmpdir_path):
    from vigilspark.operators.alerts import alert_pipeline
    entries = events_as_entries(spark.read.parquet(f"{SF}/events.parquet"))
    day = 86400 * 10**9
    cuts = [P.AGG_ANCHOR_NS + d * day for d in (3, 4, 17)]
    _in_order(spark, entries, P.RULES, tmpdir_path, cuts)
    whole = alert_pipeline(entries, P.RULES)
    from vigilspark.sources.store import FLAT_FLAGS
    assert _flags_of(spark, f"{tmpdir_path}/flags") == sorted(map(tuple, whole.select(*FLAT_FLAGS.fieldNames()).collect()), key=str)


def test_block_fold_replays_and_never_flags_twice(spark, tmpdir_path, monkeypatch):
    from vigilspark.sources.versions import VersionedTable
    rules = AlertRules(watched=["error"], critical=[], thresholds={"PATTERN_WATCH": Threshold(3, 5, 60), "CORRELATION": Threshold(2, 3, 300),
                                                                   "TRIAGE": Threshold(1, 1, 0)})
    at = lambda *seconds: entries_df(spark, [(BASE_NS + s * SEC, "u", f"error {s}", 3, s) for s in seconds])
    fired = lambda: [(r[0] - BASE_NS) // SEC for r in _flags_of(spark, f"{tmpdir_path}/flags")]
    sink = block_alert_sink(f"{tmpdir_path}/flags", f"{tmpdir_path}/held", rules, (f"{tmpdir_path}/archive",))
    sink(at(1, 2), 0)
    sink(at(1, 2), 0)       # replayed: the two count once
    sink(at(), 1)
    assert fired() == []
    commit = VersionedTable.commit
    monkeypatch.setattr(VersionedTable, "commit", lambda self, *a, **k: 1 / 0 if self.path.endswith("held") else commit(self, *a, **k))
    with pytest.raises(ZeroDivisionError):
        sink(at(3, 40, 50), 2)   # dies between its flags and its state
    assert fired() == [3]
    monkeypatch.setattr(VersionedTable, "commit", commit)
    sink(at(3, 40, 50), 2)
    assert fired() == [3]
    sink(at(3, 55, 3), 3)   # 3 was flagged before; 40, 50 and 55 make three
    assert fired() == [3, 55]
    sink(at(300, 320), 4)
    sink(at(310), 5)        # late: counts in its place, the held hit at 320 fires
    assert fired() == [3, 55, 320]


def test_block_fold_of_one_key_out_of_order(spark, tmpdir_path):
    """All hits of one key in one batch, shuffled, over many blocks."""
    import random
    rng = random.Random(3)
    rules = AlertRules(watched=["error"], critical=[], thresholds={"PATTERN_WATCH": Threshold(4, 6, 30), "CORRELATION": Threshold(2, 3, 300),
                                                                   "TRIAGE": Threshold(1, 1, 0)})
    times = [rng.randrange(20_000) for _ in range(3000)]
    rows = [(BASE_NS + t * SEC, "u", "error", 3, i) for i, t in enumerate(times)]
    block_alert_sink(f"{tmpdir_path}/flags", f"{tmpdir_path}/held", rules, block_rows=200)(entries_df(spark, rows).repartition(5), 0)
    want = fires_by_definition([(r[0], r[4], "u") for r in rows], 4, 6, 30)
    assert sorted((r[0], r[7]) for r in _flags_of(spark, f"{tmpdir_path}/flags")) == sorted((t, n) for t, _, n in want)
