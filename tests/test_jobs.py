"""End-to-end jobs on journal files exported from the driver's events table."""

import json
import os

from pyspark.sql import functions as F

from vigilspark.config import AlertRules
from vigilspark.plans import params as P
from vigilspark.plans.jobs import close_job, journal_export, monitor_job, seed_job
from vigilspark.sources import store
from vigilspark.streaming.stream import boot_state, hourly_state, keyword_state

SF = "/root/testdata/sf0.01"
RULES = AlertRules(watched=["error", "purchase", "signup", "view"], critical=["purchase"],
                   exclusions={"error": '"k": 7'}, aggregate={"click": 1800})


def _export(spark, path):
    journal_export(spark.read.parquet(f"{SF}/events.parquet")).coalesce(2).write.text(path)


def test_seed_job_and_merge(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "journal")
    _export(spark, src)
    v1 = os.path.join(tmpdir_path, "v1")
    meta = seed_job(spark, src, v1, RULES, P.AS_OF_NS, boot_window_seconds=3600).collect()[0]
    assert 29 < meta.seed_days < 31 and meta.confidence_pct == 40 and meta.monitoring_active
    state = store.load_baseline(spark, v1)
    # all journal rows share source 'journalctl': 168 weekday-hour slots at most
    assert state["baseline"].count() <= 168
    assert state["keyword_stats"].filter("keyword = 'purchase'").count() == 1
    assert state["boot_stats"].select("boot_id").distinct().count() == 10
    # seeding the same export again changes nothing
    v2 = os.path.join(tmpdir_path, "v2")
    again = seed_job(spark, src, v2, RULES, P.AS_OF_NS, boot_window_seconds=3600, previous=v1).collect()[0]
    assert again == meta
    for name, df in store.load_baseline(spark, v2).items():
        assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, store.load_baseline(spark, v1)[name].collect()), key=str)
    # observed time adds up and raises the confidence
    log = spark.createDataFrame([(0, 7 * 86400 * 10**9), (0, 7 * 86400 * 10**9)], "start_ns long, end_ns long")
    v3 = os.path.join(tmpdir_path, "v3")
    assert seed_job(spark, src, v3, RULES, P.AS_OF_NS, previous=v2, observed=log).collect()[0].confidence_pct == 100


def test_seeding_parts_in_any_order(spark, tmpdir_path):
    """Late, tied and repeated rows and a second host's earlier journal: the parts equal the whole."""
    def line(s, host, message):
        return json.dumps({"__REALTIME_TIMESTAMP": str(1_704_067_200_000_000 + s * 10**6), "MESSAGE": message, "_BOOT_ID": host,
                           "__MONOTONIC_TIMESTAMP": str(s * 10**6), "_SYSTEMD_UNIT": "u", "PRIORITY": "3"})
    first = [line(9000, "a", "error 1"), line(10 ** 7, "a", "view in the future"), line(20, "a", "error 2")]
    second = [line(9000, "a", "error 3"), line(10, "b", "error 4"), line(4000, "b", "purchase"), line(4000, "b", "purchase")]

    def seed(name, lines, previous=None):
        src, out = os.path.join(tmpdir_path, name), os.path.join(tmpdir_path, f"{name}_out")
        spark.createDataFrame([(x,) for x in lines], "value string").write.text(src)
        seed_job(spark, src, out, RULES, P.AS_OF_NS, boot_window_seconds=3600, previous=previous)
        return out

    whole = store.load_baseline(spark, seed("whole", first + second))
    parts = store.load_baseline(spark, seed("rest", second, seed("first", first)))
    assert whole["hourly"].agg(F.sum("n")).first()[0] == 7
    for name, df in parts.items():
        assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, whole[name].collect()), key=str), name


def test_monitor_job(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "journal")
    _export(spark, src)
    state = os.path.join(tmpdir_path, "state")
    for q in monitor_job(spark, src, state, RULES, P.AGG_ANCHOR_NS, trigger={"availableNow": True},
                         boot_window_seconds=3600):
        q.awaitTermination()
    flags = store.read_flags(spark, os.path.join(state, "flags"))
    levels = {r.level for r in flags.select("level").distinct().collect()}
    assert levels == {"TRIAGE", "PATTERN_WATCH"}
    assert flags.filter("level = 'TRIAGE'").count() > 0
    done = close_job(spark, state, P.AS_OF_NS, retention_days=7)
    live = store.read_flags(spark, done["live"])
    old = store.read_flags(spark, os.path.join(state, "archive"))
    assert old.count() == done["archived"] > 0
    assert "AGGREGATE" in {r.level for r in live.unionByName(old).select("level").distinct().collect()}
    hours = hourly_state(spark, state)
    assert hours.agg(F.sum("n")).first()[0] == keyword_free_lines(spark, src)
    assert keyword_state(spark, state).count() > 0 and boot_state(spark, state).count() > 0


def keyword_free_lines(spark, src):
    """Lines that the live stream takes: all but blank and cut ones."""
    from vigilspark.sources import journal
    return journal.split_rejects(journal.parse_lines(spark.read.text(src)), drop_bad_timestamp=False)[0].count()
