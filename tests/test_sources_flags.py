"""Sources, sinks and the flag table (S1–S9, F7, M1–M4, A10, A9, boot windows)."""

import json
import os

from pyspark.sql import functions as F

from tests.conftest import BASE_NS, SEC, entries_df
from vigilspark.config import AlertRules
from vigilspark.operators import boot, flags, rollup
from vigilspark.operators.alerts import alert_pipeline
from vigilspark.operators.rules import rule_violations, rules_frame
from vigilspark.sources import journal, store

DAY = 86400 * SEC


def _write_lines(path, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.json"), "w") as f:
        f.write("\n".join(lines) + "\n")


def test_journal_history_and_rejects(spark, tmpdir_path):
    good = {"__REALTIME_TIMESTAMP": "1704067200000000", "_SYSTEMD_UNIT": "kernel.service",
            "MESSAGE": "buffer overrun", "PRIORITY": "3", "_BOOT_ID": "b1", "__MONOTONIC_TIMESTAMP": "5"}
    lines = [
        json.dumps(good),
        "",
        '{"__REALTIME_TIMESTAMP": "17040',
        json.dumps({**good, "__REALTIME_TIMESTAMP": "abc"}),
        json.dumps({k: v for k, v in good.items() if k != "_SYSTEMD_UNIT"} | {"SYSLOG_IDENTIFIER": "sshd"}),
        json.dumps({k: v for k, v in good.items() if k not in ("_SYSTEMD_UNIT", "MESSAGE")}),
        json.dumps({**good, "PRIORITY": "x"}),
    ]
    path = os.path.join(tmpdir_path, "journal")
    _write_lines(path, lines)
    parsed = journal.parse_lines(spark.read.text(path))
    counts = {r.outcome: r.n for r in journal.reject_counts(parsed).collect()}
    assert counts == {"loaded": 4, "blank": 1, "malformed": 1, "bad_timestamp": 1}
    rows = journal.read_journal(spark, path).orderBy("raw").collect()
    assert [r.raw for r in rows] == ["kernel.service: buffer overrun", "kernel.service: buffer overrun",
                                     "sshd: buffer overrun", "unknown: "]
    assert {r.timestamp_ns for r in rows} == {1704067200000000000}
    assert sorted([r.priority for r in rows], key=lambda x: (x is None, x)) == [3, 3, 3, None]
    assert {r.source for r in rows} == {"journalctl"}


def test_text_log_source(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "logs")
    os.makedirs(path)
    with open(os.path.join(path, "auth.log"), "w") as f:
        f.write("Failed password for root\nok line\n")
    e = store.text_log(spark, path).collect()
    assert [r.raw for r in e] == ["Failed password for root", "ok line"]
    assert {r.source for r in e} == {"auth.log"} and all(r.priority is None for r in e)


def _flags(spark):
    e = entries_df(spark, [(BASE_NS + i * 60 * SEC, "svc", "purchase done" if i % 2 else "error x", 3, i)
                           for i in range(12)] + [(BASE_NS + 10 * DAY, "svc", "purchase late", 5, 99)])
    rules = AlertRules(watched=["error", "purchase"], critical=["purchase"])
    return alert_pipeline(e, rules), e, rules


def test_flag_queries_counts_clear_archive(spark):
    f, _, _ = _flags(spark)
    assert flags.flag_query(f, level="TRIAGE").count() == 7
    assert flags.flag_query(f, since_ns=BASE_NS + 10 * DAY).count() == 1
    counts = {r.level: r.n for r in flags.flag_counts(f).collect()}
    assert counts == {"TRIAGE": 7, "PATTERN_WATCH": 2, None: 9}
    assert flags.flag_clear(f, "TRIAGE").count() == 2
    assert flags.flag_clear(f).count() == 0
    split = {r.destination: 0 for r in flags.flag_archive_split(f, BASE_NS + 10 * DAY, 7).collect()}
    assert set(split) == {"archive", "live"}


def test_flag_persistence_and_dedup(spark, tmpdir_path):
    f, e, rules = _flags(spark)
    live = os.path.join(tmpdir_path, "flags")
    store.write_flags(f, live)
    back = store.read_flags(spark, live)
    assert back.count() == 9
    # restart: an entry already flagged under a key is never flagged again
    # (the window state itself is not persisted, so other hits may fire)
    again = alert_pipeline(e, rules, prior_flags=store.dedup_keys(spark, live))
    first = {(r.timestamp_ns, r.pattern_key) for r in f.collect()}
    second = {(r.timestamp_ns, r.pattern_key) for r in again.collect()}
    assert first and not (first & second)
    assert second == {(BASE_NS + 6 * 60 * SEC, "svc:error")}
    # archive then clear, each into a new version
    arch, live2 = os.path.join(tmpdir_path, "archive"), os.path.join(tmpdir_path, "flags_v2")
    n = store.archive_flags(spark, live, arch, live2, BASE_NS + 10 * DAY, 7)
    assert n == 8 and store.read_flags(spark, live2).count() == 1
    assert store.read_flags(spark, arch).count() == 8
    # a rerun (e.g. after a failure before the live rewrite) archives nothing twice
    assert store.archive_flags(spark, live, arch, live2 + "_rerun", BASE_NS + 10 * DAY, 7) == 0
    assert store.read_flags(spark, arch).count() == 8
    live3 = os.path.join(tmpdir_path, "flags_v3")
    memory = os.path.join(tmpdir_path, "cleared")
    assert store.clear_flags(spark, live2, live3, "TRIAGE", memory_path=memory) == 1
    assert store.read_flags(spark, live3).count() == 0
    # cleared flags stay in the dedup memory: rerunning flags nothing old again
    keys = store.dedup_keys(spark, live3, arch, memory)
    rerun = {(r.timestamp_ns, r.pattern_key) for r in alert_pipeline(e, rules, prior_flags=keys).collect()}
    assert not (rerun & first)


def test_flag_jsonl_interchange_skips_malformed(spark, tmpdir_path):
    f, _, _ = _flags(spark)
    path = os.path.join(tmpdir_path, "flags_json")
    store.write_flags_jsonl(f, path)
    with open(os.path.join(path, "zz-broken.json"), "w") as out:
        out.write('{"entry": {"timestamp_ns": 1}, "level": "NOPE", "flagged_at": 1, "pattern_key": "x", "hit_count": 1}\n')
        out.write("not json\n")
    good, counts = store.read_flags_jsonl(spark, path)
    assert good.count() == 9
    assert {r.outcome: r.n for r in counts.collect()} == {"loaded": 9, "malformed": 2}


def test_buffer_snapshot_load(spark, tmpdir_path):
    e = entries_df(spark, [(BASE_NS, "s", "old"), (BASE_NS + 100 * 3600 * SEC, "s", "new")])
    path = os.path.join(tmpdir_path, "buffer")
    store.write_buffer(e, path)
    with open(os.path.join(path, "zz.json"), "w") as out:
        out.write("{broken\n")
    good, counts = store.read_buffer(spark, path, BASE_NS + 101 * 3600 * SEC)
    assert [r.raw for r in good.collect()] == ["new"]
    assert {r.outcome: r.n for r in counts.collect()} == {"loaded": 1, "expired": 1, "malformed": 1}


def test_baseline_document_import(spark, tmpdir_path):
    doc = {"meta": {"seed_days": 3.5, "seeded": True},
           "buckets": {"journalctl": {"0_09": {"count": 3, "mean": 10.0, "M2": 8.0}}},
           "keywords": {"journalctl": {"error": {"hits": 2, "last_seen_ns": 5}}},
           "boot_windows": {"b1": {"failed": {"hits": 1, "last_seen_ns": 7}}},
           "boot_order": ["b0", "b1"]}
    path = os.path.join(tmpdir_path, "baseline.json")
    with open(path, "w") as f:
        json.dump(doc, f)
    t = store.import_baseline_document(spark, path)
    assert [tuple(r) for r in t["baseline"].collect()] == [("journalctl", "0_09", 3, 10.0, 8.0)]
    assert t["keyword_stats"].collect()[0]["hits"] == 2
    m = t["meta"].collect()[0]
    assert m.first_seen_ns == 0 and m.seed_days == 3.5 and m.direct_days == 0.0
    assert [r.boot_id for r in t["boot_order"].orderBy("boot_pos").collect()] == ["b0", "b1"]
    store.save_baseline(os.path.join(tmpdir_path, "v1"), t["baseline"], t["keyword_stats"],
                        t["boot_stats"].withColumn("first_seen_ns", F.col("last_seen_ns")), t["meta"])
    assert store.load_baseline(spark, os.path.join(tmpdir_path, "v1"))["baseline"].count() == 1


def test_aggregate_rollup_intervals(spark):
    e = entries_df(spark, [(BASE_NS + s * SEC, "x", "spam line") for s in (1, 2, 1799, 1800, 5000)])
    rules = AlertRules(aggregate={"spam": 1800})
    out = rollup.aggregate_rollup(e, rules, BASE_NS).orderBy("timestamp_ns").collect()
    assert [(r.timestamp_ns - BASE_NS) // SEC for r in out] == [1800, 3600, 5400]
    assert [r.hit_count for r in out] == [3, 1, 1]
    assert out[0].note == "3 hits aggregated over the last 1800s (quarantined keyword)"
    assert out[0].pattern_key == "aggregate:spam" and out[0].source == "aggregate"


def test_boot_windows(spark):
    rows = []
    for b in range(12):
        for j in range(3):
            rows.append((BASE_NS + b * DAY + j * SEC, f"boot{b:02d}", j * 1_000_000 + (b % 2) * 400_000_000,
                         "unit failed to start"))
    df = spark.createDataFrame(rows, "timestamp_ns long, boot_id string, monotonic_us long, raw string")
    stats = boot.boot_window_stats(df, AlertRules(), 300)
    # odd boots log at 400 s, outside the 300 s window
    assert stats.count() == 6 * 2          # 'failed to start' and 'failed'
    assert {r.hits for r in stats.collect()} == {3}
    kept = boot.retained_boot_stats(stats, 4)
    assert sorted(r.boot_id for r in kept.select("boot_id").distinct().collect()) == [
        "boot04", "boot06", "boot08", "boot10"]
    summary = boot.boot_summary(stats).collect()
    assert {r.boot_id for r in summary} == {"boot10"}


def test_rule_validation(spark):
    rules = AlertRules(watched=["error"], critical=["segfault"], noisy={"spam": (5, 60)},
                       aggregate={"x": 10})
    rdf = rules_frame(spark, rules)
    problems = {(r.keyword, r.problem) for r in rule_violations(rdf).collect()}
    assert ("segfault", "keyword not in the active set: never matches") in problems
    assert ("spam", "keyword not in the active set: never matches") in problems
    assert all(k != "error" for k, _ in problems)
