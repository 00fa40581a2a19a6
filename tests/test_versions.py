"""Versioned tables, arrival numbers, and the live jobs that use them."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import BASE_NS, SEC, entries_df
from vigilspark.config import AlertRules
from vigilspark.operators.retention import capped_buffer
from vigilspark.operators import baseline
from vigilspark.plans.jobs import close_job, merge_live_job, score_job, seed_job
from vigilspark.sources import journal, store
from vigilspark.sources.arrival import ArrivalCursor
from vigilspark.sources.versions import Superseded, VersionedTable
from vigilspark.streaming import stream

ROW = T.StructType([T.StructField("x", T.LongType())])
RULES = AlertRules(watched=["error", "view"], critical=["error"])


def values(table, **kw):
    return sorted(r.x for r in table.read(ROW, **kw).collect())


def numbers(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], ROW)


# -------------------------------------------------------------------- versions

def test_versions_add_and_replace_folders(spark, tmpdir_path):
    table = VersionedTable(spark, f"{tmpdir_path}/t")
    assert not table.exists() and values(table) == [] and table.current().number == 0
    first = table.append(numbers(spark, 1, 2))
    table.append(numbers(spark, 3))
    before = table.current()
    made = table.write(numbers(spark, 10))
    assert values(table) == [1, 2, 3]  # not committed yet
    table.append(numbers(spark, 4))    # someone else, meanwhile
    after = table.commit([made], before.folders, {"who": "compactor"})
    assert values(table) == [4, 10] and values(table, version=before) == [1, 2, 3] and after.marks == {"who": "compactor"}
    with pytest.raises(Superseded):
        table.commit([], first.folders)
    assert table.commit(marks={"b": 1}).marks == {"who": "compactor", "b": 1}


def test_a_replayed_batch_is_appended_once_even_after_its_folder_went(spark, tmpdir_path):
    table = VersionedTable(spark, f"{tmpdir_path}/t")
    assert table.append_batch(numbers(spark, 1), "s", 0) and not table.append_batch(numbers(spark, 1), "s", 0)
    table.write(numbers(spark, 99), "s-000000000001")  # a run that failed before its commit
    assert table.append_batch(numbers(spark, 2), "s", 1)
    assert values(table) == [1, 2]
    table.commit([table.write(numbers(spark, 3))], table.current().folders)
    assert not table.append_batch(numbers(spark, 2), "s", 1) and values(table) == [3]
    assert table.append_batch(numbers(spark, 7), "other", 0) and values(table) == [3, 7]


def test_concurrent_commits_lose_nothing(spark, tmpdir_path):
    path = f"{tmpdir_path}/t"
    names = [VersionedTable(spark, path).write(numbers(spark, i), f"n{i}") for i in range(6)]
    threads = [threading.Thread(target=VersionedTable(spark, path).commit, args=([n],)) for n in names[:3]]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    table = VersionedTable(spark, path)
    for n in names[3:]:
        table.commit([n])
    assert table.current().number >= 4 and set(table.current().folders) >= set(names[3:])


def test_an_unfinished_manifest_is_passed_over(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr("vigilspark.sources.versions._TRIES", 3)
    table = VersionedTable(spark, f"{tmpdir_path}/t")
    table.append(numbers(spark, 1))
    with open(f"{tmpdir_path}/t/_versions/000000000002.json", "w") as f:
        f.write('{"folders": [')
    assert values(table) == [1]
    assert table.append(numbers(spark, 2)).number == 3 and values(table) == [1, 2]


def test_prune_keeps_what_the_last_versions_name(spark, tmpdir_path):
    table = VersionedTable(spark, f"{tmpdir_path}/t")
    for i in range(5):
        table.commit([table.write(numbers(spark, i), f"f{i}")], table.current().folders)
    table.write(numbers(spark, 9), "half")
    assert table.prune(keep=2) == 3
    assert values(table) == [4] and len(table._numbers()) == 2
    assert sorted(os.listdir(f"{tmpdir_path}/t/data")) == ["part=f3", "part=f4", "part=half"]


# --------------------------------------------------------------------- arrival

def lines_file(path, lines, at):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("".join(x + "\n" for x in lines))
    os.utime(path, (at, at))


def record(s, message):
    return json.dumps({"__REALTIME_TIMESTAMP": str(BASE_NS // 1000 + s * 10**6), "MESSAGE": message, "_SYSTEMD_UNIT": "u"})


def take(spark, path, cursor, commit=True):
    entries, outcomes, done = journal.new_entries(spark, path, cursor)
    got = [(r.seq, r.raw.split(": ")[1]) for r in entries.orderBy("seq").collect()]
    counts = {r.outcome: r.n for r in outcomes.collect()}
    if commit:
        done()
    return got, counts


def test_passes_take_new_files_and_grown_ones_once(spark, tmpdir_path):
    src, cursor = f"{tmpdir_path}/j", ArrivalCursor(spark, f"{tmpdir_path}/c")
    lines_file(f"{src}/b.json", [record(5, "one"), "", record(1, "two")], 1000)
    lines_file(f"{src}/a.json", [record(9, "three"), "{cut"], 2000)
    want = [(0, "one"), (2, "two"), (3, "three")]
    assert take(spark, src, cursor, commit=False) == (want, {"loaded": 3, "blank": 1, "malformed": 1})
    # nothing was committed: the same lines come again, with the same numbers
    assert take(spark, src, cursor)[0] == want
    assert take(spark, src, cursor) == ([], {})
    lines_file(f"{src}/b.json", [record(5, "one"), "", record(1, "two"), record(0, "grown"), record(0, "grown")], 3000)
    lines_file(f"{src}/c.json", [record(7, "late")], 2500)
    assert take(spark, src, cursor)[0] == [(5, "late"), (6, "grown"), (7, "grown")]
    assert cursor.taken()[1] == 7 and {os.path.basename(r.path): r.lines for r in cursor.taken()[0].collect()} == {"a.json": 2, "b.json": 5, "c.json": 1}


def test_numbers_follow_lines_over_blocks(spark, tmpdir_path):
    src, cursor = f"{tmpdir_path}/j", ArrivalCursor(spark, f"{tmpdir_path}/c")
    lines_file(f"{src}/x.json", [record(i % 7, f"m{i}") for i in range(3000)], 1000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert take(spark, src, cursor)[0] == [(i, f"m{i}") for i in range(3000)]
        lines_file(f"{src}/x.json", [record(i % 7, f"m{i}") for i in range(5000)], 2000)
        assert take(spark, src, cursor)[0] == [(i, f"m{i}") for i in range(3000, 5000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("cap", [0, 1, 7, 40, 41, 99])
def test_cap_by_any_numbers(spark, monkeypatch, cap):
    monkeypatch.setattr("vigilspark.operators.retention.RANGE_BITS", 2)
    monkeypatch.setattr("vigilspark.operators.retention.EDGE_ROWS", 3)
    seqs = [(-1) ** i * (i * 7919 ** (i % 5)) for i in range(39)] + [(1 << 63) - 1, -(1 << 63)]
    df = entries_df(spark, [(BASE_NS, "s", "r", None, q) for q in seqs])
    got = sorted(r.seq for r in capped_buffer(df, cap).collect())
    assert got == sorted(seqs)[max(0, len(seqs) - cap):] if cap else got == []
    tied = entries_df(spark, [(BASE_NS, "s", "r", None, q) for q in [5] * 30 + [6] * 4])
    assert sorted(r.seq for r in capped_buffer(tied, cap).collect()) == sorted([5] * 30 + [6] * 4)[max(0, 34 - cap):] if cap else True


# ------------------------------------------------------------------ live tables

def flags(spark, *rows):
    return spark.createDataFrame([(BASE_NS + d * 86400 * SEC, "s", f"r{d}", 3, level, BASE_NS + d * 86400 * SEC, key, 1, "n") for d, level, key in rows],
                                 store.FLAT_FLAGS)


def days(df):
    return sorted((r.flagged_at - BASE_NS) // (86400 * SEC) for r in df.collect())


def test_archiving_takes_effect_and_keeps_what_came_meanwhile(spark, tmpdir_path, monkeypatch):
    live, archive = f"{tmpdir_path}/flags", f"{tmpdir_path}/archive"
    store.append_flags(flags(spark, (0, "TRIAGE", "a"), (8, "TRIAGE", "b")), live, "alerts", 0)
    store.append_flags(flags(spark, (9, "TRIAGE", "c")), live, "alerts", 1)
    commit, late = VersionedTable.commit, [flags(spark, (9, "TRIAGE", "meanwhile"))]

    def slow(self, add=(), remove=(), marks=None):
        if remove and late:
            store.append_flags(late.pop(), live, "alerts", 2)
        return commit(self, add, remove, marks)

    monkeypatch.setattr(VersionedTable, "commit", slow)
    assert store.archive_live(spark, live, archive, BASE_NS + 10 * 86400 * SEC, 7) == 1
    assert days(store.read_flags(spark, live)) == [8, 9, 9] and days(store.read_flags(spark, archive)) == [0]
    store.append_flags(flags(spark, (0, "TRIAGE", "a")), live, "alerts", 0)  # replayed after its flag was archived
    assert days(store.read_flags(spark, live)) == [8, 9, 9]
    assert store.archive_live(spark, live, archive, BASE_NS + 10 * 86400 * SEC, 7) == 0
    assert days(store.read_flags(spark, live, since_ns=BASE_NS + 9 * 86400 * SEC)) == [9, 9]


def test_a_pass_that_failed_in_between_archives_nothing_twice(spark, tmpdir_path, monkeypatch):
    live, archive = f"{tmpdir_path}/flags", f"{tmpdir_path}/archive"
    store.append_flags(flags(spark, (0, "TRIAGE", "a"), (8, "TRIAGE", "b")), live)
    write = VersionedTable.write
    monkeypatch.setattr(VersionedTable, "write", lambda self, df, name=None, partition_by=(): 1 / 0 if self.path == live else write(self, df, name, partition_by))
    with pytest.raises(ZeroDivisionError):
        store.archive_live(spark, live, archive, BASE_NS + 10 * 86400 * SEC, 7)
    monkeypatch.setattr(VersionedTable, "write", write)
    assert days(store.read_flags(spark, live)) == [0, 8]
    assert store.archive_live(spark, live, archive, BASE_NS + 10 * 86400 * SEC, 7) == 0
    assert days(store.read_flags(spark, live)) == [8] and days(store.read_flags(spark, archive)) == [0]


def test_clearing_a_live_table(spark, tmpdir_path):
    live, memory = f"{tmpdir_path}/flags", f"{tmpdir_path}/cleared"
    assert store.clear_live(spark, live) == 0
    store.append_flags(flags(spark, (0, "TRIAGE", "a"), (1, "PATTERN_WATCH", "b"), (2, "TRIAGE", "c")), live)
    assert store.clear_live(spark, live, "TRIAGE", memory) == 2
    assert days(store.read_flags(spark, live)) == [1] and days(store.read_flags(spark, memory)) == [0, 2]
    assert {r.pattern_key for r in store.dedup_keys(spark, live, memory).collect()} == {"a", "b", "c"}
    assert store.clear_live(spark, live) == 1 and days(store.read_flags(spark, live)) == []


def entry_rows(spark, rows):
    """rows: (second, message, boot)"""
    return journal.journal_entries(journal.parse_lines(spark.createDataFrame(
        [(json.dumps({"__REALTIME_TIMESTAMP": str(BASE_NS // 1000 + s * 10**6), "MESSAGE": m, "_BOOT_ID": b, "__MONOTONIC_TIMESTAMP": str(s * 10**6),
                      "_SYSTEMD_UNIT": "u", "PRIORITY": "3"}),) for s, m, b in rows], "value string")))


def tables(spark, path):
    state = store.load_baseline(spark, path)
    skip = ("live_batch", "observed_ns", "direct_days", "confidence", "confidence_pct", "monitoring_active")
    return {name: sorted((tuple(r) for r in df.drop(*skip).collect()), key=str) for name, df in state.items()}


def test_seed_and_live_equal_seeding_the_whole(spark, tmpdir_path):
    """Late rows, a batch in two passes, replays, compaction in between: the stored tables are those of one seeding."""
    lines = [(i * 700, ("error" if i % 3 else "view") + f" {i}", f"b{i % 4}") for i in range(60)] + [(100, "error late", "b9"), (100, "error late", "b9")]
    whole_src, part_src = f"{tmpdir_path}/whole", f"{tmpdir_path}/part"

    def export(rows, path):
        os.makedirs(path)
        with open(f"{path}/x.json", "w") as f:
            f.writelines(json.dumps({"__REALTIME_TIMESTAMP": str(BASE_NS // 1000 + s * 10**6), "MESSAGE": m, "_BOOT_ID": b,
                                     "__MONOTONIC_TIMESTAMP": str(s * 10**6), "_SYSTEMD_UNIT": "u", "PRIORITY": "3"}) + "\n" for s, m, b in rows)

    export(lines, whole_src)
    export(lines[:25], part_src)
    as_of, state = BASE_NS + 10 * 86400 * SEC, f"{tmpdir_path}/state"
    seed_job(spark, whole_src, f"{tmpdir_path}/v_whole", RULES, as_of)
    seed_job(spark, part_src, f"{tmpdir_path}/v0", RULES, as_of)
    sink = stream.state_sink(state, RULES, BASE_NS, 300)
    for batch, (a, b) in enumerate([(25, 30), (30, 30), (30, 50)]):
        sink(entry_rows(spark, lines[a:b]), batch)
    sink(entry_rows(spark, lines[30:50]), 2)  # replayed
    merge_live_job(spark, state, f"{tmpdir_path}/v0", f"{tmpdir_path}/v1", as_of)
    merge_live_job(spark, state, f"{tmpdir_path}/v0", f"{tmpdir_path}/v1b", as_of)  # run twice from the same version
    assert tables(spark, f"{tmpdir_path}/v1") == tables(spark, f"{tmpdir_path}/v1b")
    hours = sorted(map(tuple, stream.hourly_state(spark, state).collect()))
    done = stream.compact_sums(spark, state, after=-1, at_least=2)
    assert done["hourly"] == 3 and sorted(map(tuple, stream.hourly_state(spark, state).collect())) == hours
    sink(entry_rows(spark, lines[50:55]), 3)
    sink(entry_rows(spark, lines[55:]), 4)
    merged = merge_live_job(spark, state, f"{tmpdir_path}/v1", f"{tmpdir_path}/v2", as_of).first()
    assert tables(spark, f"{tmpdir_path}/v2") == tables(spark, f"{tmpdir_path}/v_whole")
    assert merged.live_batch == 4
    # the batches' stretches of time: 25-29, 30-49, 50-54, and 55-59 with the late row
    stretches = [4 * 700, 19 * 700, 4 * 700, 59 * 700 - 100]
    assert merged.observed_ns == sum(stretches) * SEC and merged.direct_days == pytest.approx(sum(stretches) / 86400)
    again = merge_live_job(spark, state, f"{tmpdir_path}/v2", f"{tmpdir_path}/v3", as_of).first()
    assert again == merged and tables(spark, f"{tmpdir_path}/v3") == tables(spark, f"{tmpdir_path}/v2")
    # seeding the whole export after that adds nothing
    seed_job(spark, whole_src, f"{tmpdir_path}/v4", RULES, as_of, previous=f"{tmpdir_path}/v3")
    assert tables(spark, f"{tmpdir_path}/v4") == tables(spark, f"{tmpdir_path}/v3")


def test_a_batch_that_only_some_tables_have_waits(spark, tmpdir_path):
    as_of, state, src = BASE_NS + 86400 * SEC, f"{tmpdir_path}/state", f"{tmpdir_path}/src"
    lines_file(f"{src}/x.json", [record(1, "error a")], 1000)
    seed_job(spark, src, f"{tmpdir_path}/v0", RULES, as_of)
    sink = stream.state_sink(state, RULES, BASE_NS, 300)
    sink(entry_rows(spark, [(50, "error b", "b")]), 0)
    sums = stream.batch_sums(entry_rows(spark, [(60, "error c", "b")]), RULES, 300)
    VersionedTable(spark, f"{state}/hourly").append_batch(sums["hourly"], "batch", 1)  # the sink died here
    meta = merge_live_job(spark, state, f"{tmpdir_path}/v0", f"{tmpdir_path}/v1", as_of).first()
    assert meta.live_batch == 0 and store.load_baseline(spark, f"{tmpdir_path}/v1")["hourly"].agg(F.sum("n")).first()[0] == 2
    sink(entry_rows(spark, [(60, "error c", "b")]), 1)
    meta = merge_live_job(spark, state, f"{tmpdir_path}/v1", f"{tmpdir_path}/v2", as_of).first()
    assert meta.live_batch == 1 and store.load_baseline(spark, f"{tmpdir_path}/v2")["hourly"].agg(F.sum("n")).first()[0] == 3


def test_close_job_twice(spark, tmpdir_path):
    state = f"{tmpdir_path}/state"
    store.append_flags(flags(spark, (0, "TRIAGE", "a"), (8, "TRIAGE", "b")), f"{state}/flags", "alerts", 0)
    done = close_job(spark, state, BASE_NS + 10 * 86400 * SEC)
    assert done["archived"] == 1 and done["live"] == f"{state}/flags"
    assert days(store.read_flags(spark, done["live"])) == [8]
    time.sleep(0.01)
    assert close_job(spark, state, BASE_NS + 10 * 86400 * SEC)["archived"] == 0
    assert days(store.read_flags(spark, f"{state}/archive")) == [0]


def test_hours_are_scored_once_when_they_close(spark, tmpdir_path):
    src, state, hour = f"{tmpdir_path}/src", f"{tmpdir_path}/state", 3600
    week = 7 * 24 * hour
    # four weeks with 2, 3, 2, 3 rows in the first hour of Monday, then a week with 9
    lines_file(f"{src}/x.json", [record(w * week + i, "view") for w, n in enumerate([2, 3, 2, 3]) for i in range(n)], 1000)
    seed_job(spark, src, f"{tmpdir_path}/v", RULES, BASE_NS + 30 * 86400 * SEC)
    sink, at = stream.state_sink(state, RULES, BASE_NS, 300), 4 * week
    sink(entry_rows(spark, [(at + i, "view", "b") for i in range(5)] + [(at + hour + 5, "view", "b")]), 0)

    def score(s):
        return {(r.hour_ns - BASE_NS) // SEC - at: (r.n, r.anomalous) for r in
                score_job(spark, state, f"{tmpdir_path}/v", BASE_NS + s * SEC, 600, min_samples=3).collect()}

    assert score(at + hour + 599) == {}                       # not closed yet
    sink(entry_rows(spark, [(at + 50 + i, "view", "b") for i in range(4)]), 1)  # late, but in time
    assert score(at + hour + 600) == {0: (9, True)}
    sink(entry_rows(spark, [(at + 60, "view", "b")]), 2)      # too late
    assert score(at + hour + 700) == {0: (9, True)}
    assert score(at + 2 * hour + 600) == {0: (9, True), hour: (1, False)}


def test_scoring_in_parts_equals_scoring_the_whole(spark):
    rows = [("s" if i % 3 else "t", i * 3600 * SEC * 24 * 7, f"0_{i % 2}", (i * 37) % 11) for i in range(40)]
    hours = spark.createDataFrame(rows, "source string, hour_ns long, slot_key string, n long")
    whole = sorted(map(tuple, baseline.anomaly_online(hours, 3, 1.0).collect()))
    state, got = baseline.slot_baseline(hours.limit(0)), []
    for a, b in ((0, 7), (7, 7), (7, 31), (31, 40)):
        part = spark.createDataFrame(rows[a:b], hours.schema)
        got += map(tuple, baseline.anomaly_continued(part, state, 3, 1.0).collect())
        state = baseline.merge_baselines(state, baseline.slot_baseline(part))
    assert len(got) == len(whole) and any(r[-1] for r in whole)
    for mine, other in zip(sorted(got), whole):
        assert mine[:5] == other[:5] and mine[7] == other[7]
        assert mine[5] == (None if other[5] is None else pytest.approx(other[5])) and mine[6] == pytest.approx(other[6], abs=1e-9)


def test_a_small_export_reads_and_writes_only_its_days(spark, tmpdir_path):
    day = 86400
    lines_file(f"{tmpdir_path}/a/x.json", [record(d * day + i, f"error {i}") for d in range(5) for i in range(4)], 1000)
    lines_file(f"{tmpdir_path}/b/x.json", [record(2 * day + i, f"error {i}") for i in range(6)] + [record(9 * day, "error")], 1000)
    v1, v2 = f"{tmpdir_path}/v1", f"{tmpdir_path}/v2"
    seed_job(spark, f"{tmpdir_path}/a", v1, RULES, BASE_NS + 30 * day * SEC)
    seed_job(spark, f"{tmpdir_path}/b", v2, RULES, BASE_NS + 30 * day * SEC, previous=v1)
    first = BASE_NS // (day * SEC)
    assert sorted(n for n in os.listdir(f"{v2}/seen") if n.startswith("day=")) == [f"day={first + 2}", f"day={first + 9}"]
    assert store.load_baseline(spark, v2)["seen"].agg(F.sum("n")).first()[0] == 23
    assert store.read_seen(spark, v2, {first + 2}).count() == 6 and store.read_seen(spark, v2, {first}).count() == 4
    assert store.load_baseline(spark, v2)["hourly"].agg(F.sum("n")).first()[0] == 23
    # a day replaced in a folder leaves the version before as it was
    assert store.load_baseline(spark, v1)["seen"].agg(F.sum("n")).first()[0] == 20


def test_live_outcomes_count_each_line_once(spark, tmpdir_path):
    lines = [record(1, "error"), "", "{cut", record(2, "view"), record(3, "view").replace('"17', '"x17'), "[1]"]
    parsed = journal.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    sink, state = stream.state_sink(f"{tmpdir_path}/s", RULES, BASE_NS, 300), f"{tmpdir_path}/s"
    for batch in (0, 0, 1, 1):  # both replayed
        sink(parsed, batch)
    got = {r.outcome: r.n for r in stream.outcome_counts(spark, state).collect()}
    want = {r.outcome: 2 * r.n for r in journal.reject_counts(parsed).collect()}
    assert got == want and got["blank"] == 2 and got["bad_timestamp"] == 2 and got["loaded"] >= 4
    assert stream.hourly_state(spark, state).agg(F.sum("n")).first()[0] == got["loaded"] + got["bad_timestamp"]
