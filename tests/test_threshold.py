"""Threshold fold (T2/T3/T5/T7/T8): the original tool's alert scenarios as
DataFrame tests, plus property tests against a plain Python fold."""

import bisect
import random

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import BASE_NS, SEC, fires_by_definition
from vigilspark.config import Threshold
from vigilspark.operators import threshold as TH
from vigilspark.operators.threshold import threshold_fires, window_hit_count


def hits_df(spark, rows):
    """rows: (pattern_key, timestamp_ns, seq)"""
    return spark.createDataFrame(
        [(k, "PATTERN_WATCH", int(t), int(s)) for k, t, s in rows],
        "pattern_key string, level string, timestamp_ns long, seq long")


def fires(spark, rows, th, **kw):
    out = threshold_fires(hits_df(spark, rows), th, **kw).orderBy("pattern_key", "timestamp_ns", "seq")
    return [(r.pattern_key, r.timestamp_ns, r.seq, r.hit_count) for r in out.collect()]


def python_fold(rows, k, n, w_s):
    """Fires of every key by the definition (see conftest)."""
    return sorted((key, t, s, c) for key in {r[0] for r in rows}
                  for t, s, c in fires_by_definition([(t, s, "") for key2, t, s in rows if key2 == key], k, n, w_s))


def test_triage_fires_immediately(spark):
    got = fires(spark, [("test:critical", BASE_NS, 0)], Threshold(1, 1, 0))
    assert got == [("test:critical", BASE_NS, 0, 1)]


def test_pattern_watch_three_of_five(spark):
    rows = [("journalctl:buffer_overrun", BASE_NS + i * SEC, i) for i in range(3)]
    got = fires(spark, rows, Threshold(3, 5, 600))
    assert got == [("journalctl:buffer_overrun", BASE_NS + 2 * SEC, 2, 3)]
    # two hits do not fire
    assert fires(spark, rows[:2], Threshold(3, 5, 600)) == []


def test_correlation_two_of_three(spark):
    rows = [("multi:disk+kernel", BASE_NS, 0), ("multi:disk+kernel", BASE_NS + 10 * SEC, 1)]
    assert len(fires(spark, rows, Threshold(2, 3, 300))) == 1


def test_hits_outside_window_dont_count(spark):
    # (3, 5, 5 s): two hits 10 s old and one fresh -> no fire
    rows = [("test:x", BASE_NS, 0), ("test:x", BASE_NS + 1, 1), ("test:x", BASE_NS + 10 * SEC, 2)]
    assert fires(spark, rows, Threshold(3, 5, 5)) == []


def test_window_boundary_is_inclusive(spark):
    rows = [("k", BASE_NS, 0), ("k", BASE_NS + 5 * SEC, 1), ("k", BASE_NS + 10 * SEC, 2)]
    assert len(fires(spark, rows, Threshold(3, 5, 10))) == 1
    assert fires(spark, rows, Threshold(3, 5, 9)) == []


def test_window_resets_after_fire(spark):
    rows = [("k", BASE_NS + i * SEC, i) for i in range(5)]
    got = fires(spark, rows, Threshold(3, 5, 600))
    assert [g[2] for g in got] == [2]          # 4th and 5th hit start a new window
    rows6 = [("k", BASE_NS + i * SEC, i) for i in range(6)]
    assert [g[2] for g in fires(spark, rows6, Threshold(3, 5, 600))] == [2, 5]


def test_samples_below_required_never_fires(spark):
    rows = [("k", BASE_NS + i * SEC, i) for i in range(10)]
    assert fires(spark, rows, Threshold(3, 2, 600)) == []


def test_dedup_equal_timestamps(spark):
    # k=2: the fire at t=5 s blocks the later hits with the same timestamp
    rows = [("k", BASE_NS + 5 * SEC, i) for i in range(4)]
    got = fires(spark, rows, Threshold(2, 3, 60))
    assert got == [("k", BASE_NS + 5 * SEC, 1, 2)]
    assert python_fold(rows, 2, 3, 60) == got


def test_triage_dedup_same_timestamp(spark):
    rows = [("k", BASE_NS, 3), ("k", BASE_NS, 1), ("k", BASE_NS + 1, 2)]
    got = fires(spark, rows, Threshold(1, 1, 0))
    assert [(g[1], g[2]) for g in got] == [(BASE_NS, 1), (BASE_NS + 1, 2)]


def test_hot_key_many_chunks_matches_python(spark):
    rnd = random.Random(7)
    t = BASE_NS
    rows = []
    for i in range(3000):
        t += rnd.choice([1, 2, 5, 30, 200, 900]) * SEC
        rows.append(("hot", t, i))
    for i in range(200):
        rows.append(("cold", BASE_NS + rnd.randint(0, 10**6) * SEC, 10_000 + i))
    expect = python_fold(rows, 3, 5, 600)
    got = fires(spark, rows, Threshold(3, 5, 600), block_rows=97)
    assert got == expect


def test_resets_cut_the_window(spark):
    rows = [("k", BASE_NS + i * SEC, i) for i in range(4)]
    resets = spark.createDataFrame([("k", "PATTERN_WATCH", BASE_NS + 2 * SEC)],
                                   "pattern_key string, level string, at_ns long")
    got = threshold_fires(hits_df(spark, rows), Threshold(3, 5, 600), resets=resets).collect()
    assert got == []            # two hits before the reset, two after
    rows.append(("k", BASE_NS + 4 * SEC, 4))
    got = threshold_fires(hits_df(spark, rows), Threshold(3, 5, 600), resets=resets).collect()
    assert [r.seq for r in got] == [4]


def test_reset_without_level_applies_to_all_levels(spark):
    rows = [("k", BASE_NS + i * SEC, i) for i in range(5)]
    resets = spark.createDataFrame([("k", None, BASE_NS + 2 * SEC)],
                                   "pattern_key string, level string, at_ns long")
    got = threshold_fires(hits_df(spark, rows), Threshold(3, 5, 600), resets=resets).collect()
    assert [r.seq for r in got] == [4]
    other = spark.createDataFrame([("k", "TRIAGE", BASE_NS + 2 * SEC)], "pattern_key string, level string, at_ns long")
    got = threshold_fires(hits_df(spark, rows), Threshold(3, 5, 600), resets=other).collect()
    assert [r.seq for r in got] == [2]          # a reset of another level does not cut


def test_window_hit_count(spark):
    rows = [("k", BASE_NS + i * 1000 * SEC, i) for i in range(6)]
    df = hits_df(spark, rows).drop("level")
    got = window_hit_count(df, 2500, ("pattern_key",)).orderBy("seq").collect()
    assert [r.hits_in_window for r in got] == [1, 2, 3, 3, 3, 3]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 4000), st.integers(0, 3)),
                min_size=1, max_size=120),
       st.integers(1, 4), st.integers(0, 3), st.sampled_from([0, 5, 60, 600]),
       st.sampled_from([7, 10_000]))
def test_property_matches_python_fold(spark, raw, k, extra_n, w, block):
    rows = [(key, BASE_NS + t * SEC // 4, i) for i, (key, t, _) in enumerate(raw)]
    n = k + extra_n
    expect = python_fold(rows, k, n, w)
    got = fires(spark, rows, Threshold(k, n, w), block_rows=block)
    if w != 0:
        got = [(a, b, c, d) for a, b, c, d in got]
    assert [(a, b, c) for a, b, c, _ in got] == [(a, b, c) for a, b, c, _ in expect]
    assert [d for *_, d in got] == [d for *_, d in expect]


@pytest.mark.parametrize("k,n", [(1, 3), (3, 5), (7, 7)])
def test_bursts_ties_and_sparse_keys_split_by_row_count(spark, monkeypatch, k, n):
    rnd = random.Random(3)
    rows = [("hot", BASE_NS, 0)] + [("hot", BASE_NS + 10**9 * SEC + rnd.randrange(400) * SEC, i) for i in range(1, 900)]
    rows += [("tie", BASE_NS + 5 * SEC, 2000 + i) for i in range(400)] + [("tie", BASE_NS + 6 * SEC, 2400 + i) for i in range(3)]
    rows += [(f"cold{i}", BASE_NS + j * 30 * SEC, 5000 + 10 * i + j) for i in range(40) for j in range(4)]
    block = TH._Block

    class Watched(block):
        def __init__(self, pdf, block_rows, reach):
            assert len(pdf) <= block_rows + reach
            super().__init__(pdf, block_rows, reach)

    monkeypatch.setattr(TH, "_Block", Watched)
    monkeypatch.setattr(TH, "FAN", 3)
    assert fires(spark, rows, Threshold(k, n, 600), block_rows=16) == python_fold(rows, k, n, 600)


def test_identical_records_fire_once(spark):
    rows = [("k", BASE_NS + s * SEC, s) for s in (0, 1, 2, 2)]
    df = hits_df(spark, rows).withColumn("rid", F.monotonically_increasing_id())
    got = threshold_fires(df, Threshold(3, 5, 600)).collect()
    assert len(got) == 1 and got[0].seq == 2


def test_many_resets_of_one_key(spark):
    rnd = random.Random(11)
    rows = [("k", BASE_NS + rnd.randrange(2000) * SEC, i) for i in range(400)]
    marks = sorted({BASE_NS + rnd.randrange(2000) * SEC for _ in range(60)})
    resets = spark.createDataFrame([("k", None, m) for m in marks], "pattern_key string, level string, at_ns long")
    want = []
    for a, b in zip([0, *marks], [*marks, 10**30]):
        part = [(t, s, "") for _, t, s in rows if a <= t < b]
        want += [(t, s) for t, s, _ in fires_by_definition(part, 3, 5, 300)]
    got = threshold_fires(hits_df(spark, rows), Threshold(3, 5, 300), resets=resets, block_rows=64).collect()
    assert sorted((r.timestamp_ns, r.seq) for r in got) == sorted(want)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 3000)), min_size=1, max_size=150),
       st.sampled_from([1, 30, 600]), st.sampled_from([None, 7, 100]))
def test_window_hit_count_matches_brute_force(spark, raw, w, bucket):
    rows = [(key, BASE_NS + t * SEC, i) for i, (key, t) in enumerate(raw)]
    df = hits_df(spark, rows).drop("level")
    got = {r.seq: r.hits_in_window for r in window_hit_count(df, w, ("pattern_key",)).collect()}
    expect = {s: sum(1 for k2, t2, _ in rows if k2 == k and t - w * SEC <= t2 <= t) for k, t, s in rows}
    assert got == expect


def test_hits_and_resets_in_one_window_make_no_product(spark):
    """3 000 hits and 3 000 resets of one key within one window; partitions cut the key."""
    rng = random.Random(9)
    times = sorted(rng.randrange(10**6) for _ in range(3000))
    marks = sorted(rng.randrange(10**6) for _ in range(3000))
    rows = spark.createDataFrame([(1, t) for t in times] + [(2, t) for t in times[:50]], "kh long, t long").withColumn("pattern_key", F.concat(F.lit("k"), "kh"))
    resets = spark.createDataFrame([("k1", m) for m in marks] + [("k2", times[7]), ("k9", 0)], "pattern_key string, at_ns long")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.kh, r.t): r.reset for r in TH._last_resets(rows, resets, ["pattern_key"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = {}
    for t in times:
        if (i := bisect.bisect_right(marks, t)):
            want[1, t] = marks[i - 1]
    want |= {(2, t): times[7] for t in times[:50] if t >= times[7]}
    assert got == want
