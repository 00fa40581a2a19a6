"""Baselines, anomaly tests, keyword stats and confidence."""

import math

from pyspark.sql import functions as F

from tests.conftest import BASE_NS, SEC, entries_df
from vigilspark.config import AlertRules, BOOT_KEYWORDS, DEFAULT_KEYWORDS
from vigilspark.functions.columns import confidence, confidence_pct, monitoring_active
from vigilspark.operators import baseline as B
from vigilspark.operators import match as M

HOUR = 3600 * SEC


def hourly_from_counts(spark, source, slot_hours, counts):
    rows = [(source, h, c) for h, c in zip(slot_hours, counts)]
    df = spark.createDataFrame(rows, "source string, hour_ns long, n long")
    return df.withColumn("slot_key", F.lit("0_09"))


def test_bucket_statistics(spark):
    counts = [2, 4, 4, 4, 5, 5, 7, 9]
    h = hourly_from_counts(spark, "s", [BASE_NS + i * 7 * 24 * HOUR for i in range(8)], counts)
    b = B.with_stddev(B.slot_baseline(h)).collect()[0]
    assert b["count"] == 8
    assert b["mean"] == 5.0
    assert math.isclose(b["stddev"], 2.1381, abs_tol=1e-4)


def _score(spark, history, value, min_samples=7):
    h = hourly_from_counts(spark, "s", [BASE_NS + i * HOUR for i in range(len(history))], history)
    base = B.slot_baseline(h)
    probe = spark.createDataFrame([("s", "0_09", value)], "source string, slot_key string, n long")
    return B.anomaly_scored(probe, base, min_samples=min_samples).collect()[0]["anomalous"]


def test_anomaly_detection(spark):
    assert _score(spark, [10] * 10, 11) is True          # stddev 0: anything above the mean
    assert _score(spark, [10] * 10, 10) is False
    hist = [2, 4, 4, 4, 5, 5, 7, 9, 5, 5]
    assert _score(spark, hist, 8) is False
    assert _score(spark, hist, 20) is True
    assert _score(spark, [1, 2, 3, 4, 5, 6], 10_000) is False   # 6 samples: never


def test_store_bucket_and_unknowns(spark):
    hist = [10, 12, 8] + [10] * 7
    assert _score(spark, hist, 11) is False
    assert _score(spark, hist, 500) is True
    h = hourly_from_counts(spark, "journalctl", [BASE_NS + i * HOUR for i in range(10)], hist)
    base = B.slot_baseline(h)
    probe = spark.createDataFrame([("other", "0_09", 500), ("journalctl", "3_04", 500)],
                                  "source string, slot_key string, n long")
    assert [r.anomalous for r in B.anomaly_scored(probe, base).collect()] == [False, False]


def test_inactive_store_never_scores(spark):
    h = hourly_from_counts(spark, "s", [BASE_NS + i * HOUR for i in range(10)], [10] * 10)
    active = spark.createDataFrame([(False,)], "monitoring_active boolean")
    probe = spark.createDataFrame([("s", "0_09", 500)], "source string, slot_key string, n long")
    assert B.anomaly_scored(probe, B.slot_baseline(h), active).collect()[0]["anomalous"] is False


def test_merge_equals_whole(spark):
    counts = [3, 9, 4, 1, 7, 7, 2, 8, 5]
    h = hourly_from_counts(spark, "s", [BASE_NS + i * HOUR for i in range(9)], counts)
    whole = B.slot_baseline(h).collect()[0]
    a = B.slot_baseline(h.filter(F.col("n") < 5))
    b = B.slot_baseline(h.filter(F.col("n") >= 5))
    m = B.merge_baselines(a, b).collect()[0]
    assert m["count"] == whole["count"]
    assert math.isclose(m["mean"], whole["mean"])
    assert math.isclose(m["m2"], whole["m2"])


def test_slot_key_monday_zero_and_hourly(spark):
    # 2024-01-01 is a Monday: 09:15 -> slot 0_09
    e = entries_df(spark, [(BASE_NS + 9 * HOUR + 15 * 60 * SEC, "s", "x"),
                           (BASE_NS + 9 * HOUR + 50 * 60 * SEC, "s", "y"),
                           (BASE_NS + 2 * 24 * HOUR + 23 * HOUR, "s", "z")])
    rows = sorted((r.slot_key, r.n) for r in B.hourly_counts(e).collect())
    assert rows == [("0_09", 2), ("2_23", 1)]


def test_online_scoring_uses_prior_samples_only(spark):
    hours = [BASE_NS + i * 7 * 24 * HOUR for i in range(5)]
    h = hourly_from_counts(spark, "s", hours, [10, 10, 10, 10, 50])
    out = B.anomaly_online(h, min_samples=3).orderBy("hour_ns").collect()
    assert [r.anomalous for r in out] == [False, False, False, False, True]
    assert [r.prior_samples for r in out] == [0, 1, 2, 3, 4]


def test_keyword_stats_and_lookup(spark):
    e = entries_df(spark, [(BASE_NS, "journalctl", "kernel: ERROR here"),
                           (BASE_NS + SEC, "journalctl", "disk error again"),
                           (BASE_NS + 2 * SEC, "auth.log", "Failed password for root")])
    rules = AlertRules(watched=["error", "failed password"])
    stats = M.keyword_stats(M.keyword_hits(e, rules))
    probes = spark.createDataFrame([("journalctl", "error"), ("auth.log", "failed password"),
                                    ("auth.log", "error")], "source string, keyword string")
    got = {(r.source, r.keyword): r.hits for r in M.keyword_hit_count(stats, probes).collect()}
    assert got == {("journalctl", "error"): 2, ("auth.log", "failed password"): 1, ("auth.log", "error"): 0}
    last = {(r.source, r.keyword): r.last_seen_ns for r in stats.collect()}
    assert last[("journalctl", "error")] == BASE_NS + SEC


def test_active_keyword_list():
    cfg = AlertRules()
    assert cfg.active_keywords[: len(set(DEFAULT_KEYWORDS))] == list(dict.fromkeys(DEFAULT_KEYWORDS))
    assert all(k in cfg.active_keywords for k in BOOT_KEYWORDS)
    assert len(cfg.active_keywords) == len(set(cfg.active_keywords))
    custom = AlertRules(watched=["Foo", "bar"], user_keywords=["baz"])
    assert custom.active_keywords == ["foo", "bar"] + BOOT_KEYWORDS
    custom.power_mode = True
    assert custom.active_keywords[-1] == "baz"


def test_scan_lines_and_exclusions(spark):
    e = entries_df(spark, [(BASE_NS, "journalctl", "kernel: buffer overrun detected in driver"),
                           (BASE_NS, "journalctl", "systemd: started session 42"),
                           (BASE_NS, "journalctl", "kernel: i/o error on disk, filesystem corrupted"),
                           (BASE_NS, "journalctl", "ui: error in theme_probe frame")])
    rules = AlertRules(exclusions={"error": "theme_probe"})
    got = sorted((r.seq, r.keyword) for r in M.keyword_hits(e, rules).collect())
    assert got == [(0, "buffer overrun"), (2, "corrupted"), (2, "error"), (2, "i/o error")]


def test_aggregate_keywords_ignore_exclusions(spark):
    e = entries_df(spark, [(BASE_NS, "x", "Spam Line From A Buggy Daemon")])
    rules = AlertRules(watched=["spam"], aggregate={"Spam Line From A Buggy Daemon": 1800},
                       exclusions={"spam": "spam line from a buggy daemon"})
    assert [r.keyword for r in M.aggregate_hits(e, rules).collect()] == [
        "spam line from a buggy daemon"]
    assert [r.keyword for r in M.keyword_hits(e, rules).collect()] == []


def test_confidence_table(spark):
    cases = [(0, 0, 0.0, 0, False), (7, 0, 0.2, 20, True), (7, 7, 0.5, 50, True),
             (14, 14, 1.0, 100, True), (100, 100, 1.0, 100, True), (4, 0, 4 / 14 * 0.4, 11, True)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b, *_ in cases], "s double, d double")
    out = df.select(confidence("s", "d").alias("c")).select(
        "c", confidence_pct("c").alias("p"), monitoring_active("c").alias("a")).collect()
    for (s, d, c, p, a), r in zip(cases, out):
        assert math.isclose(r.c, c)
        assert r.p == p
        assert r.a == a
