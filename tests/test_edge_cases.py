"""Edge cases: empty inputs, degenerate thresholds and rule sets."""

from tests.conftest import BASE_NS, SEC, entries_df
from vigilspark.config import AlertRules, Threshold
from vigilspark.operators import baseline as B
from vigilspark.operators import boot, rollup, threshold
from vigilspark.operators.alerts import alert_pipeline
from vigilspark.operators.match import keyword_hits, keyword_stats


def _empty(spark):
    return spark.createDataFrame([], "timestamp_ns long, source string, raw string, priority int, seq long, "
                                     "boot_id string, monotonic_us long")


def test_empty_inputs(spark):
    e = _empty(spark)
    rules = AlertRules(watched=["error", "purchase"], critical=["purchase"], aggregate={"click": 60})
    assert alert_pipeline(e, rules).count() == 0
    assert keyword_stats(keyword_hits(e, rules)).count() == 0
    assert B.slot_baseline(B.hourly_counts(e)).count() == 0
    assert B.anomaly_online(B.hourly_counts(e)).count() == 0
    assert rollup.aggregate_rollup(e, rules, BASE_NS).count() == 0
    assert boot.boot_summary(boot.boot_window_stats(e, rules)).count() == 0
    assert B.seed_days(e, BASE_NS).first().seed_days == 0.0


def test_only_immediate_tiers(spark):
    e = entries_df(spark, [(BASE_NS + i * SEC, "s", "segfault here") for i in range(3)])
    out = alert_pipeline(e, AlertRules(watched=["segfault"], critical=["segfault"])).collect()
    assert [r.hit_count for r in out] == [1, 1, 1] and {r.level for r in out} == {"TRIAGE"}


def _hits(spark, n):
    return spark.createDataFrame([("k", "PATTERN_WATCH", BASE_NS + i * SEC, i) for i in range(n)],
                                 "pattern_key string, level string, timestamp_ns long, seq long")


def test_degenerate_thresholds(spark):
    h = _hits(spark, 5)
    assert threshold.threshold_fires(h, Threshold(1, 1, 600)).count() == 5      # k = 1: every hit
    assert threshold.threshold_fires(h, Threshold(1, 0, 600)).count() == 0      # no history kept
    assert threshold.threshold_fires(h, Threshold(5, 0, 0)).count() == 5        # W = 0: always fires
    assert threshold.threshold_fires(h, Threshold(6, 6, 600)).count() == 0      # never enough hits
    assert threshold.threshold_fires(h.limit(0), Threshold(3, 5, 600)).count() == 0


def test_keyword_with_quote_and_no_exclusions(spark):
    e = entries_df(spark, [(BASE_NS, "s", "can't open disk's journal")])
    rules = AlertRules(watched=["can't open"])
    assert [r.keyword for r in keyword_hits(e, rules).collect()] == ["can't open"]


def test_results_do_not_depend_on_the_session_time_zone(spark):
    from vigilspark.plans.catalogue import QUERIES
    names = ["log_entries", "hourly_counts", "slot_baseline", "anomaly_online", "boot_window_stats",
             "aggregate_rollup", "rolling_window", "alert_pipeline", "flag_store_roundtrip", "journal_parse"]
    sf = "/root/testdata/sf0.001"

    def run_all():
        return {n: sorted(map(tuple, QUERIES[n](spark, sf).collect())) for n in names}

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    base = run_all()
    try:
        for tz in ["America/Los_Angeles", "Asia/Kolkata"]:
            spark.conf.set("spark.sql.session.timeZone", tz)
            other = run_all()
            for n in names:
                assert other[n] == base[n], (tz, n)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
