"""Rolling buffer (R1–R4) and pause windows."""

from tests.conftest import BASE_NS, SEC, entries_df
from vigilspark.operators import retention as R

HOUR = 3600 * SEC
NOW = BASE_NS + 300 * HOUR


def aged(spark, hours):
    return entries_df(spark, [(NOW - int(h * HOUR), "test", f"aged {h}h", 6) for h in hours])


def test_count_cap(spark):
    e = aged(spark, [0.001 * i for i in range(150)])
    kept = R.capped_buffer(e, 100).collect()
    assert len(kept) == 100
    assert min(r.seq for r in kept) == 50          # oldest arrivals dropped first


def test_time_window_expiry(spark):
    e = aged(spark, [1, 47.9, 48.1, 200])
    assert sorted(r.raw for r in R.rolling_window(e, NOW).collect()) == ["aged 1h", "aged 47.9h"]


def test_boundary_inclusive(spark):
    e = aged(spark, [48])
    assert R.rolling_window(e, NOW).count() == 1


def test_mixed_ages(spark):
    e = aged(spark, [1, 50, 2, 100, 47, 49, 3, 200, 48.1, 0.5])
    assert R.rolling_window(e, NOW).count() == 5


def test_both_bounds(spark):
    e = aged(spark, [0.01 * i for i in range(30)] + [60, 70])
    out = R.capped_buffer(R.rolling_window(e, NOW), 10).collect()
    assert len(out) == 10 and max(r.seq for r in out) == 29


def test_incremental_and_pause(spark):
    e = entries_df(spark, [(BASE_NS + i * HOUR, "s", f"l{i}", 6, i) for i in range(10)])
    assert [r.seq for r in R.incremental_batch(e, 6).orderBy("seq").collect()] == [7, 8, 9]
    pauses = R.pause_frame(spark, [(BASE_NS + 2 * HOUR, BASE_NS + 4 * HOUR)])
    kept = sorted(r.seq for r in R.pause_filtered(e, pauses).collect())
    assert kept == [0, 1, 4, 5, 6, 7, 8, 9]          # end exclusive
