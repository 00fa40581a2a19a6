"""T6 option: correlation that must span several sources, against a
checker written from the definition."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import BASE_NS, SEC, fires_by_definition
from vigilspark.config import Threshold
from vigilspark.operators.correlation import distinct_source_fires


def brute(rows, k, n, w_s, m=2):
    """Fires of every key by the definition (see conftest)."""
    return sorted((key, t, s, c) for key in {r[0] for r in rows}
                  for t, s, c in fires_by_definition([(t, s, src) for key2, t, s, src in rows if key2 == key], k, n, w_s, m))


def run(spark, rows, th, m=2, **kw):
    df = spark.createDataFrame([(k, "CORRELATION", int(t), int(s), src) for k, t, s, src in rows],
                               "pattern_key string, level string, timestamp_ns long, seq long, source string")
    out = distinct_source_fires(df, th, m, **kw).collect()
    return sorted((r.pattern_key, r.timestamp_ns, r.seq, r.hit_count) for r in out)


def test_single_source_never_fires(spark):
    rows = [("infra", BASE_NS + i * SEC, i, "svc_0") for i in range(10)]
    assert run(spark, rows, Threshold(2, 3, 300)) == []


def test_two_sources_fire_and_count_can_exceed_k(spark):
    rows = [("infra", BASE_NS + i * SEC, i, "svc_0") for i in range(3)] + [("infra", BASE_NS + 3 * SEC, 3, "svc_1")]
    got = run(spark, rows, Threshold(2, 5, 300))
    assert got == [("infra", BASE_NS + 3 * SEC, 3, 4)]
    assert got == brute(rows, 2, 5, 300)


def test_history_cap_drops_the_other_source(spark):
    # n = 2: by the time svc_0 repeats, only svc_0 hits are retained
    rows = [("k", BASE_NS, 0, "a"), ("k", BASE_NS + SEC, 1, "b"), ("k", BASE_NS + 2 * SEC, 2, "b")]
    assert run(spark, rows, Threshold(3, 2, 60)) == brute(rows, 3, 2, 60) == []
    assert run(spark, rows, Threshold(2, 2, 60)) == brute(rows, 2, 2, 60)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["x", "y"]), st.integers(0, 2000), st.sampled_from(["a", "a", "b", "c"])),
                min_size=1, max_size=120),
       st.integers(1, 4), st.integers(0, 3), st.sampled_from([5, 60, 600]),
       st.sampled_from([7, 10_000]), st.sampled_from([2, 3]))
def test_property_matches_brute_force(spark, raw, k, extra, w, block, m):
    rows = [(key, BASE_NS + t * SEC // 3, i, src) for i, (key, t, src) in enumerate(raw)]
    n = k + extra
    assert run(spark, rows, Threshold(k, n, w), m, block_rows=block) == brute(rows, k, n, w, m)
