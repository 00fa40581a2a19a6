import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

BASE_NS = 1_704_067_200 * 1_000_000_000  # 2024-01-01T00:00:00Z, a Monday
SEC = 1_000_000_000


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[*]")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.streaming.stateStore.providerClass",
                     "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="vigil-test-ckpt-", dir="/tmp"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    yield spark


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="vigil-test-", dir="/tmp")


def entries_df(spark, rows):
    """rows: (timestamp_ns, source, raw, priority[, seq])"""
    out = []
    for i, r in enumerate(rows):
        ts, src, raw = r[0], r[1], r[2]
        pr = r[3] if len(r) > 3 else None
        seq = r[4] if len(r) > 4 else i
        out.append((int(ts), src, raw, pr, int(seq)))
    return spark.createDataFrame(out, "timestamp_ns long, source string, raw string, priority int, seq long")


def fires_by_definition(hits, k, n, window_s, sources=1):
    """hits: (time, order, source) of one key -> [(time, order, hits counted)].

    From the definition: a hit counts the hits since the last fire that are
    among the last n and not older than the window; it fires if they number k
    and come from enough sources; times that fired are skipped.
    """
    fired, since = [], 0
    ordered = sorted(hits)
    for i, (t, order, _) in enumerate(ordered):
        if any(t == f[0] for f in fired[-1:]):
            since = i + 1
            continue
        counted = [h for h in ordered[max(since, i - n + 1):i + 1] if h[0] >= t - window_s * SEC]
        enough = len(counted) >= k and len({h[2] for h in counted}) >= sources
        if window_s == 0 or (n >= 1 and enough):
            fired.append((t, order, 1 if window_s == 0 else len(counted)))
            since = i + 1
    return fired
