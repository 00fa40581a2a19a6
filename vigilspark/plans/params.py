"""Parameters of the query catalogue (fixed values of the test fixtures)."""

from __future__ import annotations

import datetime as _dt

from vigilspark.config import AlertRules, CorrelationGroup, NS_PER_SECOND, Threshold, fixture_rules


def utc_ns(text: str) -> int:
    """ISO timestamp (UTC) -> ns since the epoch."""
    d = _dt.datetime.fromisoformat(text).replace(tzinfo=_dt.timezone.utc)
    return int(d.timestamp()) * NS_PER_SECOND


RULES = fixture_rules()
AS_OF_NS = utc_ns("2024-01-31T00:00:00")
RETENTION_HOURS = 48
BUFFER_CAP = 500
ARCHIVE_DAYS = 7
FLAG_SINCE_NS = utc_ns("2024-01-20T00:00:00")
ANOMALY_MIN_SAMPLES = 3
ANOMALY_SENSITIVITY = 2.0
BOOT_WINDOW_SECONDS = 3600
BOOTS_KEPT = 10
AGG_ANCHOR_NS = utc_ns("2024-01-01T00:00:00")
# first half / second half split for merge and train/score queries
MERGE_SPLIT_NS = utc_ns("2024-01-15T00:00:00")
TRAIN_END_NS = utc_ns("2024-01-22T00:00:00")
INCREMENTAL_HWM_BEFORE_NS = utc_ns("2024-01-15T00:00:00")
PAUSES = [
    (utc_ns("2024-01-10T00:00:00"), utc_ns("2024-01-10T06:00:00")),
    (utc_ns("2024-01-20T12:00:00"), utc_ns("2024-01-20T18:00:00")),
]
DOC_KEYWORDS = ["the", "tion", "eau"]
HIT_WINDOW_SECONDS = 3600
SNAPSHOT_LOAD_DELAY_NS = 24 * 3600 * NS_PER_SECOND
EXTRA_THRESHOLD = Threshold(3, 5, 3600)
THREE_SOURCES = CorrelationGroup("wide", "error", ("svc_0", "svc_1", "svc_2"), Threshold(3, 6, 14400), 3)
# files of the journal fixtures get times before this, so that those written last are told by theirs
FIXTURE_FILES_BEFORE_MS = 1_000_000_000_000
# journal and text files together: text lines share the time of their file
MIXED_RULES = AlertRules(watched=["error", "purchase", "license"], critical=["purchase"],
                         thresholds={"PATTERN_WATCH": Threshold(3, 5, 600), "CORRELATION": Threshold(2, 3, 300), "TRIAGE": Threshold(1, 1, 0)})
