"""Column expressions shared by the operators.

All of them are built-in Spark expressions, so they stay inside whole-stage
code generation; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilspark.config import (
    DIRECT_CONFIDENCE_WEIGHT,
    MIN_DAYS_FOR_FULL_CONFIDENCE,
    MONITORING_ACTIVE_THRESHOLD,
    NS_PER_SECOND,
    SEED_CONFIDENCE_WEIGHT,
)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- time ------------------------------------------------------------------

def ts_to_ns(ts) -> Column:
    """Spark timestamp (µs, read in the session zone = UTC) -> BIGINT ns."""
    return F.unix_micros(col_(ts).cast("timestamp")) * F.lit(1000)


def floor_div(c, divisor: int) -> Column:
    """Exact integer floor division of a BIGINT column (no double rounding:
    ns values exceed 2^53)."""
    name = c if isinstance(c, str) else None
    if name is None:
        raise TypeError("floor_div takes a column name")
    d = int(divisor)
    return F.expr(f"(`{name}` - pmod(`{name}`, {d}L)) div {d}L")


def ns_to_ts(ns) -> Column:
    """BIGINT ns -> timestamp (µs precision, for display and calendar maths)."""
    return F.timestamp_micros(floor_div(ns, 1000))


def slot_key_ns(ns: str) -> Column:
    """``<weekday>_<hour>`` with Monday = 0 and a two-digit UTC hour,
    by integer arithmetic on ns (independent of the session time zone;
    1970-01-01 was a Thursday, weekday 3)."""
    day = floor_div(ns, 86_400 * NS_PER_SECOND)
    hour = F.pmod(floor_div(ns, 3600 * NS_PER_SECOND), F.lit(24))
    return F.concat(F.pmod(day + F.lit(3), F.lit(7)).cast("string"), F.lit("_"),
                    F.lpad(hour.cast("string"), 2, "0"))


def utc_date_ns(ns: str) -> Column:
    """UTC calendar date of a ns instant (session-zone independent)."""
    return F.date_from_unix_date(floor_div(ns, 86_400 * NS_PER_SECOND).cast("int"))


def ntz_micros(c: str) -> Column:
    """µs since the epoch of a TIMESTAMP_NTZ wall-clock value read as UTC,
    without any session-zone conversion."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{c}`)")


def hour_start_ns(ns) -> Column:
    """Start of the UTC hour holding ``ns`` (ns)."""
    hour = 3600 * NS_PER_SECOND
    return floor_div(ns, hour) * F.lit(hour)


# --- keys and text ---------------------------------------------------------

def pattern_key(source, keyword) -> Column:
    """P5: ``source:keyword``."""
    return F.concat_ws(":", col_(source), col_(keyword))


def alert_line(level, source, raw) -> Column:
    """``ALERT (LEVEL): source — first 80 characters of raw``."""
    return F.format_string("ALERT (%s): %s — %s", col_(level), col_(source),
                           F.substring(col_(raw), 1, 80))


# --- keyword matching ------------------------------------------------------

def lower_raw(raw="raw") -> Column:
    return F.lower(col_(raw))


def keyword_hit(raw_lower: Column, keyword: str, exclusion: str | None = None) -> Column:
    """F2 + F3: literal, case-insensitive substring match minus the exclusion."""
    cond = F.contains(raw_lower, F.lit(keyword.lower()))
    if exclusion:
        cond = cond & ~F.contains(raw_lower, F.lit(exclusion.lower()))
    return cond


def matched_keywords(raw_lower: Column, keywords: list, exclusions: dict | None = None) -> Column:
    """Array of the keywords matched by one line, in keyword-list order.

    ``array_compact(array(when(...)))`` keeps the match inside generated code
    (a lambda-based ``filter`` would fall back to interpretation).
    """
    exclusions = exclusions or {}
    if not keywords:
        return F.array().cast("array<string>")
    parts = [F.when(keyword_hit(raw_lower, k, exclusions.get(k)), F.lit(k)) for k in keywords]
    return F.array_compact(F.array(*parts))


# --- confidence ------------------------------------------------------------

def confidence(seed_days, direct_days) -> Column:
    """0.4 * min(seed/14, 1) + 0.6 * min(direct/14, 1)."""
    full = F.lit(float(MIN_DAYS_FOR_FULL_CONFIDENCE))
    return (F.least(col_(seed_days) / full, F.lit(1.0)) * F.lit(SEED_CONFIDENCE_WEIGHT)
            + F.least(col_(direct_days) / full, F.lit(1.0)) * F.lit(DIRECT_CONFIDENCE_WEIGHT))


def confidence_pct(conf) -> Column:
    return F.floor(col_(conf) * F.lit(100)).cast("int")


def monitoring_active(conf) -> Column:
    return col_(conf) >= F.lit(MONITORING_ACTIVE_THRESHOLD)
