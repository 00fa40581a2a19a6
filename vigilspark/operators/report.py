"""The one-row status report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.config import MAX_ENTRIES


def status_report(buffer: DataFrame, confidence: DataFrame, flags: DataFrame,
                  cap: int = MAX_ENTRIES) -> DataFrame:
    """Buffer rows (time-bounded buffer, at most ``cap``), confidence %,
    active flag and flagged count, one row.

    Each input is reduced to one value and combined as scalar subqueries.
    """
    return buffer.agg(F.least(F.count(F.lit(1)), F.lit(int(cap)).cast("long")).alias("buffer_rows")).select(
        "buffer_rows",
        confidence.select("confidence_pct").scalar().alias("confidence_pct"),
        confidence.select("monitoring_active").scalar().alias("monitoring_active"),
        flags.agg(F.count(F.lit(1))).scalar().alias("flagged_count"))
