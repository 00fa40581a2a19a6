"""Correlation that must span several sources.

The plain correlation (a shared pattern key and the CORRELATION threshold) is
:func:`vigilspark.operators.alerts.correlation_alerts`.  Here a hit fires only
when the retained hits also come from at least ``min_sources`` sources, any
number of them; ``hit_count`` is the number retained and may exceed ``required``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.config import Threshold
from vigilspark.operators.threshold import threshold_fires, windowed_fires


def distinct_source_fires(hits: DataFrame, threshold: Threshold, min_sources: int = 2,
                          keys=("pattern_key", "level"), source_col: str = "source",
                          block_rows: int | None = None) -> DataFrame:
    """Fired hits ``keys + (timestamp_ns, seq, hit_count)``.

    ``hits`` needs ``keys``, ``timestamp_ns``, ``seq`` and ``source_col``.
    ``min_sources <= 1`` is the plain threshold.
    """
    if min_sources <= 1:
        return threshold_fires(hits, threshold, keys, block_rows=block_rows)
    if threshold.window_seconds <= 0:
        raise ValueError("a source-spanning correlation needs a time window")
    marked = hits.withColumn("tgroup", F.lit(0))
    if threshold.samples < max(threshold.required, min_sources):
        return threshold_fires(hits, Threshold(2, 1, 1), keys)  # too few are retained: never fires
    return windowed_fires(marked, {0: threshold}, keys, block_rows=block_rows, min_sources=min_sources,
                          source_col=source_col).drop("tgroup")
