"""Rolling buffer semantics and pause windows.

Every "now" is an explicit ``as_of`` argument; nothing reads the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.config import MAX_ENTRIES, NS_PER_SECOND, ROLLING_WINDOW_HOURS
from vigilspark.functions.columns import floor_div


def rolling_window(entries: DataFrame, as_of_ns: int, hours: int = ROLLING_WINDOW_HOURS) -> DataFrame:
    """Keep entries with ``timestamp_ns >= as_of - hours`` (inclusive).

    A plain filter, pushed into the parquet scan when reading stored buffers.
    """
    cutoff = int(as_of_ns) - int(hours) * 3600 * NS_PER_SECOND
    return entries.filter(F.col("timestamp_ns") >= F.lit(cutoff))


#: Arrival numbers are counted in at most about 2 to this power ranges at a time.
RANGE_BITS = 14
#: A range of so many rows is sorted, not cut again.
EDGE_ROWS = 100_000


def capped_buffer(entries: DataFrame, cap: int = MAX_ENTRIES, order_col: str = "seq") -> DataFrame:
    """R2: the newest ``cap`` entries by arrival.

    Entries are counted by range of arrival numbers; the range that holds the
    cap-th newest entry is cut into ranges again until it is small, which takes
    one pass for dense numbers and at most five for any.  Newer ranges are kept
    whole, and only the last one is sorted.  Rows without a number are the oldest;
    equal numbers at the edge are kept in no fixed order.
    """
    order, need = F.coalesce(F.col(order_col), F.lit(-(1 << 63))), int(cap)
    low, high = entries.agg(F.min(order), F.max(order)).first()
    if need <= 0 or low is None:
        return entries.limit(0)
    while True:
        shift = max(0, (high - low).bit_length() - RANGE_BITS)
        inside = entries.where(order.between(low, high))
        ranges = inside.groupBy(F.shiftright(order, shift).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
        newer = 0
        for part, n in sorted(map(tuple, ranges), reverse=True):
            if newer + n >= need:
                break
            newer += n
        else:  # fewer rows than the cap
            return entries
        low, high, need = max(low, part << shift), min(high, (part + 1 << shift) - 1), need - newer
        if n <= EDGE_ROWS or shift == 0:
            cut = entries.where(order.between(low, high)).orderBy(F.desc(order_col)).limit(need)
            return entries.where(order > high).unionByName(cut)


def incremental_batch(entries: DataFrame, high_water_mark, order_col: str = "seq") -> DataFrame:
    """Rows not processed yet — strictly above the high-water mark.

    ``high_water_mark`` is a literal or a one-row DataFrame (evaluated as a
    scalar subquery).  The order must be that of arrival: of sources without
    one, ``ArrivalCursor`` gives the rows that are new, with numbers.
    """
    hwm = high_water_mark.scalar() if isinstance(high_water_mark, DataFrame) else F.lit(high_water_mark)
    return entries.filter(F.col(order_col) > F.coalesce(hwm, F.lit(-1)))


def pause_frame(spark: SparkSession, intervals) -> DataFrame:
    """Pause intervals ``[start_ns, end_ns)`` as a small DataFrame."""
    return spark.createDataFrame([(int(a), int(b)) for a, b in intervals], "start_ns long, end_ns long")


def pause_filtered(entries: DataFrame, pauses: DataFrame) -> DataFrame:
    """drop entries arriving inside a pause interval ``[start_ns, end_ns)``.

    Range join made an equi-join: every pause interval is listed under each
    UTC day it touches, entries carry their day, and the anti join matches on
    the day with the range test as an extra condition — a hash join (AQE
    broadcasts the pause side when it is small), never a nested loop.
    """
    day = 86_400 * NS_PER_SECOND
    p = pauses.select(
        "start_ns", "end_ns",
        F.explode(F.sequence(floor_div("start_ns", day), floor_div_end("end_ns", day))).alias("day"))
    e = entries.withColumn("_day", floor_div("timestamp_ns", day))
    cond = ((e["_day"] == p["day"]) & (e["timestamp_ns"] >= p["start_ns"]) & (e["timestamp_ns"] < p["end_ns"]))
    return e.join(p, cond, "left_anti").drop("_day")


def floor_div_end(c: str, d: int):
    """Day of the last instant of a half-open interval ending at ``c``."""
    return F.expr(f"((`{c}` - 1) - pmod(`{c}` - 1, {int(d)}L)) div {int(d)}L")
