"""Hourly activity baselines, anomaly scoring and confidence.

Sizes: the hourly table has one row per (source, hour) and the baseline one
row per (source, weekday-hour slot), at most 168 per source.  Both are
aggregates of the entries with map-side partial aggregation; a hot source
only adds to counts, never to the number of rows that meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.config import DEFAULT_MIN_SAMPLES, DEFAULT_SENSITIVITY, NS_PER_DAY
from vigilspark.functions.columns import (
    confidence,
    confidence_pct,
    hour_start_ns,
    monitoring_active,
    slot_key_ns,
)


def hourly_counts(entries: DataFrame) -> DataFrame:
    """A1: entries per (source, UTC hour).  Hours without entries give no row."""
    return (entries
            .groupBy("source", hour_start_ns("timestamp_ns").alias("hour_ns"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("slot_key", slot_key_ns("hour_ns")))


def slot_baseline(hourly: DataFrame) -> DataFrame:
    """A2: count, mean and M2 (sum of squared deviations) per (source, slot).

    ``var_pop * count`` is Welford's M2; Spark's central-moment aggregate is
    itself a mergeable single-pass Welford, so partial aggregation applies.
    """
    return (hourly.groupBy("source", "slot_key")
            .agg(F.count(F.lit(1)).alias("count"),
                 F.avg("n").alias("mean"),
                 (F.var_pop("n") * F.count(F.lit(1))).alias("m2")))


def with_stddev(baseline: DataFrame) -> DataFrame:
    """Sample standard deviation, 0.0 when fewer than two samples."""
    return baseline.withColumn(
        "stddev",
        F.when(F.col("count") < 2, F.lit(0.0))
         .otherwise(F.sqrt(F.col("m2") / (F.col("count") - 1))))


def merge_baselines(old: DataFrame, new: DataFrame) -> DataFrame:
    """A3: continue existing buckets with new samples (Chan's parallel update).

    The update is algebraic, so the result does not depend on the order in
    which batches are merged.
    """
    a = old.select("source", "slot_key", F.col("count").alias("na"), F.col("mean").alias("ma"), F.col("m2").alias("m2a"))
    b = new.select("source", "slot_key", F.col("count").alias("nb"), F.col("mean").alias("mb"), F.col("m2").alias("m2b"))
    j = a.join(b, ["source", "slot_key"], "full_outer")
    na = F.coalesce("na", F.lit(0)).cast("long")
    nb = F.coalesce("nb", F.lit(0)).cast("long")
    n = na + nb
    ma = F.coalesce("ma", F.lit(0.0))
    mb = F.coalesce("mb", F.lit(0.0))
    delta = mb - ma
    return j.select(
        "source", "slot_key",
        n.alias("count"),
        (ma + delta * nb / n).alias("mean"),
        (F.coalesce("m2a", F.lit(0.0)) + F.coalesce("m2b", F.lit(0.0)) + delta * delta * na * nb / n).alias("m2"))


def bucket_anomalous(count_col, n_col, mean_col, std_col,
                     min_samples: int = DEFAULT_MIN_SAMPLES,
                     sensitivity: float = DEFAULT_SENSITIVITY):
    """False below ``min_samples``; else count > mean + sensitivity * stddev (strict)."""
    return F.when(F.col(n_col) < F.lit(min_samples), F.lit(False)).otherwise(
        F.col(count_col) > F.col(mean_col) + F.lit(float(sensitivity)) * F.col(std_col))


def anomaly_scored(hourly: DataFrame, baseline: DataFrame, active: DataFrame | None = None,
                   min_samples: int = DEFAULT_MIN_SAMPLES,
                   sensitivity: float = DEFAULT_SENSITIVITY) -> DataFrame:
    """Score hourly counts against a trained baseline.

    Unknown (source, slot) pairs score false; an inactive store (confidence
    below 10 %) scores everything false.  The baseline has at most 168 rows
    per source; AQE turns the join into a broadcast when its measured size is
    below the broadcast threshold and keeps a shuffle join otherwise.
    """
    b = with_stddev(baseline).select("source", "slot_key", F.col("count").alias("samples"), "mean", "stddev")
    scored = hourly.join(b, ["source", "slot_key"], "left")
    test = F.coalesce(bucket_anomalous("n", "samples", "mean", "stddev", min_samples, sensitivity), F.lit(False))
    if active is not None:
        # one-row flag as a scalar subquery: evaluated once, no join
        test = test & F.coalesce(active.select("monitoring_active").scalar(), F.lit(False))
    return scored.withColumn("anomalous", test)


def anomaly_online(hourly: DataFrame, min_samples: int = DEFAULT_MIN_SAMPLES,
                   sensitivity: float = DEFAULT_SENSITIVITY) -> DataFrame:
    """D3: test each hour against the samples of its slot seen *before* it.

    The window partitions by (source, slot): one row per hour, so a group is
    bounded by the number of weeks observed, not by the number of entries.
    """
    w = (Window.partitionBy("source", "slot_key").orderBy("hour_ns")
         .rowsBetween(Window.unboundedPreceding, -1))
    prior_n = F.count(F.lit(1)).over(w)
    prior_mean = F.avg("n").over(w)
    prior_std = F.coalesce(F.stddev_samp("n").over(w), F.lit(0.0))
    out = (hourly
           .withColumn("prior_samples", prior_n)
           .withColumn("prior_mean", prior_mean)
           .withColumn("prior_stddev", F.when(F.col("prior_samples") < 2, F.lit(0.0)).otherwise(prior_std)))
    return out.withColumn(
        "anomalous",
        F.coalesce(bucket_anomalous("n", "prior_samples", "prior_mean", "prior_stddev",
                                    min_samples, sensitivity), F.lit(False)))


def anomaly_continued(hourly: DataFrame, state: DataFrame, min_samples: int = DEFAULT_MIN_SAMPLES,
                      sensitivity: float = DEFAULT_SENSITIVITY) -> DataFrame:
    """D3 over an export that goes on where ``state`` (count, mean, m2 per source and slot) ends.

    Each hour is tested against the state and the new hours before it, added
    up by Chan's formula, so earlier hours are not read again.  Passes over
    the parts of a history, each from ``merge_baselines`` of the last state and
    the last part's ``slot_baseline``, give what one pass over the whole gives,
    as long as no part has hours before those of an earlier one.
    """
    w = (Window.partitionBy("source", "slot_key").orderBy("hour_ns")
         .rowsBetween(Window.unboundedPreceding, -1))
    held = state.select("source", "slot_key", F.col("count").alias("_n0"), F.col("mean").alias("_m0"), F.col("m2").alias("_s0"))
    own = hourly.select(*hourly.columns, F.count(F.lit(1)).over(w).alias("_n1"), F.coalesce(F.avg("n").over(w), F.lit(0.0)).alias("_m1"),
                        F.coalesce(F.var_pop("n").over(w), F.lit(0.0)).alias("_v1"))
    n0, m0, s0 = (F.coalesce(F.col(c), F.lit(0)) for c in ("_n0", "_m0", "_s0"))
    n = n0 + F.col("_n1")
    delta = F.col("_m1") - m0
    out = own.join(held, ["source", "slot_key"], "left").select(
        *hourly.columns, n.alias("prior_samples"), F.when(n > 0, m0 + delta * F.col("_n1") / n).alias("prior_mean"),
        F.when(n < 2, F.lit(0.0)).otherwise(
            F.sqrt((s0 + F.col("_v1") * F.col("_n1") + delta * delta * n0 * F.col("_n1") / n) / (n - 1))).alias("prior_stddev"))
    return out.withColumn("anomalous", F.coalesce(
        bucket_anomalous("n", "prior_samples", "prior_mean", "prior_stddev", min_samples, sensitivity), F.lit(False)))


def seed_days(entries: DataFrame, as_of_ns: int) -> DataFrame:
    """Days between the earliest parsed entry and ``as_of``; 0.0 when empty."""
    return entries.agg(
        F.coalesce((F.lit(as_of_ns) - F.min("timestamp_ns")) / F.lit(float(NS_PER_DAY)),
                   F.lit(0.0)).alias("seed_days"))


def direct_observation_days(observation_log: DataFrame) -> DataFrame:
    """Summed length of observed intervals ``(start_ns, end_ns)``, in days."""
    return observation_log.agg(
        F.coalesce(F.sum(F.col("end_ns") - F.col("start_ns")) / F.lit(float(NS_PER_DAY)),
                   F.lit(0.0)).alias("direct_days"))


def confidence_report(seed: DataFrame, direct: DataFrame) -> DataFrame:
    """Confidence, truncated percentage and the active flag (one row)."""
    row = seed.select("seed_days", direct.select("direct_days").scalar().alias("direct_days"))
    conf = confidence("seed_days", "direct_days")
    return (row.withColumn("confidence", conf)
            .withColumn("confidence_pct", confidence_pct("confidence"))
            .withColumn("monitoring_active", monitoring_active("confidence")))
