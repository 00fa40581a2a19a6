"""Alerting: tiering, dedup, thresholds, correlation and the full pipeline.

The rules are a small driver-side configuration, so tiers, notes and
thresholds become literal expressions.  Hits are split by threshold (a few
distinct (k, n, W) triples), each group runs the distributed fold of
:mod:`vigilspark.operators.threshold`.  The hits are written once with their
text; the fold reads only keys and times, and the fired rows are joined back
to the written hits by row id.
"""

from __future__ import annotations

from functools import reduce


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.config import AlertRules, CorrelationGroup, Threshold
from vigilspark.functions.columns import alert_line, pattern_key
from vigilspark.operators.match import keyword_hits
from vigilspark.session import materialize
from vigilspark.operators.threshold import (
    grouped_threshold_fires,
    is_immediate,
    threshold_fires,
)

FLAG_COLUMNS = ["timestamp_ns", "source", "raw", "priority", "level", "flagged_at",
                "pattern_key", "hit_count", "note"]


def _case(keyword_col: Column, mapping: dict, default=None) -> Column:
    expr = None
    for kw, value in mapping.items():
        cond = keyword_col == F.lit(kw)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))


def tiered_hits(entries: DataFrame, rules: AlertRules, keep=("timestamp_ns", "seq", "source")):
    """F2/F3 + T1 + P5: one row per (entry, keyword) with level, note, pattern key
    and the id of its threshold group."""
    tiers = rules.tiers()
    hits = keyword_hits(entries, rules, keep=list(keep))
    kw = F.col("keyword")
    groups = {t[2] for t in tiers}
    gid = {th: i for i, th in enumerate(sorted(groups, key=lambda x: (x.required, x.samples, x.window_seconds)))}
    return hits.select(
        *keep, "keyword",
        pattern_key("source", "keyword").alias("pattern_key"),
        _case(kw, {t[0]: t[1] for t in tiers}).alias("level"),
        _case(kw, {t[0]: t[3] for t in tiers}).alias("note"),
        _case(kw, {t[0]: gid[t[2]] for t in tiers}, -1).alias("tgroup")), gid


def dedup(hits: DataFrame, prior_flags: DataFrame | None) -> DataFrame:
    """T5: drop hits whose (timestamp_ns, pattern_key) was flagged before
    (live flags and archive alike; the level is not part of the key)."""
    if prior_flags is None:
        return hits
    seen = prior_flags.select("timestamp_ns", "pattern_key")
    return hits.join(seen, ["timestamp_ns", "pattern_key"], "left_anti")


def _fold_groups(hits: DataFrame, gid: dict, resets: DataFrame | None, block_rows: int | None) -> DataFrame:
    # note is a function of the pattern key, so carrying it as a key column
    # does not change the grouping; all thresholds share one positioning pass
    groups = {i: th for th, i in gid.items()}
    if not groups:
        return hits.select("pattern_key", "level", "note", "timestamp_ns", "seq", "rid",
                           F.lit(0).alias("hit_count")).limit(0)
    return grouped_threshold_fires(hits, groups, ("pattern_key", "level", "note"), resets, block_rows).drop("tgroup")


def stored_hits(hits: DataFrame) -> DataFrame:
    """The hits written once, each with a ``rid`` of its own: equal records may share timestamp and ``seq``."""
    return materialize(hits.withColumn("rid", F.monotonically_increasing_id()))


def flagged_rows(fires: DataFrame, payload: DataFrame) -> DataFrame:
    """Shape fired hits as flattened flag rows (entry columns + flag columns).

    ``payload`` is the stored hit table (it carries source, raw and priority),
    so fetching the text of fired rows never rescans the source; a fire names
    its row by ``rid``, so it is one flag even among identical records.
    """
    out = fires.join(payload.select("rid", "source", "raw", "priority"), "rid")
    return out.select(
        "timestamp_ns", "source", "raw", "priority", "level",
        F.col("timestamp_ns").alias("flagged_at"),
        "pattern_key", F.col("hit_count").cast("int").alias("hit_count"), "note")


PAYLOAD = ("timestamp_ns", "seq", "source", "raw", "priority")


def alert_pipeline(entries: DataFrame, rules: AlertRules, prior_flags: DataFrame | None = None,
                   resets: DataFrame | None = None, levels=None, keywords=None,
                   block_rows: int | None = None) -> DataFrame:
    """Keyword match -> exclusion -> tier -> dedup -> threshold -> flags.

    The source is scanned and matched once: the hits (with their payload)
    are materialized and every threshold group and the final payload join
    read them.  ``flagged_at`` is the entry's own timestamp, so reruns are
    deterministic.  ``levels`` / ``keywords`` restrict the tiers / keywords
    evaluated (pattern keys are per keyword, so this changes nothing else).
    """
    hits, gid = tiered_hits(entries, rules, keep=PAYLOAD)
    if levels is not None:
        hits = hits.filter(F.col("level").isin(list(levels)))
    if keywords is not None:
        hits = hits.filter(F.col("keyword").isin(list(keywords)))
    if levels is not None or keywords is not None:
        # only the thresholds of the selected tiers and keywords are evaluated
        used = {th for kw, level, th, _ in rules.tiers()
                if (levels is None or level in set(levels)) and (keywords is None or kw in set(keywords))}
        gid = {th: i for th, i in gid.items() if th in used}
    hits = stored_hits(dedup(hits, prior_flags))
    immediate = {th: i for th, i in gid.items() if is_immediate(th)}
    windowed = {th: i for th, i in gid.items() if th not in immediate}
    parts = []
    if immediate:
        parts.append(_immediate_flags(hits.filter(F.col("tgroup").isin(list(immediate.values())))))
    if windowed:
        fires = _fold_groups(hits.select("pattern_key", "level", "note", "tgroup", "timestamp_ns", "seq", "rid"),
                             windowed, resets, block_rows)
        parts.append(flagged_rows(fires, hits))
    if not parts:
        return flagged_rows(_fold_groups(hits, {}, resets, block_rows), hits)
    return reduce(DataFrame.unionByName, parts)


def _immediate_flags(hits: DataFrame) -> DataFrame:
    """T3 with the payload carried through the dedup aggregate: every hit
    fires once per (timestamp, pattern key), the lowest ``seq`` wins.  Most
    hits of an immediate tier fire, so this avoids a hits-sized join."""
    first = F.min(F.struct("seq", "source", "raw", "priority")).alias("m")
    return (hits.groupBy("pattern_key", "level", "note", "timestamp_ns").agg(first)
            .select("timestamp_ns", "m.source", "m.raw", "m.priority", "level",
                    F.col("timestamp_ns").alias("flagged_at"), "pattern_key",
                    F.lit(1).alias("hit_count"), "note"))


def correlation_alerts(entries: DataFrame, rules: AlertRules, group: CorrelationGroup,
                       prior_flags: DataFrame | None = None,
                       block_rows: int | None = None) -> DataFrame:
    """Hits of ``group.keyword`` from any of ``group.sources`` share one
    pattern key (the group name) and run the CORRELATION threshold.

    With ``group.min_distinct_sources`` above 1 the retained hits must also come
    from that many sources (see :mod:`vigilspark.operators.correlation`)."""
    from vigilspark.operators.correlation import distinct_source_fires
    hits = keyword_hits(entries.filter(F.col("source").isin(list(group.sources))), rules, keep=list(PAYLOAD))
    hits = (hits.filter(F.col("keyword") == group.keyword)
            .select(*PAYLOAD, F.lit(group.name).alias("pattern_key"), F.lit("CORRELATION").alias("level")))
    hits = stored_hits(dedup(hits, prior_flags))
    if group.min_distinct_sources > 1:
        fires = distinct_source_fires(hits.select("pattern_key", "level", "timestamp_ns", "seq", "rid", "source"),
                                      group.threshold, group.min_distinct_sources, ("pattern_key", "level"),
                                      "source", block_rows)
    else:
        fires = threshold_fires(hits.select("pattern_key", "level", "timestamp_ns", "seq", "rid"), group.threshold,
                                ("pattern_key", "level"), block_rows=block_rows)
    fires = fires.withColumn(
        "note", F.lit(f"Keyword '{group.keyword}' correlated across {', '.join(group.sources)}"))
    return flagged_rows(fires, hits)


def single_threshold_alerts(entries: DataFrame, rules: AlertRules, keyword: str, threshold: Threshold,
                            level: str = "PATTERN_WATCH", prior_flags: DataFrame | None = None,
                            resets: DataFrame | None = None,
                            block_rows: int | None = None) -> DataFrame:
    """Run one keyword through one threshold, per source (pattern key source:keyword)."""
    hits = keyword_hits(entries, rules, keep=list(PAYLOAD))
    hits = (hits.filter(F.col("keyword") == keyword)
            .select(*PAYLOAD, pattern_key("source", "keyword").alias("pattern_key"), F.lit(level).alias("level")))
    hits = stored_hits(dedup(hits, prior_flags))
    fires = threshold_fires(hits.select("pattern_key", "level", "timestamp_ns", "seq", "rid"), threshold,
                            ("pattern_key", "level"), resets, block_rows)
    return flagged_rows(fires.withColumn("note", F.lit(rules.tier_of(keyword)[2])), hits)


def with_alert_line(flags: DataFrame) -> DataFrame:
    """The console line of a flag."""
    return flags.withColumn("alert_line", alert_line("level", "source", "raw"))
