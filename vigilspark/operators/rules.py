"""Rule tables and their validation.

The INI parser of the original tool is not rebuilt: rules are a table.
``rules_frame`` turns an :class:`AlertRules` into one row per keyword;
``rule_violations`` returns the rows that break a constraint, and
``rule_coverage`` checks the rules against real data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.config import AlertRules
from vigilspark.functions.columns import lower_raw
from vigilspark.schemas import RULE_ROW


def rule_keywords(rules: AlertRules) -> list:
    """Every keyword named by the rules, active ones first, de-duplicated."""
    return list(dict.fromkeys(rules.active_keywords + rules.critical_keywords
                              + list(rules.noisy) + list(rules.aggregate)))


def rules_frame(spark: SparkSession, rules: AlertRules) -> DataFrame:
    """One row per keyword known to the rules: active, critical, noisy or
    aggregate, with its tier, threshold, exclusion and aggregate interval."""
    active = rules.active_keywords
    names = rule_keywords(rules)
    rows = []
    for i, kw in enumerate(names):
        if kw in active:
            level, th, note = rules.tier_of(kw)
            rows.append((kw, i, level, th.required, th.samples, int(th.window_seconds),
                         rules.exclusions.get(kw), rules.aggregate.get(kw), note))
        else:
            rows.append((kw, i, None, None, None, None, rules.exclusions.get(kw),
                         rules.aggregate.get(kw), None))
    return spark.createDataFrame(rows, RULE_ROW)


def rule_violations(rules_df: DataFrame) -> DataFrame:
    """S10 checks as a query: each (keyword, problem) that breaks a rule.

    * empty keyword; duplicate keyword;
    * required_count < 1, window_seconds < 0, total_samples < required_count
      for a windowed tier (such a tier can never fire);
    * aggregate interval <= 0;
    * a tier-less row (critical or noisy keyword outside the active set is
      unreachable).
    """
    dup = rules_df.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    checks = [
        (F.trim(F.col("keyword")) == "", "empty keyword"),
        (F.col("required_count") < 1, "required_count must be >= 1"),
        (F.col("window_seconds") < 0, "window_seconds must be >= 0"),
        ((F.col("window_seconds") > 0) & (F.col("total_samples") < F.col("required_count")),
         "total_samples below required_count: never fires"),
        (F.col("agg_interval_seconds") <= 0, "aggregate interval must be positive"),
        (F.col("level").isNull() & F.col("agg_interval_seconds").isNull(),
         "keyword not in the active set: never matches"),
    ]
    parts = [rules_df.filter(F.coalesce(c, F.lit(False))).select("keyword", F.lit(msg).alias("problem"))
             for c, msg in checks]
    parts.append(dup.select("keyword", F.lit("duplicate keyword").alias("problem")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rule_coverage(spark: SparkSession, entries: DataFrame, rules: AlertRules) -> DataFrame:
    """Rules against the data: matching lines per rule keyword (exclusions
    applied to tiered keywords), whether the rule is reachable, and its
    tier.  One pass over the entries with one conditional count per rule."""
    rdf = rules_frame(spark, rules)
    names = rule_keywords(rules)
    low = lower_raw("raw")
    aggs = []
    for i, kw in enumerate(names):
        cond = F.contains(low, F.lit(kw))
        excl = rules.exclusions.get(kw)
        if excl and kw in rules.active_keywords:
            cond = cond & ~F.contains(low, F.lit(excl))
        aggs.append(F.count_if(cond).alias(f"c{i}"))
    wide = entries.agg(*aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(kw).alias("keyword"), F.col(f"c{i}").alias("matched_lines"))
                                for i, kw in enumerate(names)]))
    counts = wide.select(stack.alias("s")).select("s.keyword", "s.matched_lines")
    return (rdf.join(counts, "keyword")
            .select("keyword", "level", "matched_lines",
                    F.col("level").isNotNull().alias("reachable")))
