"""Rules from a table against the plan of literal ``contains`` tests."""

import itertools
import random

from pyspark.sql import functions as F

from tests.conftest import BASE_NS, entries_df
from vigilspark.config import AlertRules
from vigilspark.operators import match
from vigilspark.operators.rules_table import rule_blocks, table_hits

RULE = "keyword string, exclusion string"


def plain(lines, rules):
    barred = {k: [e for k2, e in group if e] for k, group in itertools.groupby(sorted(rules, key=str), key=lambda r: r[0])}
    return sorted((i, k) for i, x in enumerate(lines) if x is not None for k, es in barred.items()
                  if k in x.lower() and not any(e in x.lower() for e in es))


def got(spark, lines, rules, **kw):
    hits = table_hits(entries_df(spark, [(BASE_NS, "s", x, None) for x in lines]), spark.createDataFrame(rules, RULE), keep=["seq"], **kw)
    return sorted((r.seq, r.keyword) for r in hits.collect())


def test_ten_thousand_rules_equal_contains(spark):
    rng = random.Random(1)
    syllables = ["er", "ror", "fa", "il", "ta", "no", "ix", "ou", "Ä", "ss"]
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    rules = sorted({(word(rng.randint(2, 5)).lower(), rng.choice([None, None, word(2).lower()])) for _ in range(40_000)}, key=str)[:10_000]
    assert len(rules) == 10_000
    lines = [" ".join(word(rng.randint(1, 6)) for _ in range(5)) for _ in range(60)]
    want = plain(lines, rules)
    assert len(want) > 150 and got(spark, lines, rules) == want
    assert got(spark, lines, rules, block_bytes=20_000) == want


def test_as_the_configured_rules(spark):
    rules = AlertRules(watched=["error", "i/o error", "fail", "view"], critical=[], exclusions={"error": "no error", "view": "preview"})
    lines = ["I/O ERROR", "no Error here", "error and no error", "preview view", "VIEW fail", "", None, "failfail"]
    df = entries_df(spark, [(BASE_NS, "s", x, None) for x in lines if x is not None])
    table = spark.createDataFrame([(k, rules.exclusions.get(k)) for k in rules.active_keywords], RULE)
    mine = table_hits(df, table)
    assert mine.columns == match.keyword_hits(df, rules).columns
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, match.keyword_hits(df, rules).collect()))


def test_odd_rules(spark):
    rules = [(" Error ", None), ("error", "x"), ("error", "y"), ("", "z"), (None, "z"), ("z", "  "), ("x", None)]
    lines = ["error", "error x", "an error, y", "Z", None, ""]
    assert got(spark, lines, rules) == [(0, "error"), (1, "x"), (3, "z")]
    assert got(spark, lines, []) == [] and got(spark, [], rules) == []
    assert sum(len(b) for b in rule_blocks(spark.createDataFrame(rules, RULE), 2)) == 3


def test_a_phrase_may_be_keyword_and_exclusion(spark):
    rules = [("disk", "disk full"), ("disk full", None), ("full", "disk")]
    assert got(spark, ["disk ok", "DISK FULL", "full"], rules) == [(0, "disk"), (1, "disk full"), (2, "full")]
    df = entries_df(spark, [(BASE_NS, "s", "disk full", 3)]).withColumn("keyword", F.lit("own"))
    assert [r.keyword for r in table_hits(df, spark.createDataFrame(rules, RULE), keep=["seq"]).collect()] == ["disk full"]
