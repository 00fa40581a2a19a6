"""Journal lines made once, records told without their texts."""

from collections import Counter

from pyspark.sql import functions as F

from vigilspark.plans import catalogue
from vigilspark.plans import params as P
from vigilspark.plans.jobs import _held_records
from vigilspark.sources import store

SF = "/root/testdata/sf0.001"


def test_live_lines_are_made_once(spark):
    lines = catalogue._split_journal(spark, SF)[1]
    made = catalogue._timed_lines(lines)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    makers = [node for node in plan.split("\n") if "tojson" in node.lower() or "to_json" in node]
    assert len(makers) == 1 and "Project" in makers[0]
    cut = f"coalesce(get_json_object(value, '$.__REALTIME_TIMESTAMP') >= '{P.TRAIN_END_NS // 1000}', false)"
    want = lines.where(~F.col("value").contains('"__REALTIME_TIMESTAMP":"x')).select("value", F.expr(cut))
    assert Counter(map(tuple, made.collect())) == Counter(map(tuple, want.collect()))


def test_held_records_are_told_by_all_columns(spark):
    rows = [("s", 1, 7, "a", None), ("s", 1, 7, "a", None), ("s", 1, 7, None, "a"), ("s", 1, 8, "b", "c"), ("s", 2, 8, "b", "c"), (None, None, 9, "b", "c")]
    df = spark.createDataFrame(rows, "source string, timestamp_ns long, seq long, raw string, unit string")
    assert Counter(map(tuple, _held_records(df).collect())) == Counter((*r[:3], n) for r, n in Counter(rows).items())
    assert store.SEEN_KEYS == ["source", "timestamp_ns", "seq"]
