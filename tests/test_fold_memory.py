"""Memory of the threshold fold in Python."""

import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from vigilspark.operators import threshold


def test_a_block_takes_little_memory():
    rows = threshold.BLOCK_ROWS
    g = np.arange(rows)
    pdf = pd.DataFrame({"block": 0, "g": g, "kh": g // 1000, "t": g * 7, "k": 3, "n": 3, "m": 1, "low": g * 7 - 30, "src": 0})
    tracemalloc.start()
    block = threshold._Block(pdf, rows, 3)
    table, fired = block.table(), block.fires(0)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(table) == 5 and len(fired) > rows // 4
    assert peak < 32e6


def test_offsets_of_partitions_need_no_python_workers(spark):
    placed = spark.range(0, 50, 1, 4).withColumn("_at", F.monotonically_increasing_id())
    got = threshold._part_offsets(placed, "_at", F.count("*"))
    assert "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(0, 0), (1, 12), (2, 25), (3, 37)]
    assert threshold._part_offsets(placed.where("false"), "_at", F.count("*")).count() == 0
