"""Connected components of a link table by alternating star contractions.

Every round rewrites the links so that each node points at a smaller one;
a round is two aggregations and two joins on the link table, so neither a
component nor the label table ever meets in one task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.session import discard, store


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u")).toDF("u", "v")
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): the smallest node reachable from every linked node.

    ``links`` holds undirected links in any direction, repeated or not;
    links with a null end and loops are ignored.  Roots themselves are
    listed too.  An empty link table gives an empty result.
    """
    now = store(links.select(F.col(left).alias("u"), F.col(right).alias("v"))
                .where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _signature(now)
    while seen[0]:
        turned = store(_small_star(_large_star(now)))
        discard(now)
        now, before = turned, seen
        seen = _signature(now)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
