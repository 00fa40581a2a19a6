"""Arrival order: every line of a growing set of text files gets one number, in the order it came.

Files come in the order of their modification time, then path; lines in the
order of their blocks and rows.  A line's place in its block comes with the
scan, so lines are never sorted: only blocks, one row each, are put in order
and added up, and a line's number is its block's plus its place.

A cursor remembers how many lines of each file were taken and the last number
given; it is a versioned table, so a pass that fails before it commits takes
the same lines again and gives them the same numbers.  A file that grew goes on
behind its last line taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilspark.session import materialize
from vigilspark.sources.versions import VersionedTable

CURSOR = T.StructType([T.StructField("path", T.StringType()), T.StructField("lines", T.LongType())])


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, path, file_ns, block, row): text lines with their file, its time, their block, and a number that rises along the block."""
    meta = F.col("_metadata")
    return spark.read.text(path).select(
        "value", meta["file_path"].alias("path"), (F.unix_micros(meta["file_modification_time"]) * 1000).alias("file_ns"),
        meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row"))


class ArrivalCursor:
    """What was taken of the files of a source; ``path`` is the cursor's own table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, VersionedTable(spark, path)

    def taken(self) -> tuple[DataFrame, int]:
        """((path, lines) of every file taken, the last number given, -1 at first)."""
        version = self.table.current()
        return self.table.read(CURSOR, version), int(version.marks.get("last", -1))

    def number(self, placed: DataFrame) -> tuple[DataFrame, Callable[[], int]]:
        """(new lines with ``seq``, commit): the rows of ``placed`` that no pass took yet, and what to call once they are kept.

        ``placed`` has path, file_ns, block and row of ``placed_lines`` for every
        line, the rejected ones too: their places count.  It is stored first.
        """
        stored = materialize(placed)
        version = self.table.current()
        taken, last = self.table.read(CURSOR, version), int(version.marks.get("last", -1))
        blocks = stored.groupBy("path", "file_ns", "block").agg(F.min("row").alias("first"), F.count("*").alias("n"))
        # one row for each block of the read, that is for about one task's rows
        rows = sorted((r for r in blocks.join(taken, "path", "left").collect()), key=lambda r: (r["file_ns"], r["path"], r["block"]))
        offsets, at, sums = [], last + 1, {}
        for r in rows:
            before = sums.get(r["path"], 0)  # lines of the file before this block
            skipped = min(max((r["lines"] or 0) - before, 0), r["n"])
            offsets.append((r["path"], r["block"], r["first"], skipped, at))
            sums[r["path"]] = before + r["n"]
            at += r["n"] - skipped
        known = self.spark.createDataFrame(offsets, "path string, block long, first long, skipped long, start long")
        place = F.col("row") - F.col("first")
        fresh = stored.join(F.broadcast(known), ["path", "block"]).where(place >= F.col("skipped")).withColumn(
            "seq", F.col("start") + place - F.col("skipped")).select(*stored.columns, "seq")

        def commit() -> int:
            """Keep the cursor; the last number given."""
            lines = dict(sums)
            seen = self.spark.createDataFrame(list(lines.items()), CURSOR)
            whole = taken.join(seen.select("path"), "path", "left_anti").unionByName(
                seen.join(taken.withColumnRenamed("lines", "old"), "path", "left").select("path", F.greatest("lines", F.coalesce("old", F.lit(0))).alias("lines")))
            self.table.commit([self.table.write(whole.coalesce(1))], version.folders, {"last": at - 1})
            return at - 1

        return fresh, commit
