"""The engine's own state tables: flags, archive, rolling buffer, baseline
(S5–S8, M2–M4).

Tables are parquet folders; flags are partitioned by ``flagged_date`` so
time filters prune whole partitions.  Tables that live jobs share have
versions (``versions.py``): readers and writers resolve the current one, and a
rewrite keeps what others appended meanwhile.  Rewrites of plain folders go
to a new folder — a job never overwrites the path it reads, so a
lost executor or a rerun cannot destroy the input.  JSON-lines interchange
(one nested object per line, as the original tool writes) is read with an
explicit schema; malformed lines are counted, never fatal.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilspark.config import NS_PER_DAY, ROLLING_WINDOW_HOURS
from vigilspark.operators.flags import flatten_entry, nest_entry, with_flag_date
from vigilspark.schemas import BASELINE, BOOT_STATS, FLAGGED, KEYWORD_STATS, LOG_ENTRY
from vigilspark.session import materialize
from vigilspark.sources.arrival import ArrivalCursor, placed_lines
from vigilspark.sources.versions import Version, VersionedTable

FLAT_FLAGS = T.StructType([
    T.StructField("timestamp_ns", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("raw", T.StringType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("level", T.StringType()),
    T.StructField("flagged_at", T.LongType()),
    T.StructField("pattern_key", T.StringType()),
    T.StructField("hit_count", T.IntegerType()),
    T.StructField("note", T.StringType()),
])


def _plus(schema: T.StructType, name: str, dtype) -> T.StructType:
    """A copy of ``schema`` with one more field (StructType.add mutates)."""
    return T.StructType(list(schema.fields) + [T.StructField(name, dtype)])


# --- flags (S5, S8, M2–M4) -------------------------------------------------------

def write_flags(flags: DataFrame, path: str, mode: str = "append") -> None:
    """Append flags, partitioned by UTC flag date.  A table with versions gets a new one."""
    table = VersionedTable(flags.sparkSession, path)
    if table.exists():
        if mode != "append":
            raise ValueError(f"{path} has versions; replace folders by a commit")
        return append_flags(flags, path)
    with_flag_date(flags.select(*FLAT_FLAGS.fieldNames())).write.mode(mode) \
        .partitionBy("flagged_date").parquet(path)


def append_flags(flags: DataFrame, path: str, stream: str | None = None, batch_id: int = 0) -> None:
    """S5 for tables that live jobs share: a new version with these flags; a micro-batch of a ``stream`` is appended once."""
    table = VersionedTable(flags.sparkSession, path)
    rows = with_flag_date(flags.select(*FLAT_FLAGS.fieldNames()))
    if stream is None:
        table.append(rows, partition_by=["flagged_date"])
    else:
        table.append_batch(rows, stream, batch_id, ["flagged_date"])


def read_flags(spark: SparkSession, path: str, since_ns: int | None = None,
               level: str | None = None, version: Version | None = None) -> DataFrame:
    """Flags of a stored table; an absent table is empty, not an error.

    Of a table with versions the current one is read, or ``version``.

    ``since_ns`` also filters the ``flagged_date`` partition column, so whole
    day folders before it are never listed or read (partition pruning);
    ``level`` is pushed into the parquet scan.
    """
    schema = _plus(FLAT_FLAGS, "flagged_date", T.DateType())
    table = VersionedTable(spark, path)
    if version is not None or table.exists():
        df = table.read(schema, version)
    elif _exists(spark, path):
        df = spark.read.schema(schema).parquet(path)
    else:
        return spark.createDataFrame([], FLAT_FLAGS)
    if since_ns is not None:
        day = F.lit(_utc_date(since_ns)).cast("date")
        df = df.filter((F.col("flagged_date") >= day) & (F.col("flagged_at") >= F.lit(int(since_ns))))
    if level is not None:
        df = df.filter(F.col("level") == F.lit(level))
    return df.drop("flagged_date")


def _utc_date(ns: int) -> str:
    import datetime as dt
    return (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=int(ns) // 1000)).date().isoformat()


def write_flags_jsonl(flags: DataFrame, path: str, mode: str = "append") -> None:
    """Interchange: one nested JSON object per line."""
    nest_entry(flags).write.mode(mode).json(path)


def read_flags_jsonl(spark: SparkSession, path: str):
    """S5 load + S9: (flags, counts) — malformed lines are skipped and counted."""
    schema = _plus(FLAGGED, "_corrupt_record", T.StringType())
    raw = (spark.read.schema(schema)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
           .json(path))
    bad = (F.col("_corrupt_record").isNotNull() | F.col("entry").isNull() | F.col("level").isNull()
           | F.col("flagged_at").isNull() | F.col("pattern_key").isNull() | F.col("hit_count").isNull()
           | F.col("entry.timestamp_ns").isNull() | F.col("entry.source").isNull() | F.col("entry.raw").isNull()
           | ~F.col("level").isin("PATTERN_WATCH", "CORRELATION", "TRIAGE", "AGGREGATE"))
    tagged = raw.withColumn("_bad", bad)
    good = flatten_entry(tagged.filter(~F.col("_bad")))
    counts = tagged.groupBy(F.when(F.col("_bad"), "malformed").otherwise("loaded").alias("outcome")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return good, counts


def archive_flags(spark: SparkSession, live_path: str, archive_path: str, new_live_path: str,
                  as_of_ns: int, days: int) -> int:
    """M3: move flags older than ``as_of - days`` to the archive.

    The archive is appended first, then the remaining flags are written as a
    new live version.  The append skips flags the archive already holds
    (anti-join on timestamp, key and level), so rerunning the job after a
    failure between the two writes archives nothing twice.  Returns the
    number of flags moved to the archive by this run.
    """
    cutoff = int(as_of_ns) - int(days) * NS_PER_DAY
    flags = read_flags(spark, live_path)
    old = flags.filter(F.col("flagged_at") < F.lit(cutoff))
    earliest = old.agg(F.min("flagged_at")).first()[0]
    # the archive can only hold copies of these flags from their earliest
    # date on: prune the anti-join's read to those partitions
    have = read_flags(spark, archive_path, since_ns=earliest if earliest is not None else cutoff) \
        .select("timestamp_ns", "pattern_key", "level")
    fresh = old.join(have, ["timestamp_ns", "pattern_key", "level"], "left_anti")
    n = fresh.count()
    if n:
        write_flags(fresh, archive_path, "append")
    write_flags(flags.filter(F.col("flagged_at") >= F.lit(cutoff)), new_live_path, "overwrite")
    return n


def archive_live(spark: SparkSession, live_path: str, archive_path: str, as_of_ns: int, days: int) -> int:
    """M3 on a table that live jobs append to: old flags go to the archive, the table's next version holds the rest.

    Only folders that hold old flags are written anew; a flag appended
    meanwhile lies in a folder of its own and stays.  The archive is
    appended first and takes nothing twice, so a pass that failed in between is
    simply run again.  Returns the number of flags moved.
    """
    cutoff = int(as_of_ns) - int(days) * NS_PER_DAY
    live = VersionedTable(spark, live_path)
    version = live.current()
    schema = _plus(FLAT_FLAGS, "flagged_date", T.DateType())
    old_in = [f for f in version.folders if not live.read(schema, folders=[f]).where(F.col("flagged_at") < F.lit(cutoff)).isEmpty()]
    if not old_in:
        return 0
    rows = live.read(schema, folders=old_in).drop("flagged_date")
    old = rows.where(F.col("flagged_at") < F.lit(cutoff))
    have = read_flags(spark, archive_path, since_ns=old.agg(F.min("flagged_at")).first()[0]).select("timestamp_ns", "pattern_key", "level")
    fresh = materialize(old.join(have, ["timestamp_ns", "pattern_key", "level"], "left_anti"))
    moved = fresh.count()
    if moved:
        append_flags(fresh, archive_path)
    rest = live.write(with_flag_date(rows.where(F.col("flagged_at") >= F.lit(cutoff))), partition_by=["flagged_date"])
    live.commit([rest], old_in)
    return moved


def clear_live(spark: SparkSession, live_path: str, level: str | None = None, memory_path: str | None = None) -> int:
    """M2 on a table that live jobs append to: the number of flags removed.  Flags appended meanwhile stay."""
    live = VersionedTable(spark, live_path)
    version = live.current()
    if not version.folders:
        return 0
    rows = read_flags(spark, live_path, version=version)
    gone = F.lit(True) if level is None else F.col("level") == F.lit(level)
    removed = materialize(rows.where(gone))
    count = removed.count()
    if memory_path is not None and count:
        append_flags(removed, memory_path)
    keep = live.write(with_flag_date(rows.where(~gone)), partition_by=["flagged_date"])
    live.commit([keep], version.folders)
    return count


def clear_flags(spark: SparkSession, live_path: str, new_live_path: str, level: str | None = None,
                memory_path: str | None = None) -> int:
    """M2: write the flags that remain as a new version; return the count removed.

    Clearing does not clear the dedup memory: with ``memory_path`` the
    removed flags are appended there (flag layout, so ``dedup_keys`` can read
    it next to the live table and the archive) and are never flagged again.
    """
    flags = read_flags(spark, live_path)
    removed = flags.filter(F.col("level") == F.lit(level)) if level else flags
    keep = flags.filter(F.col("level") != F.lit(level)) if level else flags.limit(0)
    if memory_path is not None:
        write_flags(removed, memory_path, "append")
    before = flags.count()
    write_flags(keep, new_live_path, "overwrite")
    return before - read_flags(spark, new_live_path).count()


def dedup_keys(spark: SparkSession, *paths: str, since_ns: int | None = None) -> DataFrame:
    """T5 memory: (timestamp_ns, pattern_key) of live and archived flags.

    ``since_ns`` (the earliest entry about to be processed) prunes the read
    to the date partitions that can still collide."""
    parts = [read_flags(spark, p, since_ns=since_ns).select("timestamp_ns", "pattern_key") for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


# --- rolling buffer (S6) ------------------------------------------------------------

def write_buffer(entries: DataFrame, path: str) -> None:
    """Snapshot of the rolling buffer as JSON lines (the interchange format)."""
    entries.select(*LOG_ENTRY.fieldNames()).write.mode("overwrite").json(path)


def read_buffer(spark: SparkSession, path: str, as_of_ns: int, hours: int = ROLLING_WINDOW_HOURS):
    """S6 load: (entries, counts); expired and malformed rows are discarded and
    counted."""
    schema = _plus(LOG_ENTRY, "_corrupt_record", T.StringType())
    raw = (spark.read.schema(schema).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    cutoff = int(as_of_ns) - int(hours) * 3600 * 1_000_000_000
    outcome = (F.when(F.col("_corrupt_record").isNotNull() | F.col("timestamp_ns").isNull()
                      | F.col("source").isNull() | F.col("raw").isNull(), "malformed")
               .when(F.col("timestamp_ns") < F.lit(cutoff), "expired")
               .otherwise("loaded"))
    tagged = raw.withColumn("outcome", outcome)
    good = tagged.filter(F.col("outcome") == "loaded").select(*LOG_ENTRY.fieldNames())
    counts = tagged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    return good, counts


# --- baseline (S7) --------------------------------------------------------------------

#: A journal record: its time and the hash of all its fields.
SEEN_KEYS = ["source", "timestamp_ns", "seq"]


#: The UTC day of a record, by which records are kept.
SEEN_DAY = f"(timestamp_ns - pmod(timestamp_ns, {NS_PER_DAY}L)) div {NS_PER_DAY}L"
_SEEN = T.StructType([T.StructField("source", T.StringType()), T.StructField("timestamp_ns", T.LongType()),
                      T.StructField("seq", T.LongType()), T.StructField("n", T.LongType())])


def _seen_index(spark: SparkSession, path: str) -> dict[int, str]:
    """Day -> folder of its records, for a version ``path``; one row a day."""
    index = os.path.join(path, "seen_index")
    if not _exists(spark, index):
        return {}
    return {r["day"]: r["folder"] for r in spark.read.schema("day long, folder string").parquet(index).collect()}


def read_seen(spark: SparkSession, path: str, days=None) -> DataFrame | None:
    """Records that a version holds (SEEN_KEYS and n), of some days only; None if the version doesn't tell."""
    if not _exists(spark, os.path.join(path, "seen_index")):
        return None
    index = _seen_index(spark, path)
    folders = [f"{folder}/day={day}" for day, folder in sorted(index.items()) if days is None or day in days]
    if not folders:
        return spark.createDataFrame([], _SEEN)
    return spark.read.schema(_SEEN).parquet(*folders)


def seen_days(records: DataFrame) -> set:
    """Days of records; as many as the records have days."""
    return {r[0] for r in records.select(F.expr(SEEN_DAY).alias("day")).distinct().collect()}


def write_seen(spark: SparkSession, path: str, records: DataFrame, days: set, previous: str | None = None) -> None:
    """Keep ``records``, all those of ``days``, in a version; the other days stay in the folders that ``previous`` names."""
    folder = os.path.join(path, "seen")
    if days:
        records.withColumn("day", F.expr(SEEN_DAY)).repartition("day", F.pmod(F.xxhash64(*SEEN_KEYS), F.lit(8))) \
            .write.mode("overwrite").partitionBy("day").parquet(folder)
    index = (_seen_index(spark, previous) if previous else {}) | {day: folder for day in days}
    spark.createDataFrame(sorted(index.items()), "day long, folder string").coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "seen_index"))


def save_baseline(path: str, baseline: DataFrame, keywords: DataFrame, boots: DataFrame,
                  meta: DataFrame, hourly: DataFrame | None = None) -> None:
    """The state tables, each in its own folder of a version ``path``: the four
    that readers use, and the hourly counts that a later seeding goes on from."""
    for name, df in (("baseline", baseline), ("keyword_stats", keywords), ("boot_stats", boots), ("meta", meta), ("hourly", hourly)):
        if df is not None:
            df.write.mode("overwrite").parquet(os.path.join(path, name))


def load_baseline(spark: SparkSession, path: str) -> dict:
    keyword_first = _plus(KEYWORD_STATS, "first_seen_ns", T.LongType())
    hourly = os.path.join(path, "hourly")
    return {
        "baseline": spark.read.schema(BASELINE).parquet(os.path.join(path, "baseline")),
        "keyword_stats": spark.read.schema(KEYWORD_STATS).parquet(os.path.join(path, "keyword_stats")),
        "keyword_first": spark.read.schema(keyword_first).parquet(os.path.join(path, "keyword_stats")),
        "boot_stats": spark.read.schema(BOOT_STATS).parquet(os.path.join(path, "boot_stats")),
        "meta": spark.read.parquet(os.path.join(path, "meta")),
        "hourly": spark.read.parquet(hourly) if _exists(spark, hourly) else None,
        "seen": read_seen(spark, path),
    }


_BUCKET = T.StructType([T.StructField("count", T.LongType()), T.StructField("mean", T.DoubleType()),
                        T.StructField("M2", T.DoubleType())])
_KWSTAT = T.StructType([T.StructField("hits", T.LongType()), T.StructField("last_seen_ns", T.LongType())])
_META = T.StructType([
    T.StructField("first_seen_ns", T.LongType()),
    T.StructField("direct_observation_days", T.DoubleType()),
    T.StructField("seed_days", T.DoubleType()),
    T.StructField("seeded", T.BooleanType()),
    T.StructField("notice_acknowledged", T.BooleanType()),
])
BASELINE_DOCUMENT = T.StructType([
    T.StructField("meta", _META),
    T.StructField("buckets", T.MapType(T.StringType(), T.MapType(T.StringType(), _BUCKET))),
    T.StructField("keywords", T.MapType(T.StringType(), T.MapType(T.StringType(), _KWSTAT))),
    T.StructField("boot_windows", T.MapType(T.StringType(), T.MapType(T.StringType(), _KWSTAT))),
    T.StructField("boot_order", T.ArrayType(T.StringType())),
])


def import_baseline_document(spark: SparkSession, path: str) -> dict:
    """Import a baseline JSON document of the original tool (one document per
    file): nested maps are flattened into the engine's tables with two
    ``explode`` calls each; missing meta keys default to 0 / false."""
    doc = spark.read.schema(BASELINE_DOCUMENT).option("multiLine", "true").json(path)

    def flat(col, inner, names):
        a = doc.select(F.explode(col).alias("k1", "m"))
        b = a.select("k1", F.explode("m").alias("k2", "s"))
        return b.select(F.col("k1").alias(names[0]), F.col("k2").alias(names[1]), *[F.col(f"s.{f}") for f in inner])

    buckets = flat("buckets", ["count", "mean", "M2"], ["source", "slot_key"]).withColumnRenamed("M2", "m2")
    keywords = flat("keywords", ["hits", "last_seen_ns"], ["source", "keyword"])
    boots = flat("boot_windows", ["hits", "last_seen_ns"], ["boot_id", "keyword"])
    order = doc.select(F.posexplode("boot_order").alias("boot_pos", "boot_id"))
    meta = doc.select(
        F.coalesce("meta.first_seen_ns", F.lit(0)).cast("long").alias("first_seen_ns"),
        F.coalesce("meta.direct_observation_days", F.lit(0.0)).alias("direct_days"),
        F.coalesce("meta.seed_days", F.lit(0.0)).alias("seed_days"),
        F.coalesce("meta.seeded", F.lit(False)).alias("seeded"),
        F.coalesce("meta.notice_acknowledged", F.lit(False)).alias("notice_acknowledged"))
    return {"baseline": buckets, "keyword_stats": keywords, "boot_stats": boots,
            "boot_order": order, "meta": meta}


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)
    except Exception:  # noqa: BLE001 - sessions without a JVM gateway
        try:
            spark.read.format("binaryFile").load(path).limit(1).count()
            return True
        except Exception:  # noqa: BLE001
            return False


#: What every source gives: the entry, an order key for equal times, and where it comes from, null where unknown.  ``seq``
#: is the arrival number only where an ``ArrivalCursor`` gave it; R2 and R4 need that one.
ENTRY_CONTRACT = ["timestamp_ns", "seq", "source", "raw", "priority", "unit", "boot_id", "monotonic_us"]


def as_entries(frame: DataFrame) -> DataFrame:
    """``frame`` with all columns of the contract; those it lacks are null."""
    kinds = {"priority": "int", "monotonic_us": "string", "seq": "long", "timestamp_ns": "long"}
    return frame.select(*[(F.col(c) if c in frame.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c)
                          for c in ENTRY_CONTRACT])


def _text_lines(lines: DataFrame, timestamp_ns) -> DataFrame:
    """Lines with their file: arrival order is the order of files and of blocks in them.

    Lines of one block share that order; the row id that the alert pipeline
    gives each stored hit tells them apart.
    """
    path, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return as_entries(lines.select(
        timestamp_ns.alias("timestamp_ns"), F.element_at(F.split(path, "/"), -1).alias("source"), F.col("value").alias("raw"),
        block.alias("seq")))


def text_log(spark: SparkSession, path: str) -> DataFrame:
    """S3: flat log files -> entries; one row per line, source = file base
    name, priority unknown, timestamp = the file's modification time (a
    deterministic stand-in for the ingest time of a batch read)."""
    lines = spark.read.option("wholetext", "false").text(path)
    return _text_lines(lines, F.unix_micros(F.col("_metadata.file_modification_time")) * F.lit(1000))


def new_text_lines(spark: SparkSession, path: str, cursor: ArrivalCursor):
    """S3 + R4: (entries, commit) of the lines of flat log files that no pass of ``cursor`` took yet, numbered by arrival."""
    fresh, commit = cursor.number(placed_lines(spark, path))
    return as_entries(fresh.select(F.col("file_ns").alias("timestamp_ns"), F.element_at(F.split("path", "/"), -1).alias("source"),
                                   F.col("value").alias("raw"), "seq")), commit


def text_log_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """S3 live: new files in a folder (rotation = a new file); ingest time is
    the micro-batch time."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return _text_lines(reader.load(path), F.unix_micros(F.current_timestamp()) * F.lit(1000))


def union_sources(*frames: DataFrame) -> DataFrame:
    """All sources as one table of log entries, with every column of the contract."""
    out = as_entries(frames[0])
    for f in frames[1:]:
        out = out.unionByName(as_entries(f))
    return out
