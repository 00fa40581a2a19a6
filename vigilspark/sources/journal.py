"""Journal JSON sources and the malformed-row split.

Journal exports are read with an explicit all-string schema (never
inferred).  Blank and non-JSON lines are rejected and counted instead of
failing the job.  The batch history scan drops rows whose
``__REALTIME_TIMESTAMP`` is not an integer; the live stream uses the ingest
time for them instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.schemas import JOURNAL_RECORD
from vigilspark.sources.arrival import ArrivalCursor, placed_lines

_PARSE_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def parse_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """JSON text lines -> journal columns + ``reject_reason`` (null = good).

    Reasons: ``blank``, ``malformed``, ``bad_timestamp``.
    """
    v = F.col(value_col)
    rec = F.from_json(v, JOURNAL_RECORD, _PARSE_OPTIONS)
    parsed = lines.select("*", rec.alias("_j"))
    fields = [F.col(f"_j.{f.name}").alias(f.name) for f in JOURNAL_RECORD.fields if f.name != "_corrupt_record"]
    reason = (F.when(F.trim(v) == "", F.lit("blank"))
              .when(F.col("_j").isNull() | F.col("_j._corrupt_record").isNotNull(), F.lit("malformed"))
              .when(F.col("_j.__REALTIME_TIMESTAMP").try_cast("long").isNull(), F.lit("bad_timestamp")))
    return parsed.select(*[c for c in lines.columns], *fields, reason.alias("reject_reason"))


def journal_entries(parsed: DataFrame, ingest_ns: Column | None = None, keep=()) -> DataFrame:
    """Journal columns -> log entries.

    raw = unit || ': ' || message with unit = _SYSTEMD_UNIT, else
    SYSLOG_IDENTIFIER, else 'unknown'; source is 'journalctl'; the priority
    is ``try_cast`` (non-integers become null).  ``ingest_ns`` replaces bad
    timestamps (stream semantics); without it those rows must already be
    filtered out (batch semantics).
    """
    ts = F.col("__REALTIME_TIMESTAMP").try_cast("long") * F.lit(1000)
    if ingest_ns is not None:
        ts = F.coalesce(ts, ingest_ns)
    unit = F.coalesce(F.col("_SYSTEMD_UNIT"), F.col("SYSLOG_IDENTIFIER"), F.lit("unknown"))
    # without an arrival number ``seq`` only breaks ties of time: a hash of the
    # record (identical records are identical entries)
    fields = [f.name for f in JOURNAL_RECORD.fields if f.name != "_corrupt_record"]
    seq = [] if "seq" in keep else [F.xxhash64(*fields).alias("seq")]
    return parsed.select(
        *keep,
        *seq,
        ts.alias("timestamp_ns"),
        F.lit("journalctl").alias("source"),
        F.concat(unit, F.lit(": "), F.coalesce(F.col("MESSAGE"), F.lit(""))).alias("raw"),
        F.col("PRIORITY").try_cast("int").alias("priority"),
        unit.alias("unit"),
        F.col("_BOOT_ID").alias("boot_id"),
        F.col("__MONOTONIC_TIMESTAMP").alias("monotonic_us"))


def split_rejects(parsed: DataFrame, drop_bad_timestamp: bool = True):
    """(good, rejects).  With ``drop_bad_timestamp=False`` (live stream)
    bad timestamps stay good and get the ingest time later.

    The split is a conditional ``explode`` rather than a ``filter``: a filter
    would be pushed below the parsing projection with ``from_json`` inlined
    into its condition, parsing every line several times.
    """
    bad = F.col("reject_reason").isNotNull()
    if not drop_bad_timestamp:
        bad = bad & (F.col("reject_reason") != "bad_timestamp")
    cols = parsed.columns

    def keep(cond):
        row = F.struct(*[F.col(c) for c in cols])
        return (parsed.select(F.explode(F.array_compact(F.array(F.when(cond, row)))).alias("_r"))
                .select(*[F.col(f"_r.{c}").alias(c) for c in cols]))

    return keep(~bad), keep(bad)


def reject_counts(parsed: DataFrame) -> DataFrame:
    """Loaded vs discarded, per reason (``loaded`` for good rows)."""
    return (parsed.groupBy(F.coalesce("reject_reason", F.lit("loaded")).alias("outcome"))
            .agg(F.count(F.lit(1)).alias("n")))


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Journal history export (JSON lines files) -> log entries."""
    lines = spark.read.text(path)
    good, _ = split_rejects(parse_lines(lines))
    return journal_entries(good)


def new_entries(spark: SparkSession, path: str, cursor: ArrivalCursor):
    """S1 + R4: (entries, outcome counts, commit) of the lines that no pass of ``cursor`` took yet.

    ``seq`` is the arrival number of the line.  Counts are those of S9 over
    the new lines; ``commit`` keeps the cursor, once the entries are kept.
    """
    fresh, commit = cursor.number(parse_lines(placed_lines(spark, path)))
    good, _ = split_rejects(fresh)
    return journal_entries(good, keep=["seq"]), reject_counts(fresh), commit


def read_parsed_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Journal lines of a growing folder, parsed, the rejects among them."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return parse_lines(reader.load(path))


def live_entries(parsed: DataFrame) -> DataFrame:
    """Entries of parsed lines as the live job takes them: bad timestamps get the micro-batch time."""
    good, _ = split_rejects(parsed, drop_bad_timestamp=False)
    return journal_entries(good, ingest_ns=F.unix_micros(F.current_timestamp()) * F.lit(1000))


def read_journal_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The entries of a growing folder with Structured Streaming."""
    return live_entries(read_parsed_stream(spark, path, max_files_per_trigger))
