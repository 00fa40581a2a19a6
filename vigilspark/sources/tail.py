"""S3 for files that grow: a streaming data source that reads each line once, by byte offsets.

A file is told by its device and inode, so a rotated file (renamed, a new one
under its name) is read to its end under its new name, beside the new one.  A
file that got shorter starts over.  Only whole lines are taken: bytes behind
the last line feed wait for the next trigger.  A micro-batch is a list of byte
ranges, cut at ``RANGE_BYTES`` so that a large backlog is read by many tasks;
a replay reads the same ranges.  Undecodable bytes become replacement
characters.

The files must lie where the driver and all executors see them, in a file
system that appends in place and keeps inodes.  What was read is part of the
query's checkpoint.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from vigilspark.sources.store import as_entries

RANGE_BYTES = 64 << 20
_STEP = 1 << 16


def _identity(path: str) -> tuple[str, int] | None:
    """(device:inode, size) of a file; None if it is gone."""
    try:
        s = os.stat(path)
    except FileNotFoundError:
        return None
    return f"{s.st_dev}:{s.st_ino}", s.st_size


def _last_line_end(path: str, start: int, size: int) -> int:
    """Offset behind the last line feed in [start, size); ``start`` if there is none."""
    with open(path, "rb") as f:
        end = size
        while end > start:
            begin = max(start, end - _STEP)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return start


@dataclass
class FileRange(InputPartition):
    """Lines of a file that start in [start, end); ``first`` is where the range's first line may be cut."""

    file: str
    path: str
    start: int
    end: int
    first: bool


class TailReader(DataSourceStreamReader):
    """Offsets: {"files": {key: [path, bytes taken]}}; the key is a file's identity and how often it started over."""

    def __init__(self, options: dict):
        self.pattern = options["path"]
        self.from_end = options.get("start", "end") == "end"
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.known: dict | None = None

    def _files(self) -> list[str]:
        pattern = os.path.join(self.pattern, "*") if os.path.isdir(self.pattern) else self.pattern
        return sorted(p for p in glob.glob(pattern) if os.path.isfile(p))

    def initialOffset(self) -> dict:
        files = {}
        if self.from_end:
            for path in self._files():
                found = _identity(path)
                if found:
                    files[f"{found[0]}:0"] = [path, found[1]]
        return {"files": files}

    def latestOffset(self) -> dict:
        before = self.known["files"] if self.known is not None else self.initialOffset()["files"]
        newest: dict[str, str] = {}  # identity -> its latest key
        for key in before:
            identity, start = key.rsplit(":", 1)
            if identity not in newest or int(start) > int(newest[identity].rsplit(":", 1)[1]):
                newest[identity] = key
        files = {k: list(v) for k, v in before.items()}
        # rotated files lie beside their old names
        listed = set(self._files())
        beside = {os.path.join(d, n) for d in {os.path.dirname(p) for p, _ in before.values()} if os.path.isdir(d) for n in os.listdir(d)}
        for path in sorted(listed | {p for p in beside if os.path.isfile(p)}):
            found = _identity(path)
            if found is None or path not in listed and found[0] not in newest:
                continue
            identity, size = found
            key = newest.get(identity, f"{identity}:0")
            taken = files[key][1] if key in files else 0
            if size < taken:  # truncated in place
                key, taken = f"{identity}:{int(key.rsplit(':', 1)[1]) + 1}", 0
            files[key] = [path, _last_line_end(path, taken, size)]
        self.known = {"files": files}
        return self.known

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        if self.known is None:  # after a restart: go on from the checkpoint
            self.known = end
        out = []
        for key, (path, upto) in sorted(end["files"].items()):
            at = start["files"].get(key, [path, 0])[1]
            for a in range(at, upto, self.range_bytes):
                out.append(FileRange(key, path, a, min(a + self.range_bytes, upto), a == at))
        return out or [FileRange("", "", 0, 0, True)]

    def read(self, part: FileRange) -> Iterator[tuple]:
        if part.start >= part.end:
            return
        path = self._path_of(part)
        if path is None:
            return  # deleted before it was read
        with open(path, "rb") as f:
            at = part.start
            if not part.first:  # the line going on here belongs to the range before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < part.end:
                line = f.readline()
                if not line:
                    break
                yield part.path, part.file, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)

    @staticmethod
    def _path_of(part: FileRange) -> str | None:
        """Where the file lies now: under its path, or renamed beside it."""
        identity = part.file.rsplit(":", 1)[0]
        folder = os.path.dirname(part.path)
        names = [part.path] + sorted(os.path.join(folder, n) for n in os.listdir(folder)) if os.path.isdir(folder) else [part.path]
        return next((p for p in names if (found := _identity(p)) and found[0] == identity), None)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """``spark.readStream.format("vigil_tail").option("path", folder or pattern)``; option ``start``: end (default) or beginning."""

    @classmethod
    def name(cls) -> str:
        return "vigil_tail"

    def schema(self) -> str:
        return "path string, file string, at long, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader({k.lower(): v for k, v in self.options.items()})


def tail_logs(spark: SparkSession, path: str, start: str = "end", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """S3 live: lines appended to files, as entries; source is the file's base name when it was read, ``seq`` the line's byte offset, the time that of the micro-batch."""
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("vigil_tail").option("path", path).option("start", start).option("rangeBytes", str(range_bytes)).load()
    return as_entries(lines.select(
        (F.unix_micros(F.current_timestamp()) * F.lit(1000)).alias("timestamp_ns"), F.element_at(F.split("path", "/"), -1).alias("source"),
        F.col("value").alias("raw"), F.col("at").alias("seq")))
