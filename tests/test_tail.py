"""Files that grow, rotate and shrink: every line once."""

import os

import pytest

from vigilspark.sources import store
from vigilspark.sources.tail import TailReader, tail_logs


def put(path, data, mode="ab"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(data)


class Following:
    def __init__(self, spark, path, tmp, **kw):
        self.rows, self.spark, self.path, self.tmp, self.kw = [], spark, path, tmp, kw
        self.start()

    def start(self):
        def sink(batch, batch_id):
            self.rows += [(r.source, r.raw) for r in batch.collect()]

        self.query = tail_logs(self.spark, self.path, **self.kw).writeStream.foreachBatch(sink).option(
            "checkpointLocation", f"{self.tmp}/ck").trigger(processingTime="100 milliseconds").start()

    def lines(self):
        self.query.processAllAvailable()
        got, self.rows[:] = sorted(self.rows), []
        return got


def test_appended_rotated_and_truncated_files(spark, tmpdir_path):
    log = f"{tmpdir_path}/logs/app.log"
    put(log, b"old 1\nold 2\n")
    follow = Following(spark, f"{tmpdir_path}/logs/*.log", tmpdir_path, range_bytes=16)
    try:
        assert follow.lines() == []
        put(log, "one\ntwo é\r\nbad \xff\n".encode("latin-1") + b"hal")
        assert follow.lines() == [("app.log", "bad �"), ("app.log", "one"), ("app.log", "two �")]
        put(log, b"f\nlast before the rotation\n")
        os.rename(log, f"{tmpdir_path}/logs/app.log.1")
        put(f"{tmpdir_path}/logs/app.log.1", b"written late\n")
        put(log, b"new file\n")
        assert sorted(raw for _, raw in follow.lines()) == ["half", "last before the rotation", "new file", "written late"]
        follow.query.stop()
        put(log, b"while stopped\n")
        put(f"{tmpdir_path}/logs/b.log", b"second file\n")
        follow.start()
        assert follow.lines() == [("app.log", "while stopped"), ("b.log", "second file")]
        put(log, b"x\n", "wb")  # truncated in place
        assert follow.lines() == [("app.log", "x")]
        assert follow.lines() == []
    finally:
        follow.query.stop()


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_ranges_cut_no_line(tmpdir_path, size):
    lines = [f"line {i} " + "é" * (i % 9) for i in range(60)] + [""] * 3
    put(f"{tmpdir_path}/x.log", ("\n".join(lines) + "\nrest").encode())
    reader = TailReader({"path": f"{tmpdir_path}/x.log", "start": "beginning", "rangebytes": str(size)})
    start, end = reader.initialOffset(), reader.latestOffset()
    parts = reader.partitions(start, end)
    assert len(parts) > 1 or size == 1000
    got = [row for p in parts for row in reader.read(p)]
    assert [r[3] for r in got] == lines and [r[2] for r in got] == sorted({r[2] for r in got})
    assert list(reader.read(reader.partitions(end, end)[0])) == []


def test_text_log_gives_every_line(spark, tmpdir_path):
    put(f"{tmpdir_path}/t/a.log", b"one\n\ntwo\n")
    put(f"{tmpdir_path}/t/b.log", b"\xff three")
    got = sorted((r.source, r.raw, r.priority) for r in store.text_log(spark, f"{tmpdir_path}/t").collect())
    assert got == [("a.log", "", None), ("a.log", "one", None), ("a.log", "two", None), ("b.log", "� three", None)]
