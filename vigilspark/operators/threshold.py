"""T2/T3/T6/T7/T8: "k hits within W seconds, reset on fire" as a distributed Spark job.

Semantics, per key, hits in (timestamp_ns, seq) order:

* a hit fires when the hits counted since the last fire and still retained
  (not older than ``W``, the lower bound included, and among the last
  ``samples``) number at least ``required``, and come from at least
  ``min_sources`` sources; the count then starts anew;
* a hit whose (timestamp_ns, key) already fired is ignored before it is
  counted, so a fire skips the rest of its run of equal timestamps;
* ``W == 0`` fires on every hit; ``samples < required`` with a window never.

With positions g in that order, let r be the first position counted since the
last fire.  Hit g fires iff max(r, a) <= b, where a is the oldest position
that it may count (by time, by samples, by the last reset) and b the newest
from which ``required`` hits and ``min_sources`` sources lie up to g.  Neither
depends on r, so everything but r is local:

1. Hits are sorted by (key, timestamp, seq) over range partitions, which
   split a hot key, a burst and a run of equal timestamps alike by row count;
   a row's position is its number there plus the sizes of the partitions before.
2. Positions are cut into blocks of ``block_rows``; each block also sees the
   few rows before it that its hits can reach back to.  A block finds its
   candidates (a <= b) and what every possible r on entering it becomes on
   leaving it: r matters only within ``samples`` positions, so that is a short table.
3. The tables compose; they are folded in groups of ``FAN`` blocks, those
   groups again, and the states handed down the same tree, so that no key's
   blocks meet in one task.
4. Each block jumps from fire to fire from its entry state.

Keys are told by their 64-bit hash.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.config import NS_PER_SECOND, Threshold
from vigilspark.session import store

#: What a task holds at once: four tasks of an executor keep well under a GB of Python.
BLOCK_ROWS = 50_000
FAN = 256


def is_immediate(th: Threshold) -> bool:
    """Every (deduplicated) hit fires: no window, or k = 1 with a history."""
    return th.window_seconds == 0 or (int(th.required) <= 1 and th.samples >= 1)


def _ids(hits: DataFrame) -> list[str]:
    """Columns that name a hit: ``seq``, and ``rid`` where equal records share their ``seq``."""
    return [c for c in ("seq", "rid") if c in hits.columns]


def immediate_fires(hits: DataFrame, keys=("pattern_key", "level")) -> DataFrame:
    """Every hit fires; equal (timestamp_ns, key) hits fire once (lowest seq)."""
    ids = _ids(hits)
    return (hits.groupBy(*keys, "timestamp_ns").agg(F.min(F.struct(*ids)).alias("_first"))
            .select(*keys, "timestamp_ns", *[F.col(f"_first.{c}").alias(c) for c in ids], F.lit(1).alias("hit_count")))


# ------------------------------------------------------------------ positions

def _part_offsets(placed: DataFrame, at: str, size: Column) -> DataFrame:
    """(_part, _before): what the partitions before each one hold; one row for each task of a write."""
    total, rows = 0, []
    part = F.shiftright(at, 33).alias("_part")
    for r in placed.groupBy(part).agg(size.alias("n")).orderBy("_part").collect():
        rows.append((r["_part"], total))
        total += r["n"]
    # an Arrow table needs no Python workers on the executors, as a list of rows does
    found = pa.table({"_part": pa.array([p for p, _ in rows], pa.int64()), "_before": pa.array([n for _, n in rows], pa.int64())})
    return F.broadcast(placed.sparkSession.createDataFrame(found))


def positioned(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``g``: their number in ``order``, counted over range partitions."""
    placed = store(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn("_at", F.monotonically_increasing_id()))
    before = _part_offsets(placed, "_at", F.count("*"))
    number = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.join(before, F.shiftright("_at", 33) == F.col("_part")).withColumn("g", number).drop("_at", "_part", "_before")


# --------------------------------------------------------------------- blocks

class _Block:
    """Rows of a block in order, those before it included; finds candidates and walks fires.

    A state is what r is on entering: ``lo - e`` for e = 0 .. reach (further back
    makes no difference), or reach + 1: a fire lies in the run of equal timestamps
    that the block's first rows may go on with.
    """

    def __init__(self, pdf: pd.DataFrame, block_rows: int, reach: int):
        pdf = pdf.sort_values("g", kind="stable")
        g, kh, t = (pdf[c].to_numpy() for c in ("g", "kh", "t"))
        k, n, m, low = (pdf[c].to_numpy() for c in ("k", "n", "m", "low"))
        own = g // block_rows == pdf["block"].to_numpy()
        first = int(own.argmax())
        self.reach, self.lo, self.hi = reach, int(g[first]), int(g[-1])
        new_key = np.concatenate([[True], kh[1:] != kh[:-1]])
        new_time = new_key | np.concatenate([[True], t[1:] != t[:-1]])
        segment = np.cumsum(new_key)
        # a: first row of the segment not older than ``low``; times as ranks, so that (segment, time) is one number
        times = np.unique(t)
        combined = segment * len(times) + np.searchsorted(times, t)
        oldest = g[np.searchsorted(combined, segment * len(times) + np.searchsorted(times, low), side="left")]
        a = np.maximum(oldest, g - n + 1)
        b = g - k + 1
        if (m > 1).any():
            b = np.where(m > 1, np.minimum(b, _distinct_back(g, pdf["src"].to_numpy(), m)), b)
        run = np.cumsum(new_time)
        starts = np.flatnonzero(new_time)
        run_end = np.append(starts[1:], len(g))[run - 1] - 1
        cand = own & (a <= b)
        self.g, self.a, self.b, self.segment = g[cand], a[cand], b[cand], segment[cand]
        # r after a fire; a run that reaches the block's end may go on behind it
        self.after = g[run_end][cand] + 1
        self.last_segment, self.fresh = int(segment[-1]), bool(new_key[first])
        self.first_segment = int(segment[first])
        same_run = run[first:] == run[first - 1] if first else np.zeros(len(g), dtype=bool)
        self.skip_to = int(g[first + same_run.sum() - 1]) + 1 if same_run.any() else self.lo
        self.whole_run = bool(same_run.all()) if first else False
        self.next_segment = np.searchsorted(self.segment, self.segment, side="right")
        self.jump = np.minimum(np.searchsorted(self.b, self.after), self.next_segment).tolist()

    def start(self, state: int) -> tuple[int, int]:
        """(r on entering, number of the first candidate that can fire)."""
        if self.fresh:
            r = self.lo
        else:
            r = self.skip_to if state > self.reach else self.lo - state
        at = int(np.searchsorted(self.b, r))
        return r, min(at, int(np.searchsorted(self.segment, self.first_segment, side="right")))

    def leave(self, state: int, last: int | None) -> int:
        """State on leaving, ``last`` the last fire's number, if any, in the last row's segment."""
        if last is not None:
            r = int(self.after[last])
        elif self.first_segment != self.last_segment or self.fresh:
            return self.reach  # nothing fired in this segment: its count began at its first row
        elif state > self.reach and self.whole_run:
            return state
        else:
            r = self.start(state)[0]
        return self.reach + 1 if r > self.hi else min(self.reach, self.hi + 1 - r)

    def table(self) -> list[int]:
        """State on leaving for every state on entering."""
        size, n = self.reach + 2, len(self.g)
        end = [None] * (n + 1)  # last fire in the last segment, from a fire on
        for i in range(n - 1, -1, -1):
            nxt = self.jump[i]
            end[i] = end[nxt] if nxt < n else (i if self.segment[i] == self.last_segment else None)
        out = []
        for state in range(size):
            at = self.start(state)[1]
            out.append(self.leave(state, end[at] if at < n else None))
        return out

    def fires(self, state: int) -> tuple[list[int], list[int]]:
        """(positions, hits counted) of the fires from an entry state."""
        where, counts, n = [], [], len(self.g)
        r, at = self.start(state)
        while at < n:
            where.append(int(self.g[at]))
            counts.append(int(self.g[at] - max(r, self.a[at]) + 1))
            nxt = self.jump[at]
            r = int(self.after[at]) if nxt < n and self.segment[nxt] == self.segment[at] else 0
            at = nxt
        return where, counts


def _distinct_back(g: np.ndarray, src: np.ndarray, m: np.ndarray) -> np.ndarray:
    """For each row the newest position from which m sources lie up to the row; -1 if there is none."""
    most = int(m.max())
    top = np.full((most, len(g)), -1, dtype=np.int64)  # last positions of sources, newest first
    for code in np.unique(src):
        seen = np.maximum.accumulate(np.where(src == code, g, -1))
        for level in range(most):
            top[level], seen = np.maximum(top[level], seen), np.minimum(top[level], seen)
    return top[np.maximum(m, 1) - 1, np.arange(len(g))]


# ----------------------------------------------------------------- state tree

def _run(tables: list[bytes], state: int) -> list[int]:
    """States on entering each of the tables in turn, and on leaving the last."""
    states = [state]
    for t in tables:
        states.append(int(np.frombuffer(t, dtype=np.int32)[states[-1]]))
    return states


def _entry_states(tables: DataFrame) -> DataFrame:
    """(node, state) on entering every node of ``tables`` (node, table), in order of node."""
    def compose(key, pdf):
        whole = None
        for t in pdf.sort_values("node")["table"]:
            t = np.frombuffer(t, dtype=np.int32)
            whole = t if whole is None else t[whole]
        return pd.DataFrame({"node": [key[0]], "table": [whole.tobytes()]})

    def hand_down(key, pdf):
        pdf = pdf.sort_values("node")
        return pd.DataFrame({"node": pdf["node"], "state": _run(list(pdf["table"]), int(pdf["state"].iloc[0]))[:-1]})

    parent = F.expr(f"node div {FAN}")
    levels = [tables]
    while levels[-1].limit(FAN + 1).count() > FAN:
        levels.append(store(levels[-1].groupBy(parent.alias("up")).applyInPandas(compose, "node long, table binary")))
    states = None
    for level in reversed(levels):
        if states is None:  # the first block is the start of a key: any state will do
            rows = level.withColumn("state", F.lit(0)).withColumn("up", F.lit(0).cast("long"))
        else:
            rows = level.withColumn("up", parent).join(states.toDF("up", "state"), "up")
        states = rows.groupBy("up").applyInPandas(hand_down, "node long, state int")
    return states


# ------------------------------------------------------------------ operators

def _last_resets(rows: DataFrame, resets: DataFrame, keys: list[str]) -> DataFrame:
    """(kh, t, reset): the last reset of the key up to t, for hits that have one; a reset without level is one of every level.

    Hits and resets are sorted together by (key, time) over range partitions,
    where the last reset is carried along; what a key that goes on over
    partitions had before comes from a table of one row a task.  So a hit meets
    one reset, however many lie in its window.
    """
    cut = [c for c in keys if c in resets.columns]
    known = rows.select("kh", *keys).distinct()
    tests = [(known[c] == resets[c]) if c != "level" else (resets[c].isNull() | (known[c] == resets[c])) for c in cut]
    none = F.lit(None).cast("long")
    marks = known.join(resets, reduce(lambda a, b: a & b, tests)).select(
        known["kh"], F.col("at_ns").alias("t"), F.lit(0).alias("hit"), F.col("at_ns").alias("reset")).distinct()
    times = rows.select("kh", "t").distinct().select("kh", "t", F.lit(1).alias("hit"), none.alias("reset"))
    order = ["kh", "t", "hit"]  # a reset counts for the hits of its own time

    def carry(batches):
        last_key, last = None, pd.NA
        for pdf in batches:
            if not len(pdf):
                continue
            reset = pdf["reset"].astype("Int64").groupby(pdf["kh"]).ffill()
            first = (pdf["kh"] == last_key) & reset.isna() if last_key is not None else pd.Series(False, index=pdf.index)
            reset = reset.mask(first, last)
            last_key, last = pdf["kh"].iloc[-1], reset.iloc[-1]
            yield pdf.assign(reset=reset)

    placed = store(times.unionByName(marks).repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn("_at", F.monotonically_increasing_id()).mapInPandas(carry, "kh long, t long, hit int, reset long, _at long"))
    part = F.shiftright("_at", 33).alias("_part")
    tails = placed.groupBy(part).agg(F.min("kh").alias("first"), F.max_by(F.struct("kh", "reset"), "_at").alias("tail")).orderBy("_part").collect()
    before, held = [], (None, None)
    for r in tails:
        mine = held[1] if held[0] == r["first"] else None
        before.append((r["_part"], r["first"], mine))
        held = (r["tail"]["kh"], r["tail"]["reset"] if r["tail"]["reset"] is not None or r["tail"]["kh"] != r["first"] else mine)
    given = F.broadcast(placed.sparkSession.createDataFrame(before, "_part long, _first long, _given long"))
    last = F.coalesce("reset", F.when(F.col("kh") == F.col("_first"), F.col("_given")))
    return placed.where("hit = 1").join(given, F.shiftright("_at", 33) == F.col("_part")).select("kh", "t", last.alias("reset")).where("reset is not null")


def windowed_fires(hits: DataFrame, groups: dict, keys=("pattern_key", "level"), resets: DataFrame | None = None,
                   block_rows: int | None = None, min_sources: int = 1, source_col: str | None = None) -> DataFrame:
    """Fires of windowed thresholds: ``keys + tgroup, timestamp_ns, seq, hit_count``.

    ``hits`` carries ``tgroup``, a key of ``groups`` that is constant per key.
    """
    keys, ids, block_rows = list(keys), _ids(hits), int(block_rows or BLOCK_ROWS)
    # beyond ``required`` the samples only matter to a count of sources
    held = {g: (int(th.required), int(th.samples) if min_sources > 1 else int(th.required), int(th.window_ns)) for g, th in groups.items()}
    reach = max(n for _, n, _ in held.values())

    def by_group(i, kind):
        return reduce(lambda e, g: e.when(F.col("tgroup") == g, F.lit(held[g][i])), held, F.when(F.lit(False), 0)).cast(kind)

    rows = hits.select(*keys, "tgroup", "timestamp_ns", *ids, *([source_col] if source_col else [])) \
        .withColumn("kh", F.xxhash64(*keys, "tgroup"))
    rows = positioned(rows, ["kh", "timestamp_ns", *ids])
    slim = rows.select("g", "kh", *keys, "timestamp_ns", F.col("timestamp_ns").alias("t"), by_group(0, "long").alias("k"),
                       by_group(1, "long").alias("n"), F.lit(int(min_sources)).cast("long").alias("m"), by_group(2, "long").alias("w"),
                       (F.xxhash64(source_col) if source_col else F.lit(0).cast("long")).alias("src"))
    low = F.col("t") - F.col("w")
    if resets is not None:
        slim = slim.join(_last_resets(slim, resets, keys), ["kh", "t"], "left")
        low = F.greatest(low, "reset")
    columns = ["block", "g", "kh", "t", "k", "n", "m", "low", "src"]
    blocks = slim.withColumn("low", low).withColumn(
        "block", F.explode(F.expr(f"sequence(g div {block_rows}, (g + {reach}) div {block_rows})"))).select(*columns)
    # a block of rows that only reach into it has none of its own
    kept = store(blocks)

    def own_rows(pdf):
        return bool((pdf["g"] // block_rows == pdf["block"]).any())

    def tabulate(key, pdf):
        if not own_rows(pdf):
            return pd.DataFrame({"node": pd.Series([], dtype="int64"), "table": pd.Series([], dtype="object")})
        return pd.DataFrame({"node": [key[0]], "table": [np.array(_Block(pdf, block_rows, reach).table(), dtype=np.int32).tobytes()]})

    states = _entry_states(store(kept.groupBy("block").applyInPandas(tabulate, "node long, table binary")))

    def walk(key, pdf):
        where, counts = _Block(pdf, block_rows, reach).fires(int(pdf["state"].iloc[0])) if own_rows(pdf) else ([], [])
        return pd.DataFrame({"g": pd.Series(where, dtype="int64"), "hit_count": pd.Series(counts, dtype="int32")})

    fired = kept.join(states.withColumnRenamed("node", "block"), "block").groupBy("block").applyInPandas(walk, "g long, hit_count int")
    return rows.join(fired, "g").select(*keys, "tgroup", "timestamp_ns", *ids, "hit_count")


def grouped_threshold_fires(hits: DataFrame, groups: dict, keys=("pattern_key", "level"),
                            resets: DataFrame | None = None, block_rows: int | None = None) -> DataFrame:
    """Fired hits for several thresholds at once: ``groups`` maps the value of
    the ``tgroup`` column to its :class:`Threshold`.  Windowed groups share
    one positioning pass; immediate groups are a plain dedup aggregate."""
    keys = list(keys)
    immediate = [g for g, th in groups.items() if is_immediate(th)]
    windowed = {g: th for g, th in groups.items() if g not in immediate and th.samples >= th.required}
    columns = [*keys, "tgroup", "timestamp_ns", *_ids(hits), "hit_count"]
    parts = []
    if immediate:
        parts.append(immediate_fires(hits.filter(F.col("tgroup").isin(immediate)), keys + ["tgroup"]).select(*columns))
    if windowed:
        parts.append(windowed_fires(hits.filter(F.col("tgroup").isin(list(windowed))), windowed, keys, resets, block_rows).select(*columns))
    if not parts:
        return immediate_fires(hits, keys + ["tgroup"]).select(*columns).limit(0)
    return reduce(DataFrame.unionByName, parts)


def threshold_fires(hits: DataFrame, threshold: Threshold, keys=("pattern_key", "level"),
                    resets: DataFrame | None = None, block_rows: int | None = None) -> DataFrame:
    """Fired hits ``keys + (timestamp_ns, seq, hit_count)`` for one threshold.

    ``hits`` needs ``keys``, ``timestamp_ns`` and the order key ``seq`` (and
    ``rid`` where that isn't unique); hits already flagged must be removed
    before (see ``alerts.dedup``).
    """
    return grouped_threshold_fires(hits.withColumn("tgroup", F.lit(0)), {0: threshold}, keys, resets, block_rows).drop("tgroup")


def window_hit_count(hits: DataFrame, window_seconds: int, keys=("pattern_key",)) -> DataFrame:
    """Hits of the same key in ``[t - W, t]`` (no reset), for every hit.

    Hits are counted by (key, t); each such row also sends a probe to t - W.
    A running count over all of them in order, by range partitions, gives at
    the row and at its probe how many hits lie up to there.
    """
    keys, w_ns = list(keys), int(window_seconds) * NS_PER_SECOND
    at = hits.groupBy(*keys, "timestamp_ns").agg(F.count("*").alias("n"))
    probe = F.struct((F.col("timestamp_ns") - w_ns).alias("x"), F.lit(0).alias("hit"), F.lit(0).cast("long").alias("n"))
    own = F.struct(F.col("timestamp_ns").alias("x"), F.lit(1).alias("hit"), F.col("n").alias("n"))
    rows = at.select(*keys, "timestamp_ns", F.explode(F.array(probe, own)).alias("p")).select(*keys, "timestamp_ns", "p.*")
    order = [*keys, "x", "hit", "timestamp_ns"]
    schema = rows.withColumn("upto", F.lit(0).cast("long")).withColumn("_at", F.lit(0).cast("long")).schema

    def running(batches):
        total = 0
        for pdf in batches:
            upto = total + pdf["n"].cumsum()
            total = int(upto.iloc[-1]) if len(upto) else total
            yield pdf.assign(upto=upto)

    placed = store(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
                   .select(*keys, "timestamp_ns", "x", "hit", "n", "_at")
                   .mapInPandas(running, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != "upto") + ", upto long"))
    before = _part_offsets(placed, "_at", F.sum("n"))
    upto = F.when(F.col("hit") == 1, 1).otherwise(-1) * (F.col("upto") + F.col("_before"))
    counted = placed.join(before, F.shiftright("_at", 33) == F.col("_part")).groupBy(*keys, "timestamp_ns").agg(F.sum(upto).alias("hits_in_window"))
    return hits.select(*keys, "timestamp_ns", "seq").join(counted, [*keys, "timestamp_ns"]).select(
        *keys, "timestamp_ns", "seq", "hits_in_window")
