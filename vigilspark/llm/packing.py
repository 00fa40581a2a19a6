"""Best-fit packing of documents into training sequences after a
Martello-Toth dominance reduction.

Packing only depends on how many pieces there are of each length, at most
``capacity`` numbers however large the corpus.  Spark tokenises, cuts and
counts; the plan is made from the counts; Spark gives every piece its place.

Reduction: for a length j, with k the longest remaining length that fits
beside it, a set is fixed for good if no alternative can be better:
  - nothing fits beside j: {j};
  - j and k fill the sequence: {j, k};
  - only one more piece can ever stand beside j: {j, k};
  - at most two more can, and k is at least as long as any two that fit
    together: {j, k};
  - at most two more can, b is the longest that fits beside j and k, and no two
    pieces longer than b fit together: {j, k, b}.
Each fixing shrinks the instance and may allow others, so the rules run until
none applies.  The remainder is packed best-fit, longest first.  All copies
of a length are handled at once.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.llm.tokens import WordEncoder, word_bpe_path
from vigilspark.session import store

CAPACITY = 4096
END_ID = 1


@dataclass
class Plan:
    """Where the n-th piece of a length goes: rows (length, first rank, count, first sequence, offset)."""

    slots: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    fixed: int = 0
    lower_bound: int = 0


def lower_bound(count: dict[int, int], capacity: int) -> int:
    """Martello-Toth L2: sequences that any packing needs."""
    lengths = sorted(count)
    n = np.array([count[x] for x in lengths], dtype=object)
    if not lengths:
        return 0
    best = -(-sum(x * c for x, c in count.items()) // capacity)
    ends = np.cumsum(n)
    mass = np.cumsum([x * c for x, c in zip(lengths, n)])
    before = lambda series, x: series[i - 1] if (i := bisect_left(lengths, x)) else 0  # noqa: E731  lengths < x
    upto = lambda series, x: series[i - 1] if (i := bisect_right(lengths, x)) else 0  # noqa: E731  lengths <= x
    for k in [0] + [x for x in lengths if 2 * x <= capacity]:
        alone = ends[-1] - upto(ends, capacity - k)
        large = upto(ends, capacity - k) - upto(ends, capacity // 2)
        large_mass = upto(mass, capacity - k) - upto(mass, capacity // 2)
        small_mass = upto(mass, capacity // 2) - before(mass, k)
        best = max(best, alone + large + max(0, -(-(small_mass - (large * capacity - large_mass)) // capacity)))
    return int(best)


class _Planner:
    def __init__(self, count: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {x: c for x, c in count.items() if c}
        self.lengths = sorted(self.left)
        self.rank = dict.fromkeys(self.left, 0)
        self.plan = Plan(lower_bound=lower_bound(self.left, capacity))

    def _take(self, length: int, n: int, sequence: int, offset: int):
        """The next ``n`` pieces of a length go to ``offset`` of sequences from ``sequence`` on, one each."""
        self.plan.slots.append((length, self.rank[length], n, sequence, offset))
        self.rank[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.lengths.pop(bisect_left(self.lengths, length))

    def _fix(self, pieces: list[int], n: int):
        first, offset = self.plan.sequences, 0
        for x in pieces:
            self._take(x, n, first, offset)
            offset += x
        self.plan.sequences += n
        self.plan.fixed += n

    def _beside(self, j: int) -> tuple[int | None, int | None]:
        """Longest length that fits beside one piece of j, and the sum of the two shortest others."""
        others = (x for x in self.lengths for _ in range(min(2 + (x == j), self.left[x]) - (x == j)))
        least = [x for x, _ in zip(others, range(2))]
        at = bisect_right(self.lengths, self.capacity - j) - 1
        if at >= 0 and self.lengths[at] == j and self.left[j] < 2:
            at -= 1
        return (self.lengths[at] if at >= 0 else None), (sum(least) if len(least) == 2 else None)

    def _others(self, gone: list[int], longer_than: int = 0):
        """Pieces left besides those gone, shortest first, each length at most three times."""
        for x in self.lengths[bisect_right(self.lengths, longer_than):]:
            yield from [x] * min(3, self.left[x] - gone.count(x))

    def _best_pair(self, j: int, room: int) -> int:
        """Largest sum of two pieces beside j that is not above ``room``; 0 if there is none."""
        best, low, high = 0, 0, bisect_right(self.lengths, room) - 1
        has = lambda x, n: self.left[x] - (x == j) >= n
        while low <= high:
            x, y = self.lengths[low], self.lengths[high]
            if x + y > room:
                high -= 1
            else:
                if has(x, 1 + (low == high)) and has(y, 1 + (low == high)):
                    best = max(best, x + y)
                low += 1
        # equal pieces meet above only where the two ends do
        return max([best, *(2 * x for x in self.lengths[:bisect_right(self.lengths, room // 2)] if has(x, 2))])

    def _with_two_more(self, j: int, k: int) -> list[int] | None:
        """What dominates every set of j with at most two more pieces, if more than two never fit and one does."""
        room = self.capacity - j
        least = [x for x, _ in zip(self._others([j]), range(3))]
        if len(least) == 3 and sum(least) <= room:
            return None
        beside = [x for x in self.lengths[:bisect_right(self.lengths, room - k)] if self.left[x] > [j, k].count(x)]
        if not beside:
            return [j, k] if k >= self._best_pair(j, room) else None
        longer = [x for x, _ in zip(self._others([j], beside[-1]), range(2))]
        return [j, k, beside[-1]] if len(longer) < 2 or sum(longer) > room else None

    def reduce(self):
        """Fix dominating sets until no rule applies."""
        changed = True
        while changed:
            changed = False
            for j in list(reversed(self.lengths)):
                while j in self.left:
                    k, two = self._beside(j)
                    if k is None:
                        self._fix([j], self.left[j] if 2 * j > self.capacity else 1)
                    elif j + k == self.capacity or two is None or j + two > self.capacity:
                        n = self.left[j] // 2 if j == k else min(self.left[j], self.left[k])
                        self._fix([j, k], n)
                    elif pieces := self._with_two_more(j, k):
                        self._fix(pieces, min(self.left[x] for x in pieces) if len(set(pieces)) == len(pieces) else 1)
                    else:
                        break
                    changed = True

    def best_fit(self):
        """Longest first, each piece to the fullest sequence that takes it."""
        free: list[tuple[int, int, int]] = []  # (room left, first sequence, how many), by room
        while self.lengths:
            x = self.lengths[-1]
            while x in self.left:
                at = bisect_left(free, (x, -1, -1))
                if at < len(free):
                    room, first, many = free.pop(at)
                else:
                    per = self.capacity // x
                    room, first, many = self.capacity, self.plan.sequences, max(1, self.left[x] // per)
                    self.plan.sequences += many
                per = room // x
                full, rest = divmod(self.left[x], per)
                full = min(full, many)
                for t in range(per if full else 0):
                    self._take(x, full, first, self.capacity - room + t * x)
                if full and room - per * x:
                    insort(free, (room - per * x, first, full))
                first, many = first + full, many - full
                if many and x in self.left:  # fewer than ``per`` pieces are left: one sequence takes them
                    for t in range(rest):
                        self._take(x, 1, first, self.capacity - room + t * x)
                    if room - rest * x:
                        insort(free, (room - rest * x, first, 1))
                    first, many = first + 1, many - 1
                if many:
                    insort(free, (room, first, many))


def plan(count: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Packing of ``count[length]`` pieces of every length into sequences of ``capacity``."""
    planner = _Planner(count, capacity)
    planner.reduce()
    planner.best_fit()
    return planner.plan


# ------------------------------------------------------------------ operators

def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): every document's ids, cut at ``capacity``.

    ``nth`` numbers the pieces of a length within a task, ``part`` the task.
    """
    def run(batches):
        encoder, part = WordEncoder(tokenizer_path), TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([end_id], dtype=np.int32)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"], encoder.encode_each(batch["text"].tolist())):
                ids = np.concatenate([ids, end]).astype("<u4")
                for piece, a in enumerate(range(0, len(ids), capacity)):
                    own = ids[a:a + capacity]
                    rows.append((doc_id, piece, a, len(own), zlib.crc32(own.tobytes()), part, met[len(own)]))
                    met[len(own)] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    A document is the ids of its whole text and ``end_id``; null and empty
    texts are the end id alone.  Only longer ones are cut, into pieces of
    ``capacity`` and a last shorter one.  Repeated rows are documents of
    their own; a null id stays null; other columns are ignored.
    """
    cut = store(pieces(docs, tokenizer_path or word_bpe_path(), id_col, text_col, capacity, end_id))
    by_part = store(cut.groupBy("length", "part").agg(F.count("*").alias("n")))
    # one number for each length, at most ``capacity`` of them
    made = plan({int(r.length): int(r.n) for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = by_part.withColumn("before", F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = cut.join(before.select("length", "part", F.coalesce("before", F.lit(0)).alias("before")), ["length", "part"]) \
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    slots = np.array(sorted(made.slots), dtype=np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def place(batches):
        table = shared.value
        key = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            rank = batch["rank"].to_numpy()
            row = table[np.searchsorted(key, batch["length"].to_numpy() << 48 | rank, side="right") - 1]
            yield batch.drop(columns="rank").assign(sequence_id=row[:, 3] + rank - row[:, 1], offset=row[:, 4])

    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInPandas(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, "
                                     "sequence_id long, offset long")
