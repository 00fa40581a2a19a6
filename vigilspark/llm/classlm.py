"""Perplexity under a class-based bigram model (Brown classes by exchange).

P(w_i | w_i-1) = P(class_i | class_i-1) * P(w_i | class_i).

Every training word has a class.  The ``FIRST_WORDS`` commonest words, the end
token, and 32 word shapes standing for all other words are put into classes by
exchange clustering on the driver; the other words start in the class of
their shape.  Then sweeps over all words follow, in Spark: a half of the words
(by a hash) moves to the class that raises the bigram likelihood most, until
two sweeps in a row raise it by less than ``RISE`` per token.  Words emit by their corpus
count with absolute discounting; the discounted mass belongs to words that
training never saw, by shape.

The ``LOOKUP_WORDS`` commonest words (or fewer, where counts tie) have numbers.
Their keys, counts and classes are broadcast, a bound that doesn't depend on
the corpus; a rarer word is told by its key, and its class and count are joined.
Bigrams are stored once, as packed buckets of words with their neighbours; a
sweep scans these and shuffles only what a word has in several places or
beside rarer words.

A word is told by 58 bits of its XXH64, with its shape in 5 more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilspark.llm.tokens import chunks
from vigilspark.session import discard, store

CLASSES = 64
FIRST_WORDS = 1_000
LOOKUP_WORDS = 1 << 22
SWEEPS = 6
RISE = 1e-3
DISCOUNT = 0.5
SHAPES = 32
MEMORY_WORDS = 300_000
FLUSH_AT = 2_000_000
#: Words of so many tokens have their neighbours dealt over all buckets.
HOT_TOKENS = 500_000
#: Pairs of a bucket of neighbours, about, and how many buckets there are at least.
BUCKET_ROWS = 2_000_000
LEAST_BUCKETS = 32
WORDS_AT_ONCE = 20_000
#: Counts of neighbours up to here go through one table each in a sweep.
SMALL = 8

#: A key that no word has: the end of a text, which is also what stands before its first token.
END = np.int64(-1)


class _Keys(dict):
    """Word -> key; remembers up to MEMORY_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY_WORDS:
            self.clear()
        key = self[word] = (xxhash.xxh64_intdigest(word) >> 6 << 5) | shape_of(word)
        return key


def shape_of(word: bytes) -> int:
    """0 to 31: length in four steps, ASCII or not, and how the word ends (letter, digit, full stop or comma, other)."""
    size = (len(word) > 3) + (len(word) > 6) + (len(word) > 10)
    last = word[-1:]
    end = 0 if last.isalpha() or last[0] > 127 else 1 if last.isdigit() else 2 if last in b".," else 3
    return size << 3 | (not word.isascii()) << 2 | end


def keys_of(texts: list, memory: dict) -> tuple[np.ndarray, np.ndarray]:
    """(keys, edges): all tokens of the texts, each text closed by END; text i is keys[edges[i]:edges[i + 1]]."""
    parts, sizes = [], []
    for t in texts:
        words = t.encode("utf-8").lower().split() if t else []
        own = np.empty(len(words) + 1, dtype=np.int64)
        own[:-1] = np.fromiter(map(memory.__getitem__, words), dtype=np.int64, count=len(words))
        own[-1] = END
        parts.append(own)
        sizes.append(len(own))
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


# -------------------------------------------------------------------- counting

def word_counts(texts: DataFrame) -> DataFrame:
    """(key, n) of every token of ``texts`` (column text)."""
    def run(batches):
        memory, parts, size = _Keys(), [], 0
        for batch in batches:
            own = batch["text"].tolist()
            for x, y in chunks(own):
                parts.append(keys_of(own[x:y], memory)[0])
                size += len(parts[-1])
                if size > FLUSH_AT:
                    yield from _frames(*np.unique(np.concatenate(parts), return_counts=True), names=("key", "n"))
                    parts, size = [], 0
        if parts:
            yield from _frames(*np.unique(np.concatenate(parts), return_counts=True), names=("key", "n"))

    return texts.select("text").mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _frames(*columns, names):
    for x in range(0, len(columns[0]), 100_000):
        yield pd.DataFrame({c: v[x:x + 100_000] for c, v in zip(names, columns)})


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, n) of the distinct pairs."""
    words, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    code, n = np.unique(at[:len(a)] * len(words) + at[len(a):], return_counts=True)
    return words[code // max(len(words), 1)], words[code % max(len(words), 1)], n


@dataclass
class Lookup:
    """Sorted keys of the numbered words with their numbers, from 0 by falling count; END always has one."""

    keys: np.ndarray
    number: np.ndarray
    count: np.ndarray   # by number
    shape: np.ndarray   # by number
    byte: np.ndarray    # by number
    least: int          # all words of so many tokens are here
    whole: bool         # there are no other words

    def __len__(self):
        return len(self.keys)

    @property
    def hot(self) -> int:
        """Words of HOT_TOKENS and more: those of numbers below this."""
        return int(np.searchsorted(-self.count, -HOT_TOKENS, side="right"))

    @property
    def end(self) -> int:
        return int(self.number[np.searchsorted(self.keys, END)])

    def codes(self, keys: np.ndarray) -> np.ndarray:
        """Number of a numbered word, else the key's complement, below 0."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.number[at], ~keys)


def _columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a frame of bounded size, as Arrow brings them."""
    table = df.select(*names).toArrow()
    return [table.column(n).to_numpy() for n in names]


def _lookup(counts: DataFrame) -> Lookup:
    # distinct counts are few: they add up to the number of tokens at most
    sizes = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect()
    least, held = 1 << 62, 0
    for r in sizes:
        if held + r.words > LOOKUP_WORDS:
            break
        least, held = r.n, held + r.words
    keys, n = _columns(counts.where(F.col("n") >= least), "key", "n")  # at most LOOKUP_WORDS rows
    if not (keys == END).any():
        held_end = counts.where(F.col("key") == int(END)).first()
        keys, n = np.append(keys, END), np.append(n, held_end.n if held_end else 0)
    order = np.lexsort((keys, -n))
    by_key = np.argsort(keys[order])
    return Lookup(keys[order][by_key], by_key.astype(np.int32), n[order], (keys[order] & (SHAPES - 1)).astype(np.uint8), _byte(keys[order]), least,
                  held == sum(r.words for r in sizes))


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


def _told(codes: np.ndarray) -> tuple[bytes, bytes]:
    """Codes packed as numbers, -1 for a word without one, and the codes of those in turn."""
    return _packed(np.maximum(codes, -1).astype(np.int32)), _packed(codes[codes < 0])


def _codes_of(numbers: bytes, others: bytes) -> np.ndarray:
    codes = _unpacked(numbers, np.int32).astype(np.int64)
    codes[codes < 0] = _unpacked(others, np.int64)
    return codes


#: A bucket: its words in order of code with their ``_byte``, whether all that a word has is here and numbered, and how often it
#: follows itself; how many neighbours each has before it and behind it; these neighbours and their counts; and the unnumbered ones.
NEAR = T.StructType([T.StructField(n, T.BinaryType()) for n in (
    "words", "half", "whole", "own", "n_before", "n_after", "o_before", "o_after", "t_before", "t_after", "far_at", "far_o", "far_after", "far_t")])
KINDS = {"words": np.int64, "half": np.uint8, "whole": np.bool_, "own": np.int64, "n_before": np.int32, "n_after": np.int32,
         "o_before": np.int32, "o_after": np.int32, "t_before": np.int64, "t_after": np.int64,
         "far_at": np.int32, "far_o": np.int64, "far_after": np.bool_, "far_t": np.int64}


def _buckets(near_batches, *names: str):
    """The named columns of each bucket, unpacked."""
    for batch in near_batches:
        columns = [batch.column(n) for n in names]
        for i in range(batch.num_rows):
            yield [_unpacked(c[i].as_py(), KINDS[n]) for n, c in zip(names, columns)]


def neighbours(texts: DataFrame, lookup, tokens: int) -> DataFrame:
    """Buckets of words with their neighbours, how often each stands before and behind them (``NEAR``); END stands before a text's first word and after its last.

    Words are told by their codes.  A word lies in one bucket with all its
    neighbours, but for words of HOT_TOKENS and more, which are dealt out by
    the neighbour.  Tasks leave the pairs that they met in one packed row for a
    bucket, so what is shuffled and stored is bytes, not a row for each pair.
    """
    buckets = max(LEAST_BUCKETS, 2 * tokens // BUCKET_ROWS + 1)

    def run(batches):
        look, memory, parts, size = lookup.value, _Keys(), [], 0

        def rows():
            keys, before = (np.concatenate(x) for x in zip(*parts))
            words, at = np.unique(keys, return_inverse=True)  # END is one of them
            prev = np.empty_like(at)
            prev[1:], prev[before] = at[:-1], np.searchsorted(words, END)
            pair, n = np.unique(prev * len(words) + at, return_counts=True)
            codes = look.codes(words)
            a, b = codes[pair // len(words)], codes[pair % len(words)]
            w, o = np.append(a, b), np.append(b, a)
            spread = _mixed(w) + np.where((w >= 0) & (w < look.hot), _mixed(o), 0)
            bucket = (spread % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            after, n = np.arange(len(w)) < len(a), np.append(n, n)
            made = []
            for i in np.flatnonzero(np.diff(edges)).tolist():
                mine = order[edges[i]:edges[i + 1]]
                made.append((i, *_told(w[mine]), *_told(o[mine]), _packed(after[mine]), _packed(n[mine])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), [pa.int32()] + [pa.binary()] * 6)],
                                              names=["bucket", "w", "w_far", "o", "o_far", "after", "n"])

        for batch in batches:
            own = batch.column("text").to_pylist()
            for x, y in chunks(own):
                keys, edges = keys_of(own[x:y], memory)
                parts.append((keys, size + edges[:-1]))
                size += len(keys)
                if size > FLUSH_AT:
                    yield rows()
                    parts, size = [], 0
        if parts:
            yield rows()

    def merge(key, table):
        look, columns = lookup.value, {c: table.column(c).to_pylist() for c in table.column_names}
        w, o = (np.concatenate([_codes_of(*x) for x in zip(columns[c], columns[f"{c}_far"])]) for c in ("w", "o"))
        after, n = (np.concatenate([_unpacked(x, kind) for x in columns[c]]) for c, kind in (("after", np.bool_), ("n", np.int64)))
        # unnumbered words are numbered behind the others, within the bucket
        far = np.unique(np.append(w[w < 0], o[o < 0]))
        least = len(look)
        for codes in (w, o):
            codes[codes < 0] = least + np.searchsorted(far, codes[codes < 0])
        code = after.astype(np.int64) << 62 | w << 31 | o
        order = np.argsort(code)
        code, n = code[order], n[order]
        start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        code, n = code[start], np.add.reduceat(n, start)
        after, w, o = (code >> 62).astype(bool), code >> 31 & (1 << 31) - 1, code & (1 << 31) - 1
        words, at = np.unique(w, return_inverse=True)
        own = np.bincount(at, weights=np.where(after & (o == w), n, 0), minlength=len(words)).astype(np.int64)
        numbered, beyond = words < least, o >= least
        codes = words.copy()
        codes[~numbered] = far[words[~numbered] - least]
        half = np.where(numbered, look.byte[np.minimum(words, least - 1)], _byte(~codes))
        whole = numbered & (words >= look.hot) & (np.bincount(at, weights=beyond, minlength=len(words)) == 0)
        out = {"words": codes, "half": half, "whole": whole, "own": own}
        for side, here in (("before", ~after & ~beyond), ("after", after & ~beyond)):
            out |= {f"n_{side}": np.bincount(at[here], minlength=len(words)), f"o_{side}": o[here], f"t_{side}": n[here]}
        out |= {"far_at": at[beyond], "far_o": far[o[beyond] - least], "far_after": after[beyond], "far_t": n[beyond]}
        return pa.table({c: pa.array([_packed(out[c].astype(KINDS[c]))], pa.binary()) for c in KINDS})

    made = texts.select("text").mapInArrow(run, "bucket int, w binary, w_far binary, o binary, o_far binary, after binary, n binary")
    return made.groupBy("bucket").applyInArrow(merge, NEAR)


# ------------------------------------------------------------------ clustering

def _xlogx(x):
    return x * np.log(np.maximum(x, 1))


def _exchange(left: np.ndarray, right: np.ndarray, own: np.ndarray, cls: np.ndarray, order: np.ndarray) -> int:
    """Move every item to the class that raises the bigram likelihood most; changes ``cls``, returns the moves.

    left[w, c]: times an item of class c stands before w; right[w, c]: after w.
    own[w]: times w follows itself.  Class counts follow every move; the rows
    of left and right are those of the start of the sweep.
    """
    classes = left.shape[1]
    onehot = np.eye(classes)[cls]
    table = onehot.T @ right
    total = np.maximum(table.sum(axis=1), table.sum(axis=0))
    moves = 0
    for w in order.tolist():
        c, lw, rw, s = int(cls[w]), left[w], right[w], own[w]
        n = max(lw.sum(), rw.sum())
        # without w: its class loses w's neighbours, and w beside itself
        table[c] -= rw
        table[:, c] -= lw
        table[c, c] += s
        np.maximum(table, 0, out=table)
        total[c] = max(total[c] - n, 0)
        l_out, r_out = lw.copy(), rw.copy()
        l_out[c], r_out[c] = max(l_out[c] - s, 0), max(r_out[c] - s, 0)
        # gain of joining class k: its row gains r_out, its column l_out, its own cell both and s
        row = (_xlogx(table + r_out) - _xlogx(table)).sum(axis=1)
        col = (_xlogx(table + l_out[:, None]) - _xlogx(table)).sum(axis=0)
        cell = np.diag(table)
        row -= _xlogx(cell + r_out) - _xlogx(cell)
        col -= _xlogx(cell + l_out) - _xlogx(cell)
        gain = row + col + _xlogx(cell + r_out + l_out + s) - _xlogx(cell) - 2 * (_xlogx(total + n) - _xlogx(total))
        k = int(gain.argmax())
        if gain[k] <= gain[c] + 1e-9:
            k = c
        table[k] += r_out
        table[:, k] += l_out
        table[k, k] += s
        total[k] += n
        moves += k != c
        cls[w] = k
    return moves


def cluster(pair: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of every item from the counts of one item before another: frequent items start alone, the rest in turn."""
    items = len(pair)
    n = np.maximum(pair.sum(axis=1), pair.sum(axis=0))
    order = np.lexsort((np.arange(items), -n))
    cls = np.empty(items, dtype=np.int64)
    cls[order] = np.arange(items) % classes
    for _ in range(sweeps):
        one = np.eye(classes)[cls]
        if not _exchange(pair.T @ one, pair @ one, np.diag(pair).copy(), cls, order):
            break
    return cls


def _first_classes(near: DataFrame, lookup: Lookup, shared, classes: int, sweeps: int) -> np.ndarray:
    """Classes of the FIRST_WORDS commonest words, of END and of the shapes."""
    first, end = min(FIRST_WORDS, len(lookup)), lookup.end
    items = first + 1 + SHAPES

    def item(codes, look):
        known = codes >= 0
        shape = np.where(known, look.shape[np.maximum(codes, 0)], ~codes & (SHAPES - 1)).astype(np.int64)
        return np.where(codes == end, first, np.where(known & (codes < first), codes, first + 1 + shape))

    def run(batches):
        table = np.zeros(items * items)
        for words, n_after, o, t, far_at, far_o, far_after, far_t in _buckets(batches, "words", "n_after", "o_after", "t_after", "far_at", "far_o", "far_after", "far_t"):
            own = item(words, shared.value)
            for a, b, n in ((np.repeat(own, n_after), o.astype(np.int64), t), (own[far_at[far_after]], far_o[far_after], far_t[far_after])):
                table += np.bincount(a * items + item(b, shared.value), weights=n, minlength=items * items)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(table[at].astype(np.int64))], names=["at", "n"])

    pair = np.zeros(items * items)
    # at most (FIRST_WORDS + 33) squared rows
    at, n = _columns(near.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")), "at", "n")
    pair[at] = n
    return cluster(pair.reshape(items, items), classes, sweeps)


def _best(left: np.ndarray, right: np.ndarray, own: np.ndarray, cls: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class that raises the bigram likelihood most for each word alone, all others staying; arguments as in ``_exchange``."""
    pick = np.arange(len(cls))
    cell = np.repeat(np.diag(table)[None, :], len(cls), axis=0)
    cell[pick, cls] += own - left[pick, cls] - right[pick, cls]
    cell = np.maximum(cell, 0)
    gain, outs = np.zeros_like(left), []
    for mine, other, t in ((right, left, table), (left, right, table.T)):
        out = mine.copy()
        out[pick, cls] -= own
        w, j = np.nonzero(out > 0)
        base, n = t.T[j], out[w, j][:, None]  # base[e, k]: class k beside class j, without the word
        at = np.flatnonzero(j == cls[w])
        base[at] -= other[w[at]]
        base[np.arange(len(w)), cls[w]] -= mine[w, j]
        base[at, cls[w[at]]] += own[w[at]]
        base = np.maximum(base, 0)
        np.add.at(gain, w, _xlogx(base + n) - _xlogx(base))
        outs.append(out)
    r, l = outs
    gain += _xlogx(cell + r + l + own[:, None]) - _xlogx(cell + r) - _xlogx(cell + l) + _xlogx(cell)
    for sums, n in ((table.sum(axis=1), right.sum(axis=1)), (table.sum(axis=0), left.sum(axis=1))):
        total = np.repeat(sums[None, :], len(cls), axis=0)
        total[pick, cls] = np.maximum(total[pick, cls] - n, 0)
        gain -= _xlogx(total + n[:, None]) - _xlogx(total)
    best = gain.argmax(axis=1)
    return np.where(gain[pick, best] > gain[pick, cls] + 1e-9, best, cls)


def _steps_of(table: np.ndarray) -> list[np.ndarray]:
    """f(table[k, j] + n) - f(table[k, j]) for n up to SMALL, a row for each n and j; of the table and of its transpose."""
    return [np.concatenate([(_xlogx(t + n) - _xlogx(t)).T for n in range(1, SMALL + 1)]) for t in (table, table.T)]


def _best_of_many(left: np.ndarray, right: np.ndarray, own: np.ndarray, cls: np.ndarray, table: np.ndarray, steps: list | None = None) -> np.ndarray:
    """What ``_best`` gives, for many words of mostly small counts.

    A neighbour's class j with count n adds f(table[k, j] + n) - f(table[k, j])
    to the gain of class k, f(x) = x log x, where neither j nor k is the word's
    own class; for small n that is a row of a table (``steps``), so rows are
    gathered and added up.  Own classes are worked out apart.
    """
    pick, classes = np.arange(len(cls)), table.shape[0]
    gain, outs = np.zeros_like(left), []
    for mine, other, t, tables in zip((right, left), (left, right), (table, table.T), steps or _steps_of(table)):
        out = mine.copy()
        out[pick, cls] -= own
        outs.append(out)
        rest = out.copy()
        rest[pick, cls] = 0
        w, j = np.nonzero((rest > 0) & (rest <= SMALL))
        if len(w):
            start = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            gain[w[start]] += np.add.reduceat(tables[(rest[w, j].astype(np.int64) - 1) * classes + j], start)
        w, j = np.nonzero(rest > SMALL)
        if len(w):
            n = rest[w, j][:, None]
            np.add.at(gain, w, _xlogx(t.T[j] + n) - _xlogx(t.T[j]))
        # joining its own class k = c anew, beside classes other than c
        w, j = np.nonzero(rest > 0)
        n, full = rest[w, j], t[cls[w], j]
        base = np.maximum(full - mine[w, j], 0)
        fresh = (_xlogx(base + n) - _xlogx(base)) - (_xlogx(full + n) - _xlogx(full))
        gain[pick, cls] += np.bincount(w, weights=fresh, minlength=len(cls))
        # beside its own class, j = c, which the word has left
        n = out[pick, cls]
        at = np.flatnonzero(n > 0)
        base = t[:, cls[at]].T - other[at]
        base[np.arange(len(at)), cls[at]] -= mine[at, cls[at]] - own[at]
        base = np.maximum(base, 0)
        gain[at] += _xlogx(base + n[at, None]) - _xlogx(base)
    # the cell of k beside itself, where the word has neighbours of k on both sides or stands beside itself
    r, l = outs
    w, k = np.nonzero(((r > 0) & (l > 0)) | (own > 0)[:, None])
    cell = np.maximum(np.diag(table)[k] + (k == cls[w]) * (own[w] - left[w, cls[w]] - right[w, cls[w]]), 0)
    r, l, o = r[w, k], l[w, k], own[w]
    np.add.at(gain, (w, k), _xlogx(cell + r + l + o) - _xlogx(cell + r) - _xlogx(cell + l) + _xlogx(cell))
    for sums, n in ((table.sum(axis=1), right.sum(axis=1)), (table.sum(axis=0), left.sum(axis=1))):
        value, which = np.unique(n, return_inverse=True)
        gain -= (_xlogx(sums[None, :] + value[:, None]) - _xlogx(sums)[None, :])[which]
        total = sums[cls]
        without = np.maximum(total - n, 0)
        gain[pick, cls] += (_xlogx(total + n) - _xlogx(total)) - (_xlogx(without + n) - _xlogx(without))
    best = gain.argmax(axis=1)
    return np.where(gain[pick, best] > gain[pick, cls] + 1e-9, best, cls)


def _byte(keys: np.ndarray) -> np.ndarray:
    """Eight random bits of each word; one of them says whether it moves in a sweep."""
    return (_mixed(keys) >> np.uint64(56)).astype(np.uint8)


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)


def _far(near: DataFrame) -> DataFrame:
    """(w, half, after, o, n): how often the unnumbered word o stands behind (``after``) or before word w."""
    def run(batches):
        for words, half, at, o, after, n in _buckets(batches, "words", "half", "far_at", "far_o", "far_after", "far_t"):
            for x in range(0, len(at), 100_000):
                y = slice(x, x + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(words[at[y]]), pa.array(half[at[y]].astype(np.int16)), pa.array(after[y]), pa.array(o[y]), pa.array(n[y])],
                                                 names=["w", "half", "after", "o", "n"])

    return near.mapInArrow(run, "w long, half short, after boolean, o long, n long")


def _class_table(near: DataFrame, classes: int, cls: np.ndarray, rare: DataFrame | None, far: DataFrame | None) -> np.ndarray:
    """Tokens of each class behind each class; ``far`` has the class ``co`` of each o."""
    spark = near.sparkSession
    shared = spark.sparkContext.broadcast(cls)
    size = classes * classes

    def cells_of(table):
        return pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(table.astype(np.int64))], names=["at", "n"])

    def run(batches):
        table = np.zeros(size)
        for words, n_after, o, n in _buckets(batches, "words", "n_after", "o_after", "t_after"):
            # an unnumbered word is met once more, as the neighbour of a numbered one
            of = np.where(words >= 0, shared.value[np.maximum(words, 0)].astype(np.int64) * classes, -1)
            at = np.repeat(of, n_after)
            here = at >= 0
            table += np.bincount(at[here] + shared.value[o[here]], weights=n[here], minlength=size)
        yield cells_of(table)

    def run_far(batches):
        table = np.zeros(size)
        for batch in batches:
            w, co, n, after, cw = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("w", "co", "n", "after", "cw"))
            cw, co = np.where(w >= 0, shared.value[np.maximum(w, 0)], cw).astype(np.int64), co.astype(np.int64)
            table += np.bincount(np.where(after, cw * classes + co, co * classes + cw), weights=n, minlength=size)
        yield cells_of(table)

    cells = near.select("words", "n_after", "o_after", "t_after").mapInArrow(run, "at int, n long")
    if far is not None:
        columns = ["w", "co", "n", "after", "cw"]
        beside = far.where("w >= 0").withColumn("cw", F.lit(0)).select(*columns).unionByName(
            far.where("w < 0 and after").join(rare.select(F.col("code").alias("w"), F.col("c").alias("cw")), "w").select(*columns))
        cells = cells.unionByName(beside.mapInArrow(run_far, "at int, n long"))
    table = np.zeros(size)
    for r in cells.groupBy("at").agg(F.sum("n").alias("n")).collect():
        table[r["at"]] = r["n"]
    return table.reshape(classes, classes)


def _sweep(near: DataFrame, classes: int, cls: np.ndarray, rare: DataFrame | None, far: DataFrame | None, table: np.ndarray, sweep: int) -> DataFrame:
    """(code, c): new classes of the words that move to another one."""
    spark = near.sparkSession
    shared = spark.sparkContext.broadcast((cls, table))

    def decide(code, hist, own, now, steps):
        """(code, c) of the words that move."""
        # words met once between the same classes go the same way
        same = np.arange(len(code))
        single = np.flatnonzero((hist[:, :classes].sum(axis=1) == 1) & (hist[:, classes:].sum(axis=1) == 1) & (own == 0))
        if len(single):
            sides = hist[single, :classes].argmax(axis=1) * classes + hist[single, classes:].argmax(axis=1)
            _, first, at = np.unique(sides * classes + now[single], return_index=True, return_inverse=True)
            same[single] = single[first][at]
        todo, at = np.unique(same, return_inverse=True)
        new = np.empty(len(todo), dtype=np.int64)
        for x in range(0, len(todo), 2_000):
            y = todo[x:x + 2_000]
            new[x:x + 2_000] = _best_of_many(hist[y, :classes], hist[y, classes:], own[y].astype(np.float64), now[y], shared.value[1], steps)
        new = new[at]
        return code[new != now], new[new != now]

    def run(batches):
        """Words with all they have here: their new class; the others: their counts by class before and behind them, to be added up."""
        cls, steps = shared.value[0], _steps_of(shared.value[1])
        for words, half, whole, own, *sides in _buckets(batches, "words", "half", "whole", "own", "n_before", "o_before", "t_before", "n_after", "o_after", "t_after"):
            ends = [np.concatenate([[0], np.cumsum(n, dtype=np.int64)]) for n in sides[::3]]
            for x in range(0, len(words), WORDS_AT_ONCE):
                y = min(x + WORDS_AT_ONCE, len(words))
                moving = np.flatnonzero(half[x:y] >> sweep % 8 & 1)
                row = np.full(y - x, -1)
                row[moving] = np.arange(len(moving))
                hist = np.zeros(len(moving) * 2 * classes)
                for k, (n, o, t) in enumerate((sides[:3], sides[3:])):
                    own_rows = slice(ends[k][x], ends[k][y])
                    at = np.repeat(row, n[x:y])
                    here = at >= 0
                    hist += np.bincount(at[here] * 2 * classes + k * classes + cls[o[own_rows][here]], weights=t[own_rows][here], minlength=len(hist))
                hist, code, self_n, all_here = hist.reshape(-1, 2 * classes), words[x:y][moving], own[x:y][moving], whole[x:y][moving]
                moved, to = decide(code[all_here], hist[all_here], self_n[all_here], cls[code[all_here]].astype(np.int64), steps)
                yield pa.RecordBatch.from_arrays([pa.array(moved), pa.array(to, pa.int32()), pa.nulls(len(moved), pa.list_(pa.int32())), pa.nulls(len(moved), pa.list_(pa.int64()))],
                                                 names=["code", "c", "at", "n"])
                hist = np.concatenate([hist[~all_here], self_n[~all_here, None]], axis=1)
                i, at = np.nonzero(hist)
                lengths = np.concatenate([[0], np.cumsum(np.bincount(i, minlength=len(hist)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(code[~all_here]), pa.nulls(len(hist), pa.int32()), pa.ListArray.from_arrays(lengths, pa.array(at, pa.int32())),
                                                  pa.ListArray.from_arrays(lengths, pa.array(hist[i, at].astype(np.int64)))], names=["code", "c", "at", "n"])

    def settle(batches):
        steps = _steps_of(shared.value[1])
        for batch in batches:
            code, now = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("code", "c"))
            size, width = np.diff(batch.column("at").offsets.to_numpy()), 2 * classes + 1
            at, n = (batch.column(c).flatten().to_numpy() for c in ("at", "n"))
            hist = np.bincount(np.repeat(np.arange(len(code)), size) * width + at, weights=n, minlength=width * len(code)).reshape(-1, width)
            now = np.where(code >= 0, shared.value[0][np.maximum(code, 0)], now).astype(np.int64)
            moved, to = decide(code, hist[:, :-1], hist[:, -1], now, steps)
            yield pa.RecordBatch.from_arrays([pa.array(moved), pa.array(to, pa.int32())], names=["code", "c"])

    out = store(near.select("words", "half", "whole", "own", "n_before", "o_before", "t_before", "n_after", "o_after", "t_after")
                .mapInArrow(run, "code long, c int, at array<int>, n array<long>"))
    parts = out.where("at is not null").select("code", "at", "n")
    if far is not None:
        # every word that may move and has such a neighbour has a part above
        beside = far.where(F.shiftright(F.col("half").cast("int"), sweep % 8).bitwiseAND(1) == 1).groupBy(
            F.col("w").alias("code"), (F.when(F.col("after"), classes).otherwise(0) + F.col("co")).alias("at")).agg(F.sum("n").alias("n"))
        parts = parts.unionByName(beside.select("code", F.array("at").alias("at"), F.array("n").alias("n")))
    parts = parts.groupBy("code").agg(F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("n")).alias("n"))
    if rare is not None:
        parts = parts.join(rare.select("code", "c"), "code", "left").select("code", F.coalesce("c", F.lit(0)).alias("c"), "at", "n")
    else:
        parts = parts.select("code", F.lit(0).alias("c"), "at", "n")
    return out.where("at is null").select("code", "c").unionByName(parts.mapInArrow(settle, "code long, c int"))


def refine(near: DataFrame, cls: np.ndarray, rare: DataFrame | None, classes: int, tokens: int):
    """(classes of numbered words, (code, n, c) of the others, class bigrams) of the best likelihood, by sweeps until two in a row don't raise it by RISE."""
    best, sweep, idle, far = None, 0, 0, None
    beside = None if rare is None else store(_far(near))
    while True:
        if rare is not None:
            far = store(beside.join(rare.select(F.col("code").alias("o"), F.col("c").alias("co")), "o").drop("o"))
        table = _class_table(near, classes, cls, rare, far)
        value = _likelihood(table)
        idle = 0 if best is None or value >= best[0] + RISE * tokens else idle + 1
        if best is None or value > best[0]:
            best = (value, cls, rare, table)
        if idle == 2 or not tokens:
            for done in (beside, far):
                if done is not None:
                    discard(done)
            return best[1:]
        sweep += 1
        moved = store(_sweep(near, classes, cls, rare, far, table, sweep))
        code, to = _columns(moved.where("code >= 0"), "code", "c")  # at most LOOKUP_WORDS rows
        cls = cls.copy()
        cls[code] = to
        if rare is not None:
            before = rare
            to = moved.where("code < 0").select("code", F.col("c").alias("to"))
            rare = store(rare.join(to, "code", "left").select("code", "n", F.coalesce("to", "c").alias("c")))
            if before is not best[2]:
                discard(before)
            discard(far)
        discard(moved)


def _likelihood(table: np.ndarray) -> float:
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())

# ----------------------------------------------------------------------- model

@dataclass
class Model:
    lookup: Lookup
    cls: np.ndarray         # class by number
    transition: np.ndarray  # log10 P(class | class before)
    emission: np.ndarray    # log10 P(word | class) by number
    steps: np.ndarray       # transition with the shapes as classes of unseen words behind the others
    tokens: int             # N
    types: int              # V
    size: np.ndarray        # tokens of each class
    discount: np.ndarray    # taken off each word's count in its class
    share: np.ndarray       # P(unseen word of the shape | class)
    shape_types: np.ndarray

    def unseen(self) -> np.ndarray:
        """log10 P(word | unseen and of its shape) of one word."""
        return -np.log10(self.shape_types + 1)

    def emitted(self, count: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 P(word | class) of words by their counts."""
        return np.log10((count - self.discount[cls]) / self.size[cls])

    def base(self, count):
        return np.log10((count + 1) / (self.tokens + self.types + 1))


def fit(texts: DataFrame, classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[Model, DataFrame | None]:
    """(model, (code, n, c) of words without a number) from the column text of all rows; ``sweeps`` bounds the first clustering only."""
    spark = texts.sparkSession
    counts = store(word_counts(texts))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, types = int(sums[0]), int(sums[1])
    lookup = _lookup(counts)
    shared = spark.sparkContext.broadcast(lookup)
    near = store(neighbours(texts, shared, tokens))
    start = _first_classes(near, lookup, shared, classes, sweeps)
    first, end = len(start) - 1 - SHAPES, lookup.end
    cls = start[first + 1 + lookup.shape.astype(np.int64)]
    cls[:first] = start[:first]
    cls[end] = start[first]
    of_shape = F.get(F.array(*[F.lit(int(c)) for c in start[first + 1:]]), F.col("key").bitwiseAND(SHAPES - 1).cast("int"))
    rare = None
    if not lookup.whole:
        rare = counts.where((F.col("n") < lookup.least) & (F.col("key") != int(END)))
        rare = store(rare.select(F.bitwise_not("key").alias("code"), "n", of_shape.alias("c")))
    cls, rare, table = refine(near, cls.astype(np.uint8), rare, classes, tokens)
    discard(near)
    discard(counts)

    cls = cls.astype(np.int64)
    size, types_of = np.zeros(classes), np.zeros(classes)
    once, all_of = np.zeros((SHAPES, classes)), np.zeros((SHAPES, classes))
    words = np.flatnonzero((np.arange(len(lookup)) != end) & (lookup.count > 0))
    size += np.bincount(cls[words], weights=lookup.count[words], minlength=classes)
    types_of += np.bincount(cls[words], minlength=classes)
    np.add.at(all_of, (lookup.shape[words], cls[words]), 1)
    single = words[lookup.count[words] == 1]
    np.add.at(once, (lookup.shape[single], cls[single]), 1)
    if rare is not None:
        shape = F.bitwise_not("code").bitwiseAND(SHAPES - 1).cast("int")
        for r in rare.groupBy(shape.alias("s"), "c").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once")).collect():
            size[r.c] += r.n
            types_of[r.c] += r.v
            once[r.s, r.c] += r.once
            all_of[r.s, r.c] += r.v
    size[cls[end]] += max(lookup.count[end], 1)
    types_of[cls[end]] += 1
    # unseen words are most like those seen once: their classes are likely ones, their shapes share what a class has left
    shape_types = all_of.sum(axis=1)
    like = np.where(once.any(axis=1, keepdims=True), once, all_of) + np.eye(classes)[start[first + 1:]] * 1e-3
    like /= like.sum(axis=1, keepdims=True)
    share = like * (shape_types + 1)[:, None]
    weight = share.sum(axis=0)
    discount = np.where(weight > 0, DISCOUNT, 0.0)
    left = np.where(size > 0, discount * types_of / np.maximum(size, 1), 1.0)
    share = share / np.where(weight > 0, weight, 1) * left
    members = types_of + (weight > 0)
    after, kinds = table.sum(axis=1, keepdims=True), (table > 0).sum(axis=1, keepdims=True)
    prior = (table.sum(axis=0) + members) / (table.sum() + members.sum())
    # Witten-Bell: a class followed by many kinds of classes leans on the prior
    moved = (table + np.maximum(kinds, 1) * prior) / (after + np.maximum(kinds, 1))
    with np.errstate(divide="ignore"):
        rows = np.concatenate([moved, like @ moved])
        steps = np.log10(np.concatenate([rows, rows @ share.T], axis=1))
        emission = np.log10((np.maximum(lookup.count, 1) - discount[cls]) / size[cls])
        model = Model(lookup, cls, np.log10(moved), emission, steps, tokens, types, size, discount, share, shape_types)
    return model, rare


# ------------------------------------------------------------------- operators

def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2,
          classes: int = CLASSES, sweeps: int = SWEEPS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row.

    Tokens are runs of non-white-space with A-Z lower-cased, then one end;
    null, empty and wordless texts are the end alone.  The model learns from
    rows whose crc32 of the id as text doesn't leave ``held_out`` modulo
    ``folds``; rows without an id are scored, count as not held out and
    teach nothing.  Repeated rows stay repeated and count each time.  Without
    training rows every word is unknown.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn(
        "held_out", F.coalesce(fold == held_out, F.lit(False)))
    model, rare = fit(own.where(~F.col("held_out") & F.col("doc_id").isNotNull()), classes, sweeps)
    shared = spark.sparkContext.broadcast(model)
    joined = rare is not None

    def run(batches):
        m, memory = shared.value, _Keys()
        unseen, end = m.unseen(), m.lookup.end
        for batch in batches:
            texts = batch["text"].tolist()
            for x, y in chunks(texts):
                keys, edges = keys_of(texts[x:y], memory)
                code = m.lookup.codes(keys)
                known = code >= 0
                at, shape = np.maximum(code, 0), (~code & (SHAPES - 1)).astype(np.int64)
                cls = np.where(known, m.cls[at], len(m.size) + shape)  # an unnumbered word: as if unseen
                count = np.where(known, m.lookup.count[at], 0)
                emitted = np.where(known, m.emission[at], unseen[shape])
                before = np.empty_like(cls)
                before[1:] = cls[:-1]
                before[edges[:-1]] = m.cls[end]
                behind = np.empty_like(code)
                behind[1:] = code[:-1]
                behind[edges[:-1]] = end
                step, base = m.steps[before, cls], m.base(count)
                out = {"doc_id": batch["doc_id"].iloc[x:y].to_numpy(), "held_out": batch["held_out"].iloc[x:y].to_numpy(), "n_tokens": np.diff(edges)}
                if joined:  # what hangs on an unnumbered word is left to the join
                    far = ~known | (behind < 0)
                    emitted, base, step = np.where(known, emitted, 0.0), np.where(known, base, 0.0), np.where(far, 0.0, step)
                    rest = [_pairs(behind[a:b][far[a:b]], code[a:b][far[a:b]]) for a, b in zip(edges[:-1], edges[1:])]
                    out |= {"a": [a for a, _, _ in rest], "b": [b for _, b, _ in rest], "times": [n for _, _, n in rest],
                            "ca": [np.where(a >= 0, m.cls[np.maximum(a, 0)], -1) for a, _, _ in rest],
                            "cb": [np.where(b >= 0, m.cls[np.maximum(b, 0)], -1) for _, b, _ in rest]}
                start = edges[:-1]
                yield pd.DataFrame(out | {"known": np.add.reduceat((count > 0).astype(np.int64), start), "base": np.add.reduceat(base, start),
                                          "value": np.add.reduceat(step + emitted, start)})

    kind = docs.schema[id_col].dataType.simpleString()
    far = "a array<long>, b array<long>, times array<long>, ca array<int>, cb array<int>, " if joined else ""
    local = own.mapInPandas(run, f"doc_id {kind}, held_out boolean, n_tokens long, {far}known long, base double, value double")
    if joined:
        local = _joined_scores(store(local.withColumn("row", F.monotonically_increasing_id())), model, rare)
    scored = local.select("doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
                          F.col("base").alias("base_score"), F.col("value").alias("score"))
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def _joined_scores(local: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """``local`` with what its pairs beside unnumbered words add: their classes and counts come from ``rare``."""
    classes = len(model.size)
    listed = lambda values, at: F.get(F.array(*[F.lit(float(v)) for v in values]), at)
    shape = lambda code: F.bitwise_not(code).bitwiseAND(SHAPES - 1).cast("int")
    rest = local.select("row", F.explode(F.arrays_zip("a", "b", "times", "ca", "cb")).alias("x")).select("row", "x.*")
    rest = rest.join(rare.toDF("b", "nb", "rb"), "b", "left").join(rare.select(F.col("code").alias("a"), F.col("c").alias("ra")), "a", "left")
    of = lambda code, own, found: F.when(F.col(own) >= 0, F.col(own)).otherwise(F.coalesce(F.col(found), shape(code) + classes))
    rest = rest.withColumn("from", of("a", "ca", "ra")).withColumn("to", of("b", "cb", "rb"))
    n, at = F.coalesce("nb", F.lit(0)), F.col("to")
    emitted = F.when(F.col("b") >= 0, F.lit(0.0)).when(n > 0, F.log10((n - listed(model.discount, at)) / listed(model.size, at))).otherwise(
        listed(model.unseen(), shape("b")))
    base = F.when(F.col("b") >= 0, F.lit(0.0)).otherwise(F.log10((n + 1) / F.lit(float(model.tokens + model.types + 1))))
    steps = local.sparkSession.createDataFrame(
        [(i, j, float(v)) for (i, j), v in np.ndenumerate(model.steps) if np.isfinite(v)], "from int, to int, step double")
    rest = rest.withColumn("emitted", emitted).withColumn("based", base).join(F.broadcast(steps), ["from", "to"], "left").groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.col("based")).alias("more_base"),
        F.sum(F.col("times") * (F.col("emitted") + F.col("step"))).alias("more_value"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return local.join(rest, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("known") + zero("more_known")).alias("known"),
                                                  (F.col("base") + zero("more_base")).alias("base"), (F.col("value") + zero("more_value")).alias("value"))
