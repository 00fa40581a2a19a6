"""Benchmark decontamination by greedy string tiling.

1. Seeds: the hashes of all runs of ``MIN_MATCH`` words of the benchmark.  A
   Bloom filter of fixed size built from them lets each document keep only
   the seeds it may share; an exact join on the seed then yields the pairs of
   text and item that share enough of the item to reach the threshold.
2. Tiling: for such a pair the longest match not overlapping a marked one is
   marked, again and again with running Karp-Rabin hashes of decreasing
   length, until no unmarked match of ``MIN_MATCH`` words is left.  Tiles may
   come in any order, so reordered passages are caught.
3. An item whose marked words make up ``MIN_COVERAGE`` of it contaminates.

Texts are told by their hash, so copies are tiled once.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.session import store

MIN_MATCH = 5
MIN_COVERAGE = 0.5
BLOOM_BITS = 1 << 24
HASH_WORDS = 200_000

_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _WordHash(dict):
    """XXH64 of a word, remembered."""

    def __missing__(self, word):
        if len(self) > HASH_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(text: str | None, memory: dict) -> np.ndarray:
    """Hashes of the lower-cased words of a text, punctuation dropped."""
    words = _WORD.findall(text.lower()) if text else []
    return np.fromiter(map(memory.__getitem__, words), dtype=np.uint64, count=len(words))


def running_hash(h: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``length`` words: sum of h[i+j] * B^(length-1-j), modulo 2^64."""
    if len(h) < length:
        return np.zeros(0, dtype=np.uint64)
    if length <= 8:
        out = h[:len(h) - length + 1].copy()
        for j in range(1, length):
            out = out * _BASE + h[j:len(h) - length + 1 + j]
        return out
    half = length // 2
    return running_hash(h, length - half)[:len(h) - length + 1] * _power(half) + running_hash(h, half)[length - half:]


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def seeds(h: np.ndarray, min_match: int) -> np.ndarray:
    """Mixed running hashes, fit as join keys and Bloom positions."""
    s = running_hash(h, min_match)
    s = (s ^ (s >> np.uint64(31))) * _MIX
    return s ^ (s >> np.uint64(29))


# --------------------------------------------------------------------- tiling

def tile(text: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> int:
    """Words of ``item`` covered by greedy tiles of ``min_match`` words or more."""
    free_t, free_i = np.ones(len(text), dtype=bool), np.ones(len(item), dtype=bool)

    def open_runs(free, length):
        """Starts of runs of ``length`` unmarked words."""
        if len(free) < length:
            return np.zeros(0, dtype=np.int64)
        count = np.concatenate(([0], np.cumsum(free)))
        return np.flatnonzero(count[length:] - count[:-length] == length)

    def common(length):
        """Starts in text and item of unmarked runs whose hash occurs on both sides."""
        a, b = open_runs(free_t, length), open_runs(free_i, length)
        ha, hb = running_hash(text, length)[a], running_hash(item, length)[b]
        ok_a, ok_b = np.isin(ha, hb), np.isin(hb, ha)
        return a[ok_a], ha[ok_a], b[ok_b], hb[ok_b]

    longest = min(len(text), len(item))
    while True:
        # the longest length that still has a match, by bisection: a match of n words holds one of n-1
        low, high = min_match - 1, longest
        while low < high:
            mid = (low + high + 1) // 2
            if len(common(mid)[0]):
                low = mid
            else:
                high = mid - 1
        if low < min_match:
            return int((~free_i).sum())
        a, ha, b, hb = common(low)
        order = np.argsort(ha, kind="stable")
        a, ha = a[order], ha[order]
        next_of: dict[int, int] = {}
        marked = False
        for start, h in zip(b.tolist(), hb.tolist()):
            if not free_i[start:start + low].all():
                continue
            at, end = next_of.get(h, np.searchsorted(ha, np.uint64(h))), np.searchsorted(ha, np.uint64(h), side="right")
            while at < end and not (free_t[a[at]:a[at] + low].all()
                                    and np.array_equal(text[a[at]:a[at] + low], item[start:start + low])):
                at += 1
            if at < end:
                free_t[a[at]:a[at] + low] = False
                free_i[start:start + low] = False
                marked = True
                at += 1
            next_of[h] = at
        # every match of this length is marked or overlaps a mark; equal hashes of unequal words leave it unmarked
        longest = low if marked else low - 1


def _bloom_positions(s: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64(bits - 1)
    return [(s & mask).astype(np.int64), (s >> np.uint64(32) & mask).astype(np.int64)]


# ------------------------------------------------------------------ operators

def _benchmark_words(benchmark: DataFrame, min_match: int) -> DataFrame:
    """(item_key, item_id, words, seeds) of every benchmark row of at least ``min_match`` words; item_key tells words apart."""
    def run(batches):
        memory = _WordHash()
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"]):
                h = word_hashes(text, memory)
                if len(h) >= min_match:
                    key = xxhash.xxh64_intdigest(h.tobytes()) >> 1
                    rows.append((key, item, h.view(np.int64), seeds(h, min_match).view(np.int64)))
            yield pd.DataFrame(rows, columns=["item_key", "item_id", "words", "seeds"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", "text").dropna().mapInPandas(
        run, f"item_key long, item_id {kind}, words array<long>, seeds array<long>")


def _bloom(items: DataFrame, bits: int) -> np.ndarray:
    """Bit array of all seeds: built in tasks, folded in Spark, ``bits`` / 8 bytes at the driver."""
    block = 1 << 16

    def run(batches):
        table = np.zeros(bits, dtype=bool)
        for batch in batches:
            for s in batch["seeds"]:
                for p in _bloom_positions(np.asarray(s, dtype=np.int64).view(np.uint64), bits):
                    table[p] = True
        for i in range(bits // block):
            part = table[i * block:(i + 1) * block]
            if part.any():
                yield pd.DataFrame({"block": [i], "bits": [np.packbits(part).tobytes()]})

    def fold(key, group):
        bits_of = np.bitwise_or.reduce([np.frombuffer(b, dtype=np.uint8) for b in group["bits"]])
        return pd.DataFrame({"block": [key[0]], "bits": [bits_of.tobytes()]})

    parts = items.select("seeds").mapInPandas(run, "block int, bits binary")
    table = np.zeros(bits // 8, dtype=np.uint8)
    for r in parts.groupBy("block").applyInPandas(fold, "block int, bits binary").toLocalIterator():
        table[r.block * block // 8:(r.block + 1) * block // 8] = np.frombuffer(r.bits, dtype=np.uint8)
    return table


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_match: int = MIN_MATCH,
                       min_coverage: float = MIN_COVERAGE, bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """(text_key, item_id, covered, item_words, coverage): texts, told by xxhash64, and the items that they hold.

    Items with a null id or text, or of fewer than ``min_match`` words, match
    nothing.  Null, empty and short texts hold nothing.  Every text that an
    item id has is matched for itself; a text and an item give one row, that
    of the largest coverage (of the longest item text where equal).
    """
    listed = store(_benchmark_words(benchmark, min_match))
    named = listed.select("item_key", "item_id").distinct()
    items = store(listed.groupBy("item_key").agg(F.first("words").alias("words"), F.first("seeds").alias("seeds")))
    table = docs.sparkSession.sparkContext.broadcast(_bloom(items, bloom_bits))

    def survivors(batches):
        memory = _WordHash()
        for batch in batches:
            rows = []
            for key, text in zip(batch["text_key"], batch["text"]):
                h = word_hashes(text, memory)
                s = seeds(h, min_match)
                ok = np.ones(len(s), dtype=bool)
                for p in _bloom_positions(s, bloom_bits):
                    ok &= (table.value[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)
                if ok.any():
                    # the words that lie in some surviving run; a gap becomes one word that no item has
                    cover = np.zeros(len(h) + 1, dtype=np.int64)
                    at = np.flatnonzero(ok)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + min_match, -1)
                    inside = np.cumsum(cover[:-1]) > 0
                    gap = ~inside & np.concatenate(([False], inside[:-1]))
                    kept = np.where(inside, h, np.uint64(0))[inside | gap]
                    rows.append((key, kept.view(np.int64), np.unique(s[ok]).view(np.int64)))
            yield pd.DataFrame(rows, columns=["text_key", "words", "seeds"])

    texts = docs.select(F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    found = store(texts.mapInPandas(survivors, "text_key long, words array<long>, seeds array<long>"))
    found = found.dropDuplicates(["text_key"])

    # tiles of min_match words or more covering c words hold c / min_match of the item's seeds at least
    need = F.ceil(F.size("words") * F.lit(min_coverage / min_match))
    item_seeds = items.select("item_key", need.alias("need"), F.explode("seeds").alias("seed"))
    pairs = found.select("text_key", F.explode("seeds").alias("seed")).join(item_seeds, "seed") \
        .groupBy("text_key", "item_key").agg(F.count("*").alias("shared"), F.max("need").alias("need")) \
        .where("shared >= need").select("text_key", "item_key")
    sides = pairs.join(found.select("text_key", "words"), "text_key").join(
        items.select("item_key", F.col("words").alias("item")), "item_key")

    def tiles(batches):
        for batch in batches:
            covered = [tile(np.asarray(t, dtype=np.int64).view(np.uint64), np.asarray(i, dtype=np.int64).view(np.uint64), min_match)
                       for t, i in zip(batch["words"], batch["item"])]
            yield pd.DataFrame({"text_key": batch["text_key"], "item_key": batch["item_key"],
                                "covered": covered, "item_words": batch["item"].map(len)})

    done = sides.mapInPandas(tiles, "text_key long, item_key long, covered int, item_words int")
    done = done.withColumn("coverage", F.col("covered") / F.col("item_words")).where(F.col("coverage") >= min_coverage)
    best = F.max(F.struct("coverage", "item_words", "covered")).alias("best")
    return done.join(named, "item_key").groupBy("text_key", "item_id").agg(best).select(
        "text_key", "item_id", "best.covered", "best.item_words", "best.coverage")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, contaminated, n_items, item_id, coverage) for every row of ``docs``.

    ``item_id`` is the item of largest coverage (the smallest id of equals),
    null for clean rows, whose coverage is 0.  Repeated rows stay repeated.
    """
    worst = store(contaminated_texts(docs, benchmark, text_col).groupBy("text_key").agg(
        F.count("*").alias("n_items"), F.max("coverage").alias("coverage"),
        F.min_by("item_id", F.struct(-F.col("coverage"), "item_id")).alias("item_id")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col)).alias("text_key"))
    return rows.join(worst, "text_key", "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item, all columns kept; null and empty texts hold none, repeated rows go or stay alike."""
    bad = store(contaminated_texts(docs, benchmark, text_col).select(F.col("text_key").alias("__bad")).distinct())
    return docs.join(bad, F.xxhash64(docs[text_col]) == bad["__bad"], "left_anti")
