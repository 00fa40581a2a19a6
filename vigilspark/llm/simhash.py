"""SimHash near-duplicates found through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 21, 21 and 22 bits, each
seen as a word of the perfect binary Golay code (23, 12, 7) with zeros
below.  Its *home* is the index of the one codeword within distance 3; its
*ring* holds the indices of all codewords within distance 4 (one, or six
when the home lies at distance 3).  If two segments differ in at most one
bit, the home of either lies in the ring of the other.

Two fingerprints at 3 bits or fewer split their errors over the segments as
(0, 0, <=3), (0, <=1, <=2) or (1, 1, 1).  So either some segment is equal and
another differs in at most one bit, or all three differ in at most one.
Keys for the two cases are (equal segment, home / ring of another) and (home
or ring of all three); the probing copy of a fingerprint takes homes where
the stored copy takes rings.  Candidates met on a key are verified by the
bit distance itself, so the result is exact.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm.components import components
from vigilspark.session import store

MAX_BITS = 3
SHINGLE_WORDS = 3
HASH_SEED = 42

#: Fixed values of the Golay code: generator polynomial x^11+x^9+x^7+x^6+x^5+x+1,
#: 12 message bits above 11 check bits.
GENERATOR = 0b101011100011
CHECK_BITS = 11
WORD_BITS = 23

#: (lowest bit, width) of the three segments of a fingerprint.
SEGMENTS = ((0, 21), (21, 21), (42, 22))


# ---------------------------------------------------------------- fingerprint

@lru_cache(maxsize=1)
def _bit_lanes() -> np.ndarray:
    """For every byte value its eight bits as the eight bytes of a word."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Bit-wise majority of the XXH64 of all word shingles; 0 without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    size = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    end = np.cumsum(size + 1) - 1
    start = end - size
    span = min(words, len(tokens))
    first, last = start[:len(tokens) - span + 1].tolist(), end[span - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(first, last)], dtype=np.uint64)
    # eight byte-wide counters a word: 255 hashes add up before one overflows
    lanes = np.add.reduceat(_bit_lanes()[h.view(np.uint8).reshape(-1, 8)], np.arange(0, len(h), 255), axis=0)
    ones = lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(first)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, id_col: str, text_col: str, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row per input row."""
    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in batch["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fp})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, f"doc_id {kind}, fp long")


# ----------------------------------------------------------------- Golay code

@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(check, error, ring) built from the generator.

    check[m]: the 11 check bits of message m.  error[s]: the error pattern of
    weight 3 or less with syndrome s.  ring[s]: what to xor onto a home index
    for every codeword within distance 4 of a word with syndrome s, the
    first entry 0, the others 0 too unless the error has weight 3.
    """
    message = np.arange(1 << 12, dtype=np.int64)
    rest = message << CHECK_BITS
    for bit in range(WORD_BITS - 1, CHECK_BITS - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - CHECK_BITS)), rest)
    check = rest
    word = message << CHECK_BITS | check
    error = np.full(1 << CHECK_BITS, -1, dtype=np.int64)
    error[0] = 0
    unit = 1 << np.arange(WORD_BITS, dtype=np.int64)
    two = (unit[:, None] | unit[None, :])[np.triu_indices(WORD_BITS, 1)]
    three = np.unique([a | b for a in two.tolist() for b in unit.tolist() if not a & b])
    for errors in (unit, two, three):
        error[_syndrome(errors, check)] = errors
    seven = word[[bin(w).count("1") == 7 for w in word.tolist()]]
    ring = np.zeros((1 << CHECK_BITS, 6), dtype=np.int64)
    for e in three.tolist():
        ring[_syndrome(np.array([e]), check)[0], 1:] = seven[seven & e == e] >> CHECK_BITS
    return check, error, ring


def _syndrome(word: np.ndarray, check: np.ndarray) -> np.ndarray:
    return (word & ((1 << CHECK_BITS) - 1)) ^ check[word >> CHECK_BITS]


def home_and_ring(segment: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home index, ring indices (n, 6) and which ring entries count."""
    check, error, ring = golay()
    word = segment << (WORD_BITS - width)
    s = _syndrome(word, check)
    home = (word ^ error[s]) >> CHECK_BITS
    valid = np.ones((len(word), 6), dtype=bool)
    valid[:, 1:] = ring[s][:, 1:] != 0
    return home, home[:, None] ^ ring[s], valid


def fuzzy_keys(fp: np.ndarray) -> list[tuple[bool, np.ndarray, np.ndarray]]:
    """(probing, row number, key) blocks for an array of fingerprints."""
    u = fp.view(np.uint64)
    seg = [(u >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    parts = [home_and_ring(s, width) for s, (_, width) in zip(seg, SEGMENTS)]
    rows = np.arange(len(fp))
    out = []
    for case, (equal, near) in enumerate(permutations(range(3), 2)):
        home, ring, valid = parts[near]
        head = (case << 22 | seg[equal]) << 12
        out.append((True, rows, head | home))
        at, which = np.nonzero(valid)
        out.append((False, at, head[at] | ring[at, which]))
    (h0, r0, v0), (h1, r1, v1), (h2, r2, v2) = parts
    at, which = np.nonzero(v2)
    out.append((True, at, (6 << 36 | h0 << 24 | h1 << 12)[at] | r2[at, which]))
    at, a, b = np.nonzero(v0[:, :, None] & v1[:, None, :])
    out.append((False, at, 6 << 36 | r0[at, a] << 24 | r1[at, b] << 12 | h2[at]))
    return out


def _keys(fps: DataFrame, probing: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            fp = batch["fp"].to_numpy()
            blocks = [(r, k) for side, r, k in fuzzy_keys(fp) if side == probing]
            yield pd.DataFrame({"fp": fp[np.concatenate([r for r, _ in blocks])],
                                "key": np.concatenate([k for _, k in blocks])})

    return fps.select("fp").mapInPandas(run, "fp long, key long")


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints at ``max_bits`` bits or
    fewer; ``max_bits`` may be 0 to 3, what the keys guarantee."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 0 to {MAX_BITS}")
    probe = _keys(fps, True).withColumnRenamed("fp", "a")
    stored = _keys(fps, False).withColumnRenamed("fp", "b")
    met = stored.join(probe.hint("shuffle_hash"), "key").where(
        (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# ------------------------------------------------------------------ operators

def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """((doc_id, fp) of every row, (fp, first_id, root) of every fingerprint, root naming its group)."""
    marked = store(with_fingerprint(docs, id_col, text_col, words))
    by_fp = store(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = components(links(by_fp, max_bits), "a", "b")
    return marked, by_fp.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Words are runs of non-white-space with A-Z lower-cased; shingles count
    with their repeats; a shorter text is one shingle; null and wordless
    texts have fingerprint 0 and link like any other.  Rows of equal
    fingerprint collapse before the search, so groups of copies cost one
    row.  A null id stays null, names no component, and is given the
    component of its fingerprint.  Repeated rows stay repeated.  Other
    columns are ignored; an empty table gives an empty result.
    """
    marked, placed = _grouped(docs, id_col, text_col, words, max_bits)
    root_id = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    class_of = placed.join(root_id, "root").select("fp", "component_id")
    return marked.join(class_of, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row per group: one of its smallest id.

    All columns stay.  A row belongs to the group of its own text, so an id
    that stands for several texts can keep a row in several groups; repeated
    rows leave one.  Rows without an id can't be named as a group's keeper;
    all stay.
    """
    named = docs.where(F.col(id_col).isNotNull())
    marked, placed = _grouped(named, id_col, text_col, words, max_bits)
    keepers = store(placed.groupBy("root").agg(F.min(F.struct("first_id", "fp")).alias("kept")).select(
        F.col("kept.first_id").alias("__id"), F.col("kept.fp").alias("__fp")))
    # an id of one row is told by itself; only rows of repeated ids need their text looked at again
    repeated = store(marked.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("rows")).where("rows > 1").select("__id"))
    by_id = lambda df, other, how: df.join(other, df[id_col] == other["__id"], how)
    alone = by_id(named, keepers.join(repeated, "__id", "left_anti"), "left_semi")

    @F.pandas_udf("long")
    def fp_of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    again = by_id(named, repeated, "left_semi")
    again = again.withColumn("__fp_own", fp_of(F.col(text_col)))
    again = again.join(keepers, (again[id_col] == keepers["__id"]) & (again["__fp_own"] == keepers["__fp"]), "left_semi")
    again = again.dropDuplicates([id_col, "__fp_own"]).drop("__fp_own")
    return alone.unionByName(again).unionByName(docs.where(F.col(id_col).isNull()))
