"""Ranked lexical search by scanning documents with an Aho-Corasick automaton.

All terms of a block of items, each between two guards that no term holds, make
one automaton.  It is sent to every task and run over whole texts, whose other
characters are turned into guards, so only whole terms match, and every match
names the items that have the term.  No document is indexed: a scan leaves,
for every document, how many terms it has and how often each item term occurs.
From these follow N, L and each df, and then all scores, of which a task keeps
an item's best.

An automaton holds the terms of at most about ``BLOCK_BYTES``; more items are
taken in blocks, each with a scan of its own.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.session import store

TOP = 10
BLOCK_BYTES = 4_000_000
#: Contributions added up at a time, and cells of the table of scores they go to.
CHUNK_HITS = 1_000_000
CHUNK_CELLS = 1_000_000

GUARD = 0x20
#: Byte -> byte: letters and digits stay (A-Z lower-cased), as does all beyond ASCII; the rest becomes the guard.
_GUARDED = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else GUARD for b in range(256))


def guarded(text: str | None) -> bytes:
    """The text's terms in order with guards around and between them."""
    return b" " + (text or "").encode("utf-8", "surrogatepass").translate(_GUARDED) + b" "


def count_terms(text: bytes) -> int:
    """Terms of a guarded text, repeats counted."""
    solid = np.frombuffer(text, dtype=np.uint8) != GUARD
    return int((solid[1:] & ~solid[:-1]).sum())


# ---------------------------------------------------------------------- items

def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, terms): the distinct terms of each item, over all rows of its id; items without a term are left out."""
    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"item_id": batch["item_id"], "terms": [sorted(set(guarded(t).split())) for t in batch["text"]]})

    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).mapInPandas(
        run, f"item_id {kind}, terms array<binary>")
    return rows.select("item_id", F.explode("terms").alias("term")).groupBy("item_id").agg(F.collect_set("term").alias("terms"))


class Terms:
    """Sorted terms of a block of items, and which of its items have each."""

    def __init__(self, rows):
        self.ids = [r["item_id"] for r in rows]
        self.terms = sorted({bytes(t) for r in rows for t in r["terms"]})
        number = {t: i for i, t in enumerate(self.terms)}
        pairs = sorted((number[bytes(t)], i) for i, r in enumerate(rows) for t in r["terms"])
        self.items = np.array([i for _, i in pairs], dtype=np.int64)
        self.size = np.bincount(np.array([t for t, _ in pairs], dtype=np.int64), minlength=len(self.terms))
        self.start = np.cumsum(self.size) - self.size


def automaton(terms: list[bytes]):
    """Finds the number of every guarded term."""
    found = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        found.add_word(" " + t.decode("latin-1") + " ", i)
    found.make_automaton()
    return found


def _blocks(items: DataFrame) -> list[list]:
    """Rows of ``items`` in blocks of about BLOCK_BYTES, one on the driver at a time."""
    size = items.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.length(t) + 2))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for block in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == block).orderBy("item_id").collect()
        if rows:
            yield rows


# ----------------------------------------------------------------------- scan

def scan(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): terms of each text with repeats, and the numbers of ``terms`` found in it with their counts; texts without a term are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        find = automaton(shared.value)
        for batch in batches:
            n, found = [], []
            for text in batch["text"]:
                text = guarded(text)
                n.append(count_terms(text))
                found.append(Counter(map(itemgetter(1), find.iter(text.decode("latin-1")))) if len(find) else {})
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": n, "terms": [list(c) for c in found],
                                "tfs": [list(c.values()) for c in found]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, "doc_id long, n long, terms array<int>, tfs array<int>").where("n > 0")


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """Weight of each term from the number of documents that have it."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


class _Best:
    """The ``top`` highest scores of every item among the documents seen."""

    def __init__(self, items: int, top: int):
        self.top, self.floor = top, np.ones(items, dtype=np.int64)
        self.item = self.score = self.doc = np.zeros(0, dtype=np.int64)
        self.null = np.zeros(0, dtype=bool)

    def add(self, table: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """``table``: scores, a row for each of the documents."""
        least = self.floor
        if len(table) > self.top:
            least = np.maximum(least, np.partition(table, len(table) - self.top, axis=0)[len(table) - self.top])
        row, item = np.nonzero(table >= least)
        item, score = np.append(self.item, item), np.append(self.score, table[row, item])
        doc, null = np.append(self.doc, doc[row]), np.append(self.null, null[row])
        order = np.lexsort((doc, null, -score, item))
        item, score, doc, null = item[order], score[order], doc[order], null[order]
        first = np.searchsorted(item, item)
        keep = np.arange(len(item)) - first < self.top
        self.item, self.score, self.doc, self.null = item[keep], score[keep], doc[keep], null[keep]
        last = np.flatnonzero(np.arange(len(item)) - first == self.top - 1)
        self.floor[item[last]] = score[last]


def _score(counts: DataFrame, block: Terms, weight: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(i, doc_id, score): of every task the ``top`` documents of each of the block's items."""
    shared = counts.sparkSession.sparkContext.broadcast((block.items, block.start, block.size, weight))
    width = len(block.ids)

    def run(batches):
        items, start, size, w = shared.value
        best = _Best(width, top)
        for batch in batches:
            batch = batch[batch["terms"].map(len) > 0]
            if not len(batch):
                continue
            held = batch["terms"].map(len).to_numpy()
            term, tf = (np.concatenate(batch[c].tolist()).astype(np.int64) for c in ("terms", "tfs"))
            m = 100 - 90 + (90 * batch["n"].to_numpy(dtype=np.int64) * n_docs) // n_terms
            given = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, held)))
            hits = np.add.reduceat(size[term], np.cumsum(held) - held)
            null = batch["doc_id"].isna().to_numpy()
            doc = batch["doc_id"].fillna(0).to_numpy(dtype=np.int64)
            edge = np.concatenate([[0], np.cumsum(held)])
            for a, b in _chunks(hits, width):
                at = slice(edge[a], edge[b])
                many = size[term[at]]
                item = items[np.repeat(start[term[at]] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
                row = np.repeat(np.repeat(np.arange(b - a), held[a:b]), many)
                table = np.zeros((b - a) * width, dtype=np.int64)
                np.add.at(table, row * width + item, np.repeat(given[at], many))
                best.add(table.reshape(b - a, width), doc[a:b], null[a:b])
        if len(best.item):
            yield pd.DataFrame({"i": best.item, "doc_id": pd.Series(best.doc, dtype="Int64").mask(best.null), "score": best.score})

    return counts.select("doc_id", "n", "terms", "tfs").mapInPandas(run, "i int, doc_id long, score long")


def _chunks(hits: np.ndarray, width: int):
    """(from, to) of rows with about CHUNK_HITS contributions and CHUNK_CELLS cells."""
    start = total = 0
    most = max(1, CHUNK_CELLS // max(1, width))
    for i, n in enumerate(hits.tolist()):
        if i > start and (total + n > CHUNK_HITS or i - start >= most):
            yield start, i
            start, total = i, 0
        total += n
    yield start, len(hits)


# ------------------------------------------------------------------- operator

def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of every item by descending score above 0, equal scores by doc_id.

    Terms are runs of ASCII letters and digits and of all characters beyond
    ASCII, A-Z lower-cased.  Documents without a term (null, empty, or of
    other characters only) count nowhere and are never found.  An item's terms
    are those of all rows of its id, once each; an item without a term gives
    no row.  Every row of ``docs`` is a document, repeated or not; one without
    an id comes after the others of its score.  Other columns are ignored;
    an empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType.simpleString()
    wanted = store(item_terms(items, item_col, item_text))
    parts = []
    for rows in _blocks(wanted):
        block = Terms(rows)
        counts = store(scan(docs, block.terms, id_col, text_col))
        n_docs, n_terms = counts.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        df = np.zeros(len(block.terms), dtype=np.int64)  # one row a term of the block
        for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
            df[r.t] = r.df
        best = _score(counts, block, weights(df, n_docs), n_docs, n_terms, top)
        order = Window.partitionBy("i").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"i int, item_id {kind}")
        parts.append(store(best.join(F.broadcast(names), "i").select("item_id", "rank", "doc_id", "score")))
    found = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for p in parts:
        found = found.union(p)
    return found
