"""Language identification with bit-sliced Bloom filters of character n-grams.

Every language has a Bloom filter of the n-grams (1 to 4 characters of a
lower-cased word, its ends marked) that are common in it.  The filters are
bit-sliced: position p of all filters lies in one machine word, so the AND
over an n-gram's positions is the bitmask of all languages containing it.
A text's n-gram occurrences are counted per language from these masks, the
expected false positives taken off, and the largest share decides.

Learning is one grouped count over all training texts.  An n-gram enters a
language's filter if it makes up at least ``MIN_RATE`` of that language's
n-grams of its length, which bounds a language to 4 / MIN_RATE entries
whatever the corpus size, and is at least ``MIN_SHARE`` as common there as
where it is most common.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDERS = (1, 2, 3, 4)
MIN_RATE = 5e-5
MIN_SHARE = 0.1
POSITIONS = 1 << 20
HASHES = 3
UNKNOWN = "und"
CHUNK_CHARS = 500_000
CACHE_WORDS = 200_000

_LETTERS = regex.compile(r"\p{L}+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return _LETTERS.findall(text.lower()) if text else []


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, order, hash) of every n-gram of every word."""
    joined = " " + " ".join(words) + " "
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    space = code == 32
    inside = np.concatenate(([0], np.cumsum(space)))
    number = inside[1:] - 1
    h = np.zeros(len(code), dtype=np.uint64)
    who, order, value = [], [], []
    for n in range(1, max(ORDERS) + 1):
        h = (h[:len(code) - n + 1] + code[n - 1:]) * _STEP
        h = h ^ (h >> np.uint64(29))
        if n not in ORDERS:
            continue
        at = np.arange(len(h))
        # a space may only be the first or the last character, and not the only one
        ok = ~space if n == 1 else inside[at + n - 1] - inside[at + 1] == 0
        first = at[ok]
        who.append(number[first])
        order.append(np.full(len(first), n, dtype=np.int8))
        value.append(h[first] * _MIX + np.uint64(n))
    return np.concatenate(who), np.concatenate(order), np.concatenate(value)


def _chunks(texts):
    """Slices of a batch holding about CHUNK_CHARS characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= CHUNK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


# -------------------------------------------------------------------- learning

def _count(batches):
    """Partial (lang, ord, gram, n) counts, one row per distinct n-gram of a batch."""
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            texts = texts.tolist()
            for a, b in _chunks(texts):
                seen = Counter()
                for t in texts[a:b]:
                    seen.update(words_of(t))
                if not seen:
                    continue
                who, order, value = grams(list(seen))
                times = np.fromiter(seen.values(), dtype=np.int64, count=len(seen))
                key, first, back = np.unique(value, return_index=True, return_inverse=True)
                yield pd.DataFrame({"lang": lang, "ord": order[first], "gram": key.view(np.int64),
                                    "n": np.bincount(back, weights=times[who]).astype(np.int64)})


@dataclass
class Filters:
    """Bit-sliced Bloom filters: slices[w, p] holds position p of languages 64w to 64w+63."""

    langs: list[str]
    slices: np.ndarray
    false_rate: np.ndarray

    def masks(self, value: np.ndarray) -> np.ndarray:
        """(words, n): bitmask of the languages containing each n-gram."""
        found = None
        for p in positions(value):
            found = self.slices[:, p] if found is None else found & self.slices[:, p]
        return found

    def word_hits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams, their languages' popcounts) of every word."""
        who, _, value = grams(words)
        masks = self.masks(value)
        total = np.bincount(who, minlength=len(words)).astype(np.float32)
        hits = np.empty((len(words), len(self.langs)), dtype=np.float32)
        for i in range(len(self.langs)):
            bit = masks[i >> 6] >> np.uint64(i & 63) & np.uint64(1)
            hits[:, i] = np.bincount(who, weights=bit, minlength=len(words))
        return total, hits


def positions(value: np.ndarray) -> list[np.ndarray]:
    """Where an n-gram is kept: double hashing on the halves of its hash."""
    low, high = value & np.uint64(0xFFFFFFFF), value >> np.uint64(32) | np.uint64(1)
    return [((low + np.uint64(i) * high) % np.uint64(POSITIONS)).astype(np.int64) for i in range(HASHES)]


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from all rows of ``docs`` with text and language; other rows are ignored."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    counts = rows.mapInPandas(_count, "lang string, ord byte, gram long, n long") \
        .groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang", "ord").agg(F.sum("n").alias("total"))
    rated = counts.join(F.broadcast(total), ["lang", "ord"]).withColumn("rate", F.col("n") / F.col("total"))
    top = F.max("rate").over(Window.partitionBy("gram"))
    common = rated.where(F.col("rate") >= MIN_RATE).withColumn("top", top).where(F.col("rate") >= MIN_SHARE * F.col("top"))
    kept = common.select("lang", "gram").toPandas()  # at most 4 / MIN_RATE rows a language
    langs = sorted(kept["lang"].unique())
    slices = np.zeros((max(1, -(-len(langs) // 64)), POSITIONS), dtype=np.uint64)
    false_rate = np.zeros(len(langs))
    for i, lang in enumerate(langs):
        for p in positions(kept.loc[kept["lang"] == lang, "gram"].to_numpy().view(np.uint64)):
            slices[i >> 6, p] |= np.uint64(1) << np.uint64(i & 63)
        filled = (slices[i >> 6] >> np.uint64(i & 63) & np.uint64(1)).mean()
        false_rate[i] = filled ** HASHES
    return Filters(langs, slices, false_rate)


# ------------------------------------------------------------------ prediction

class Predictor:
    """Language and score of texts; keeps the popcounts of words it has met."""

    def __init__(self, filters: Filters):
        self.filters = filters
        self._forget()

    def _forget(self):
        self.number: dict[str, int] = {}
        self.total = np.zeros(0, dtype=np.float32)
        self.hits = np.zeros((0, len(self.filters.langs)), dtype=np.float32)

    def __call__(self, texts: list) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for a, b in _chunks(texts):
            n, s = self._chunk(texts[a:b])
            names += n
            scores.append(s)
        return names, np.concatenate(scores) if scores else np.zeros(0)

    def _chunk(self, texts: list) -> tuple[list[str], np.ndarray]:
        if len(self.number) > CACHE_WORDS:
            self._forget()
        split = [words_of(t) for t in texts]
        number, known = self.number, len(self.number)
        ids = np.fromiter((number.setdefault(w, len(number)) for ws in split for w in ws), dtype=np.int64)
        if len(number) > known:
            total, hits = self.filters.word_hits(list(number)[known:])
            self.total = np.concatenate([self.total, total])
            self.hits = np.concatenate([self.hits, hits])
        size = np.array([len(ws) for ws in split])
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        full = np.flatnonzero(size)
        if not len(full) or not self.filters.langs:
            return names, scores
        start = (np.cumsum(size) - size)[full]
        n = np.add.reduceat(self.total[ids], start, dtype=np.float64)
        hits = np.add.reduceat(self.hits[ids], start, axis=0, dtype=np.float64)
        false = self.filters.false_rate
        share = (hits / n[:, None] - false) / (1 - false)
        best = share.argmax(axis=1)
        for row, lang in zip(full.tolist(), best.tolist()):
            names[row] = self.filters.langs[lang]
        scores[full] = np.clip(share[np.arange(len(full)), best], 0, 1)
        return names, scores


def predict(docs: DataFrame, filters: Filters, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with lang_pred and score, one row per input row.

    The text alone is looked at.  Null, empty and letterless texts, and any
    text if no language was learned, give ``und`` and 0.  Equal shares fall
    to the language first in alphabetical order.  The score is the share of
    the text's n-grams found in the filter of its language, false positives
    taken off.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        predictor = Predictor(shared.value)
        for batch in batches:
            names, scores = predictor(batch["__text"].tolist())
            yield batch.drop(columns="__text").assign(lang_pred=names, score=scores)

    picked = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema[:-1])
    return picked.mapInPandas(run, f"{schema}, lang_pred string, score double")


def in_fold(id_col: str, folds: int, fold: int):
    """Whether crc32 of the id as text leaves ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             folds: int = 3, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the other folds.

    Rows without id learn nothing and count as not held out; repeated rows
    stay repeated; columns other than these three are ignored.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    own = own.withColumn("held_out", in_fold("doc_id", folds, held_out))
    filters = learn(own.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return predict(own, filters, "text", ("doc_id", "held_out"))


def keep_recognised(docs: DataFrame, filters: Filters, text_col: str = "text", min_score: float = 0.3) -> DataFrame:
    """Rows of ``docs`` whose text is in some learned language: not ``und``, and a score of ``min_score`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("boolean")
    def recognised(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predictor = Predictor(shared.value)
        for texts in parts:
            names, scores = predictor(texts.tolist())
            yield pd.Series([n != UNKNOWN for n in names]) & pd.Series(scores >= min_score)

    return docs.where(recognised(F.col(text_col)))
