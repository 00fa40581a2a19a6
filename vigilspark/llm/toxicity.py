"""Toxicity as cumulative-link ordinal regression on sparse counts of words and their parts.

Grades are ordered: 0 not toxic, then toxic with few, several and many
marker words.  One weight vector serves all thresholds:
P(grade > k) = sigmoid(w.x - cut_k) with increasing cuts, and the expected
severity is the sum of these probabilities.

A text's features are the whole words and the runs of 3 to 6 characters in
them (ends marked, told by 64-bit hashes) that a signed G2 test on document
counts picks, so that a known stem counts under an ending never seen.  Labels
only say toxic or not; the grade of a toxic label comes from its marker
words, those with a feature that toxic labels favour: fewer than 3
occurrences are grade 1, fewer than 6 grade 2, else 3.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``,
chosen by a hash of the id); the sample's documents are read, tokenised,
freed of copies and counted in Spark, and only the vectors over the selected
features reach the driver.  One fold in ``FOLDS``, by another hash, teaches no
weights: there the probability from which a text is called toxic is chosen.
Scoring reads every text whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.session import store

SAMPLE_ROWS = 20_000
MIN_G2 = 24.0
GRADE_FROM = (3, 6)
LEVELS = len(GRADE_FROM) + 1
RIDGE = 1e-3
STEPS = 400
NEAR = 0.8
MARKS, MARK_ROWS = 20, 3
PIECE_CHARS = range(3, 7)
FEATURES = 4096
FOLDS = 5
#: Called toxic from here where the held-out fold lacks toxic or other rows; never above.
TOXIC_FROM = 0.5
#: What the share of clean rows called toxic weighs against the share of toxic rows found.
CLEAN_WEIGHT = 3.0
MEMORY_WORDS = 200_000
FLUSH_PIECES = 2_000_000

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def marked(word: str) -> str:
    return f"^{word}$"


def pieces_of(word: str) -> set[str]:
    """The marked word and its runs of PIECE_CHARS characters."""
    whole = marked(word)
    found = {whole}
    for n in PIECE_CHARS:
        found.update(whole[i:i + n] for i in range(len(whole) - n + 1))
    return found


def piece_hashes(word: str) -> np.ndarray:
    """Hashes of its pieces, in no order."""
    pieces = pieces_of(word)
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces), dtype=np.uint64, count=len(pieces)).view(np.int64)


class _Memory(dict):
    """Word -> what ``make`` gives for it; remembers up to MEMORY_WORDS words."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        if len(self) > MEMORY_WORDS:
            self.clear()
        found = self.make(word)
        if len(word) <= 64:
            self[word] = found
        return found


# ------------------------------------------------------------- training table

def _shingles(words: list[str]) -> np.ndarray:
    """Sorted hashes of the distinct 5-word shingles (of all words where they are fewer)."""
    grams = {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}
    return np.sort(np.fromiter(map(xxhash.xxh64_intdigest, grams), dtype=np.uint64, count=len(grams)))


def _marks(shingles: np.ndarray) -> list[int]:
    """MARKS hashes of MARK_ROWS min-hashes each; rows at a Jaccard of 0.8 share none with a chance of 6e-7."""
    rng = np.random.default_rng(1)
    times, plus = rng.integers(1, 1 << 63, (2, MARKS * MARK_ROWS), dtype=np.uint64)
    least = np.array([(shingles * (t | np.uint64(1)) + p).min() for t, p in zip(times, plus)], dtype=np.uint64)
    return [xxhash.xxh64_intdigest(rows.tobytes(), i) >> 1 for i, rows in enumerate(least.reshape(MARKS, MARK_ROWS))]


def _sample_rows(batches):
    """Word counts, a hash of the words in order, and shingles and marks to tell near copies by."""
    for batch in batches:
        rows = []
        for doc_id, toxic, text in zip(batch["doc_id"], batch["toxic"], batch["text"]):
            words = words_of(text)
            shingles = _shingles(words)
            seen = Counter(words)
            rows.append((doc_id, toxic, xxhash.xxh64_intdigest(" ".join(words)) >> 1, _marks(shingles),
                         shingles.view(np.int64), list(seen), list(seen.values())))
        yield pd.DataFrame(rows, columns=["doc_id", "toxic", "whole", "marks", "shingles", "words", "times"])


def training_table(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, toxic, words, times) of about ``sample_rows`` labelled documents.

    Labels with a null id or grade are ignored; an id labelled twice is toxic
    if one label says so.  Of rows with equal words of one label the smallest
    id counts.  Rows that share a mark with a label are a group; a row whose
    shingle Jaccard with the smallest id of one of its groups is ``NEAR`` or
    more doesn't count either.
    """
    known = labels.select(F.col("doc_id").alias("__id"), "toxic").dropna().groupBy("__id").agg(F.max("toxic").alias("toxic"))
    rows = known.count()
    if rows > sample_rows:
        share = int(sample_rows / rows * (1 << 30))
        known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < share)
    # at most about sample_rows rows of 12 bytes, whatever the size of labels
    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(known), "__id")
    made = picked.select(F.col("__id").alias("doc_id"), "toxic", "text").mapInPandas(
        _sample_rows, "doc_id long, toxic int, whole long, marks array<long>, shingles array<long>, words array<string>, times array<int>")
    made = made.groupBy("whole", (F.col("toxic") > 0).alias("label")).agg(
        F.min_by(F.struct(*made.columns), "doc_id").alias("row")).select("label", "row.*")
    made = store(made)
    marks = made.select("doc_id", "whole", "label", F.posexplode("marks").alias("i", "mark"))
    # every row meets the first one of each of its MARKS groups: MARKS pairs a row at most, however large a group
    first = marks.groupBy("i", "mark", "label").agg(F.min(F.struct("doc_id", "whole")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    pairs = marks.join(first, ["i", "mark", "label"]).select("doc_id", "whole", "first.doc_id", "first.whole").toDF(
        "doc_id", "whole", "first_id", "first_whole").where("doc_id <> first_id or whole <> first_whole").distinct()
    own = made.select("doc_id", "whole", "shingles")
    both = pairs.join(own, ["doc_id", "whole"]).join(own.toDF("first_id", "first_whole", "others"), ["first_id", "first_whole"])
    shared = F.size(F.array_intersect("shingles", "others"))
    copies = both.where(shared >= NEAR * (F.size("shingles") + F.size("others") - shared)).select("doc_id", "whole").distinct()
    return made.join(copies, ["doc_id", "whole"], "left_anti").select("doc_id", "toxic", "words", "times")


def _g2(a, b, n1, n0):
    """Signed log-likelihood ratio of a word in a of n1 toxic and b of n0 other documents."""
    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))
    n = n1 + n0
    g = 2 * (part(a, (a + b) * n1 / n) + part(b, (a + b) * n0 / n)
             + part(n1 - a, (n - a - b) * n1 / n) + part(n0 - b, (n - a - b) * n0 / n))
    return F.when(a * n0 >= b * n1, g).otherwise(-g)


# ---------------------------------------------------------------------- model

@dataclass
class Model:
    """Piece -> column, shared weights, increasing cuts, the probability from which a text is toxic."""

    column: dict[str, int]
    weight: np.ndarray
    cuts: np.ndarray
    toxic_from: float = TOXIC_FROM

    def above(self, scores: np.ndarray) -> np.ndarray:
        """(rows, LEVELS): P(grade > k)."""
        return _sigmoid(scores[:, None] - self.cuts[None, :])

    def memory(self) -> _Memory:
        """Word -> columns of its pieces, which an automaton finds."""
        if not self.column:
            return _Memory(lambda word: ())
        find = ahocorasick.Automaton()
        for piece, c in self.column.items():
            find.add_word(piece, c)
        find.make_automaton()
        return _Memory(lambda word: tuple({c for _, c in find.iter(marked(word))}))

    def scores(self, texts, memory: dict | None = None) -> np.ndarray:
        memory = self.memory() if memory is None else memory
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            seen: dict[int, int] = {}
            for word, n in Counter(words_of(text)).items():
                for c in memory[word]:
                    seen[c] = seen.get(c, 0) + n
            if seen:
                out[i] = self.weight[list(seen)] @ np.log1p(list(seen.values()))
        return out

    def is_toxic(self, texts, memory: dict | None = None) -> np.ndarray:
        return self.above(self.scores(texts, memory))[:, 0] >= self.toxic_from


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))


def _descend(rows, cols, values, grade, width) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts of largest penalised likelihood, by Adam on the full sample."""
    n = len(grade)
    share = np.clip([(grade > k).mean() for k in range(LEVELS)], 1e-4, 1 - 1e-4)
    cuts = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(cuts), 0.05))
    theta = np.concatenate([np.zeros(width), cuts[:1], gaps])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    pick = np.arange(n)
    for step in range(1, STEPS + 1):
        w, c = theta[:width], np.concatenate([theta[width:width + 1], theta[width] + np.cumsum(np.exp(theta[width + 1:]))])
        score = np.bincount(rows, weights=values * w[cols], minlength=n)
        above = np.column_stack([np.ones(n), _sigmoid(score[:, None] - c), np.zeros(n)])
        slope = above * (1 - above)
        high, low = above[pick, grade], above[pick, grade + 1]
        chance = np.maximum(high - low, 1e-12)
        d_high, d_low = slope[pick, grade] / chance, slope[pick, grade + 1] / chance
        g_score = -(d_high - d_low) / n
        g_cut = np.array([(d_high[grade == k + 1].sum() - d_low[grade == k].sum()) / n for k in range(LEVELS)])
        tail = np.cumsum(g_cut[::-1])[::-1]
        grad = np.concatenate([np.bincount(cols, weights=values * g_score[rows], minlength=width) + RIDGE * w,
                               tail[:1], tail[1:] * np.exp(theta[width + 1:])])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta - 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    return theta[:width], np.concatenate([theta[width:width + 1], theta[width] + np.cumsum(np.exp(theta[width + 1:]))])


def _piece_counts(sample: DataFrame) -> DataFrame:
    """(piece, a, b): toxic and other rows that have the piece in some word."""
    def run(batches):
        memory, held, size = _Memory(piece_hashes), {True: [], False: []}, 0

        def frame():
            piece, at = np.unique(np.concatenate(held[True] + held[False]), return_inverse=True)
            toxic = np.arange(len(at)) < sum(map(len, held[True]))
            return pd.DataFrame({"piece": piece, "a": np.bincount(at[toxic], minlength=len(piece)),
                                 "b": np.bincount(at[~toxic], minlength=len(piece))})

        for batch in batches:
            for words, toxic in zip(batch["words"], batch["toxic"]):
                if len(words):
                    own = np.unique(np.concatenate([memory[w] for w in words]))
                    held[toxic > 0].append(own)
                    size += len(own)
                if size > FLUSH_PIECES:
                    yield frame()
                    held, size = {True: [], False: []}, 0
        if held[True] or held[False]:
            yield frame()

    return sample.select("words", "toxic").mapInPandas(run, "piece long, a long, b long").groupBy("piece").agg(
        F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))


def _vectors(sample: DataFrame, column: dict[int, int], marker: np.ndarray) -> tuple[pd.DataFrame, dict[str, int]]:
    """(rows (toxic, held, columns, times, marks), piece -> column): counts of the chosen pieces (by hash) in the sample's rows, how many words have a marker piece, and the pieces themselves."""
    shared = sample.sparkSession.sparkContext.broadcast((column, marker))

    def run(batches):
        of, favoured = shared.value
        memory, named = _Memory(lambda word: tuple(of[h] for h in piece_hashes(word).tolist() if h in of)), set()
        for batch in batches:
            rows = []
            for toxic, held, words, times in zip(batch["toxic"], batch["held"], batch["words"], batch["times"]):
                seen, marks, names = {}, 0, {}
                for word, n in zip(words, times):
                    found = memory[word]
                    marks += int(n) * any(favoured[c] for c in found)
                    for c in found:
                        seen[c] = seen.get(c, 0) + int(n)
                    if not named.issuperset(found):
                        names |= {p: of[h] for p in pieces_of(word) if (h := np.uint64(xxhash.xxh64_intdigest(p)).astype(np.int64).item()) in of}
                        named.update(found)
                rows.append((toxic, held, list(seen), list(seen.values()), marks, list(names), list(names.values())))
            yield pd.DataFrame(rows, columns=["toxic", "held", "columns", "times", "marks", "pieces", "piece_columns"])

    got = sample.mapInPandas(run, "toxic int, held boolean, columns array<int>, times array<int>, marks long, "
                                  "pieces array<string>, piece_columns array<int>").toPandas()
    return got, {p: int(c) for ps, cs in zip(got["pieces"], got["piece_columns"]) for p, c in zip(ps, cs)}


def _toxic_from(p: np.ndarray, toxic: np.ndarray) -> float:
    """The probability that parts held-out toxic rows from others best: a third up, in log odds, of the best gap between them."""
    if toxic.all() or not toxic.any():
        return TOXIC_FROM
    at = np.unique(p)
    found = 1 - np.searchsorted(np.sort(p[toxic]), at[1:]) / toxic.sum()
    lost = 1 - np.searchsorted(np.sort(p[~toxic]), at[1:]) / (~toxic).sum()
    if not len(found):
        return TOXIC_FROM
    gain = found - CLEAN_WEIGHT * lost
    odds = np.log(np.clip(at, 1e-12, 1 - 1e-12) / (1 - np.clip(at, 1e-12, 1 - 1e-12)))
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    gap = best[np.argmax(np.diff(odds)[best])]
    return min(TOXIC_FROM, float(_sigmoid((2 * odds[gap] + odds[gap + 1]) / 3)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        sample_rows: int = SAMPLE_ROWS) -> Model:
    """Model of the labelled sample; without toxic or without other labels, one that calls nothing toxic."""
    sample = store(training_table(docs, labels, id_col, text_col, sample_rows))
    sample = sample.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)) == 0)
    sizes = sample.where("not held").agg(F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0)), F.count("*")).first()
    n1, n0 = int(sizes[0]), int(sizes[1] - sizes[0])
    none = Model({}, np.zeros(0), np.full(LEVELS, 60.0))
    if not n1 or not n0:
        return none
    counts = _piece_counts(sample.where("not held"))
    chosen = counts.withColumn("g2", _g2(F.col("a"), F.col("b"), F.lit(float(n1)), F.lit(float(n0)))).where(F.abs("g2") >= MIN_G2)
    picked = chosen.orderBy(F.desc(F.abs("g2")), "piece").limit(FEATURES).select("piece", "g2").collect()
    if not any(r.g2 > 0 for r in picked):
        return none
    column, marker = {r.piece: i for i, r in enumerate(picked)}, np.array([r.g2 > 0 for r in picked])
    rows, pieces = _vectors(sample.select("toxic", "held", "words", "times"), column, marker)
    toxic, held = rows["toxic"].to_numpy() > 0, rows["held"].to_numpy(dtype=bool)
    learned = rows[~held]
    size = learned["columns"].map(len).to_numpy(dtype=np.int64)
    at = np.repeat(np.arange(len(learned)), size)
    cols = np.concatenate([*learned["columns"], []]).astype(np.int64)
    times = np.log1p(np.concatenate([*learned["times"], []]).astype(np.float64))
    grade = np.where(toxic[~held], 1 + np.searchsorted(GRADE_FROM, learned["marks"], side="right"), 0)
    weight, cuts = _descend(at, cols, times, grade, len(column))
    model = Model(pieces, weight, cuts)
    score = np.array([weight[np.asarray(c, dtype=np.int64)] @ np.log1p(np.asarray(t, dtype=np.float64))
                      for c, t in zip(rows["columns"][held], rows["times"][held])], dtype=np.float64)
    model.toxic_from = _toxic_from(model.above(score)[:, 0], toxic[held])
    return model


def severity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_severity, grade, p_toxic, toxic) for every row.

    ``grade`` is the highest grade reached with the model's ``toxic_from`` or
    more, and ``toxic`` whether that is above 0.  Null, empty and wordless texts have no
    features and get the model's base rate.  Repeated rows stay repeated;
    other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        memory = shared.value.memory()
        for batch in batches:
            above = shared.value.above(shared.value.scores(batch["text"].tolist(), memory))
            grade = (above >= shared.value.toxic_from).sum(axis=1).astype(np.int32)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "expected_severity": above.sum(axis=1),
                                "grade": grade, "p_toxic": above[:, 0], "toxic": grade > 0})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, f"doc_id {kind}, expected_severity double, grade int, p_toxic double, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that the model doesn't call toxic, all columns kept.

    Null, empty and wordless texts have the base rate, repeated rows the same
    verdict each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memory = shared.value.memory()
        for texts in parts:
            yield pd.Series(~shared.value.is_toxic(texts.tolist(), memory))

    return docs.where(clean(F.col(text_col)))
