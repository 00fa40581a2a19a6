"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

A rule bounds a measure of the text, or a measure as percent of another one.
Measures count words, characters, symbols, stop words, lines and repeats; a
row's arrays of words and lines are made once and every measure reads them.
No user function runs, nothing is shuffled, and thresholds compare in whole
numbers, so a ratio at its bound never depends on rounding.

Repeated windows of words are told by 64-bit hashes.  They are sorted only in
texts where two windows hash alike; time is n log n in the words of one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
SPLIT_AT = "[\\x20\\x09-\\x0D]+"
LETTERLESS_WORD = "(?<![^\\x20\\x09-\\x0D])[^\\p{L}\\x20\\x09-\\x0D]++(?![^\\x20\\x09-\\x0D])"
NO_SYMBOLS = "[^#*$%&|<>]+"
WINDOW_WORDS = 8
MAX_RULES = 1_000

#: The commonest function words of the four languages of the corpus.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf",
    "de", "la", "le", "et", "les", "en", "un", "du", "une", "que", "pour", "est",
    "el", "y", "los", "se", "las", "del", "por", "con",
)

_WRITTEN = sorted({form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())})


@dataclass(frozen=True)
class Rule:
    """Fails a text whose ``measure`` is below ``at_least`` or above ``at_most``; with ``per`` these are percent of that measure."""

    name: str
    measure: str
    per: str | None = None
    at_least: int | None = None
    at_most: int | None = None


#: What every text must pass before the others are asked.
BASE_RULES = (
    Rule("too_few_words", "n_words", at_least=20),
    Rule("repeated_words", "n_repeat_words", per="n_words", at_most=30),
)

RULES = (
    Rule("word_length", "word_chars", per="n_words", at_least=250, at_most=1200),
    Rule("symbols", "n_symbols", per="n_words", at_most=10),
    Rule("stop_words", "n_stop_words", per="n_words", at_least=4),
    Rule("letter_words", "n_letter_words", per="n_words", at_least=80),
    Rule("repeated_lines", "n_dup_lines", per="n_lines", at_most=30),
    Rule("bullet_lines", "n_bullet_lines", per="n_lines", at_most=90),
    Rule("cut_lines", "n_cut_lines", per="n_lines", at_most=30),
)


def rules_from(table: DataFrame) -> list[Rule]:
    """Rules of a table (name, measure, per, at_least, at_most), by name; rows without name or measure are ignored.

    At most ``MAX_RULES`` rows: they become one expression each.
    """
    rows = table.where("name is not null and measure is not null").orderBy("name").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return [Rule(r["name"], r["measure"], r["per"], r["at_least"], r["at_most"]) for r in rows]


# ------------------------------------------------------------------- measures

def _length(text: Column) -> Column:
    return F.length(text).cast("long")


def _count(items: Column, test) -> Column:
    return F.size(F.filter(items, test)).cast("long")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _window_hashes(hashes: Column) -> Column:
    """Hash of the WINDOW_WORDS words from each word on: of pairs, of pairs of pairs, and so on."""
    def doubled(hashes, span):
        return _let(hashes, lambda a: F.zip_with(a, F.slice(a, span + 1, F.size(a)), lambda x, y: F.xxhash64(x, y)))

    span = 1
    while span < WINDOW_WORDS:
        hashes, span = doubled(hashes, span), 2 * span
    return hashes


def _repeat_words(windows: Column) -> Column:
    """Words in windows that occur twice or more, from the windows' hashes in order of place."""
    starts = _let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda s: F.filter(
        s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
    count = F.aggregate(
        F.sort_array(F.transform(starts, lambda x: x["i"])),
        F.struct(F.lit(0).alias("words"), F.lit(0).alias("end")),
        lambda at, i: F.struct((at["words"] + WINDOW_WORDS - F.greatest(at["end"] - i, F.lit(0))).alias("words"),
                               (i + WINDOW_WORDS).alias("end")),
        lambda at: at["words"])
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), count).otherwise(0).cast("long")


MEASURES = {
    "n_words": lambda: F.size("__words").cast("long"),
    "word_chars": lambda: _length(F.concat_ws("", "__words")),
    "n_symbols": lambda: _length(F.regexp_replace("__text", NO_SYMBOLS, "")),
    "n_dup_lines": lambda: (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
    "n_repeat_words": lambda: _repeat_words(F.col("__windows")),
    "n_lines": lambda: F.size("__lines").cast("long"),
    "n_stop_words": lambda: _count(F.col("__words"), lambda w: w.isin(*_WRITTEN)),
    "n_letter_words": lambda: F.size("__words").cast("long") - F.regexp_count("__text", F.lit(LETTERLESS_WORD)),
    "n_bullet_lines": lambda: _count(F.col("__lines"), lambda x: F.ltrim(x).rlike("^[-*•‣]")),
    "n_cut_lines": lambda: _count(F.col("__lines"), lambda x: F.rtrim(x).rlike("(\\.\\.\\.|…)$")),
}


def _failed(rule: Rule) -> Column:
    value = F.col(rule.measure)
    scale, per = (100, F.col(rule.per)) if rule.per else (1, F.lit(1))
    bad = F.lit(False)
    if rule.at_least is not None:
        bad = bad | (value * scale < per * rule.at_least)
    if rule.at_most is not None:
        bad = bad | (value * scale > per * rule.at_most)
    return bad


# ------------------------------------------------------------------ operators

def judge(docs: DataFrame, rules=RULES, base_rules=BASE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the measures, base_failed, kept, failed_rules) for every row.

    Words are runs of characters other than ASCII white space; lines are cut
    at line feeds, and those without a word don't count.  A null, empty or
    wordless text has no words and fails by its number of words.  ``kept``
    says that no rule failed, ``failed_rules`` names those that did, in the
    table's order with commas between.  Rules compare ratios by multiplying,
    so a measure per nothing fails only by being below a bound of a positive
    measure.  Repeated rows stay repeated, null ids stay null, other columns
    are ignored, an empty table gives an empty result.
    """
    rules, base_rules = list(rules), list(base_rules)
    unknown = {m for r in rules + base_rules for m in (r.measure, r.per) if m is not None and m not in MEASURES}
    if unknown:
        raise ValueError(f"no such measures: {', '.join(sorted(unknown))}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.btrim(F.col("__text"), F.lit(WHITE))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("__text"))
    rows = rows.select(
        "doc_id", "__text",
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPLIT_AT)).alias("__words"),
        F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "").alias("__lines"))
    last = F.greatest(F.size("__words") - WINDOW_WORDS + 1, F.lit(0))
    rows = rows.select("*", F.slice(_window_hashes(F.transform("__words", lambda w: F.xxhash64(w))), F.lit(1), last).alias("__windows"))
    rows = rows.select("doc_id", *[make().alias(name) for name, make in MEASURES.items()])
    tests = {r.name: _failed(r) for r in base_rules + rules}
    base = F.lit(False)
    for r in base_rules:
        base = base | tests[r.name]
    any_rule = base
    for r in rules:
        any_rule = any_rule | tests[r.name]
    names = [F.when(test, F.lit(name)) for name, test in tests.items()]
    return rows.select("doc_id", *MEASURES, base.alias("base_failed"), (~any_rule).alias("kept"),
                       F.concat_ws(",", *names).alias("failed_rules"))


def keep_good(docs: DataFrame, rules=RULES, base_rules=BASE_RULES, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that no rule fails, all columns kept."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    judged = judge(docs.select(whole.alias("row"), F.col(text_col).alias("text")), rules, base_rules, id_col="row")
    return judged.where("kept").select("doc_id.*")
