"""F2 and F3 for rules that are a table: an Aho-Corasick automaton over each line.

A few configured keywords are best tested one by one inside code generation
(``match.keyword_hits``); thousands of rules are not.  Here all keywords and
exclusion phrases of a block of rules make one automaton, which reads every
line once.  It is broadcast, so a block holds at most ``BLOCK_BYTES`` of rules;
larger tables are taken in blocks, each a scan of the lines.  Both sides are
lower-cased by Spark, so matches are those of ``contains(lower(raw), keyword)``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.session import materialize

BLOCK_BYTES = 8_000_000


def rule_blocks(rules: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list]:
    """(keyword, exclusions) of ``rules`` in blocks of about ``block_bytes``, one on the driver at a time.

    Keywords and exclusions are trimmed and lower-cased; empty ones are
    ignored.  A keyword listed several times has all of its exclusions.
    """
    clean = lambda c: F.nullif(F.trim(F.lower(F.col(c))), F.lit(""))
    listed = rules.select(clean("keyword").alias("keyword"), clean("exclusion").alias("exclusion")).where("keyword is not null")
    listed = materialize(listed.groupBy("keyword").agg(F.collect_set("exclusion").alias("exclusions")))
    size = listed.agg(F.sum(F.length("keyword") + F.length(F.concat_ws("", "exclusions")))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    for block in range(n):
        rows = listed.where(F.pmod(F.xxhash64("keyword"), F.lit(n)) == block).orderBy("keyword").collect()
        if rows:
            yield [(r["keyword"], tuple(sorted(r["exclusions"]))) for r in rows]


def automaton(block: list):
    """(automaton whose values are phrase numbers, phrase number -> keyword numbers, keyword number -> exclusion numbers)."""
    found, number, of = ahocorasick.Automaton(), {}, {}
    barred = []
    for i, (keyword, exclusions) in enumerate(block):
        of[number.setdefault(keyword, len(number))] = i
        barred.append(frozenset(number.setdefault(x, len(number)) for x in exclusions))
    for phrase, n in number.items():
        found.add_word(phrase, n)
    found.make_automaton()
    return found, of, barred


def table_hits(entries: DataFrame, rules: DataFrame, keep=None, raw_col: str = "raw", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per (entry, keyword of ``rules`` in its line): F2 + F3.

    ``rules`` has keyword and exclusion (null where there is none).  A keyword
    counts once a line; it is dropped where the line holds one of its
    exclusions.  Null lines match nothing.  ``keep`` lists the entry columns
    to carry (default: all).
    """
    keep = list(keep) if keep is not None else entries.columns
    spark, parts = entries.sparkSession, []
    low = entries.select(*keep, F.lower(F.col(raw_col)).alias("_low"))
    for block in rule_blocks(rules, block_bytes):
        parts.append(low.select(*keep, F.explode(_matcher(spark.sparkContext.broadcast(block))("_low")).alias("keyword")))
    if not parts:
        return low.select(*keep, F.lit("").alias("keyword")).limit(0)
    return reduce(DataFrame.unionByName, parts)


def _matcher(shared):
    @F.pandas_udf("array<string>")
    def matched(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
        block = shared.value
        find, of, barred = automaton(block)

        def keywords(line):
            if line is None:
                return []
            met = {n for _, n in find.iter(line)}
            return [block[of[n]][0] for n in sorted(met) if n in of and barred[of[n]].isdisjoint(met)]

        for batch in lines:
            yield pd.Series([keywords(x) for x in batch], dtype=object)

    return matched
