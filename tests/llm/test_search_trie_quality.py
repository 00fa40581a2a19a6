"""Term scan, conversation trie and quality rules: against DuckDB, and against plain versions on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from vigilspark.llm import conversation_trie, quality, queries, term_scan

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_prefix_trie", "op13_quality_rules"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    got = queries.QUERIES[name](spark, SF)
    assert got.columns == columns
    assert sorted(map(str, cursor.fetchall())) == sorted(str(tuple(r)) for r in got.collect())


# ------------------------------------------------------------------ term scan

def plain_search(docs, items, top=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(cut(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, length = len(held), sum(n for _, _, n in held)
    wanted, out = defaultdict(set), []
    for i, t in items:
        wanted[i] |= set(cut(t))
    df = Counter(t for _, c, _ in held for t in c)
    for item, terms in wanted.items():
        scores = []
        for d, c, n in held:
            m = 100 - 90 + 90 * n * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in terms if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def search_rows(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 9, 1) for i, t in docs], "doc_id long, text string, n int, rank int").repartition(3)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, score int")
    return sorted((tuple(r) for r in term_scan.search(d, q, **more).collect()), key=str)


ODD_DOCS = [(1, None), (2, ""), (3, "--- !!"), (4, "Alpha beta"), (5, "alpha BETA"), (5, "alpha BETA"), (None, "alpha beta"),
            (6, "alphabet alpha-beta_alpha"), (7, "x" * 100_000), (8, "é É\x85ß 7 7 7"), (9, "a " * 60_000), (10, "\x00alpha\x00"), (11, "日本 alpha")]
ODD_ITEMS = [(1, "alpha beta"), (2, None), (3, ""), (4, "É 7 ß"), (5, "Alpha"), (5, "gamma a"), (None, "日本"), (6, "x" * 100_000), (7, "...")]


def test_search_of_odd_rows(spark):
    assert search_rows(spark, ODD_DOCS, ODD_ITEMS) == plain_search(ODD_DOCS, ODD_ITEMS)


def test_search_ties_go_to_the_smaller_id_across_tasks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(term_scan, "BLOCK_BYTES", 40)
    rng = random.Random(3)
    words = [f"t{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 3, 8])))) for i in range(300)]
    items = [(i, " ".join(rng.sample(words, 5))) for i in range(12)]
    assert search_rows(spark, docs, items) == plain_search(docs, items)
    assert search_rows(spark, docs, items, top=3) == plain_search(docs, items, 3)


def test_search_in_small_chunks(monkeypatch):
    monkeypatch.setattr(term_scan, "CHUNK_CELLS", 7)
    hits = np.array([5, 900_000, 200_000, 1, 1, 1, 1, 1])
    parts = list(term_scan._chunks(hits, 2))
    assert [a for a, _ in parts] == [0] + [b for _, b in parts][:-1] and parts[-1][1] == len(hits)
    assert all(b - a <= 3 and (b - a == 1 or hits[a:b].sum() <= term_scan.CHUNK_HITS) for a, b in parts)


def test_search_of_empty_tables(spark):
    assert search_rows(spark, [], ODD_ITEMS) == [] and search_rows(spark, ODD_DOCS, []) == []
    assert search_rows(spark, [(1, None)], ODD_ITEMS) == []


# ----------------------------------------------------------------------- trie

def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in own.items()}
    members, ended = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ended[tuple(path)].append(c)
    out = []
    for node, convs in members.items():
        under = [n for n in members if n[:len(node)] == node]
        kids = lambda n: [k for k in members if len(k) == len(n) + 1 and k[:-1] == n]
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids(node)),
                    sum(not kids(n) for n in under), sum((len(members[n]) - 1) * len(n[-1][1]) for n in under if n),
                    hashlib.sha256(",".join(map(str, sorted(ended[node]))).encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(spark, rows, **more):
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, a string")
    return sorted((tuple(r) for r in conversation_trie.node_table(df.repartition(3), **more).collect()), key=str)


ODD_TURNS = [(None, 0, "user", "lost"), (0, 0, "user", "hi"), (0, 1, None, None), (0, 1, "user", ""), (0, 1, "user", ""), (0, None, "user", "first"),
             (1, 0, "user", "hi"), (1, 5, "bot", "é😀" * 3), (2, 0, "user", "hi"), (100, 0, "us", "erhi"), (101, 0, "user", "hi"),
             (205, 3, "user", "no base"), (-5, 0, "user", "hi"), (-105, 0, "user", "hi")] + [(7, i, "user", f"turn {i % 3}") for i in range(30)]


def test_trie_of_odd_rows(spark):
    assert trie_rows(spark, ODD_TURNS) == plain_trie(ODD_TURNS)


def test_trie_with_heavy_nodes_and_many_shards(spark):
    rng = random.Random(11)
    rows = [(c, t, rng.choice("ub"), rng.choice(["yes", "no", "maybe"])) for c in range(120) for t in range(rng.randint(1, 7))]
    rows += [(1000 + c, t, "u", "the same") for c in range(60) for t in range(3)]
    want = plain_trie(rows)
    assert trie_rows(spark, rows, light_owners=2, shard_nodes=10) == want
    assert trie_rows(spark, rows) == want


def test_one_long_conversation_is_split_and_summed(spark):
    rows = spark.createDataFrame([(1, i, 2 * i + 1) for i in range(5000)] + [(0, 0, 3), (2, 0, 4), (2, 1, 6)], "k long, at long, v long")
    got = conversation_trie.prefix_sums(rows.repartition(4), "k", "at", ("v",))
    assert got.where("k = 1").where("sum_v <> (at + 1) * (at + 1)").count() == 0
    assert sorted(tuple(r) for r in got.where("k <> 1").select("k", "at", "sum_v").collect()) == [(0, 0, 3), (2, 0, 4), (2, 1, 10)]
    assert got.count() == 5003


def test_trie_of_an_empty_table(spark):
    assert trie_rows(spark, []) == [] and trie_rows(spark, [(None, 1, "user", "x")]) == []


def test_perfect_hash_is_minimal_and_verifies():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-2 ** 62, 2 ** 62, (2, 5000))
    a[:50] = 7  # equal halves
    table = conversation_trie.PerfectHash(a, b)
    assert sorted(table.slots(a, b).tolist()) == list(range(5000)) and (table.slots(a, b) == table.place).all()
    assert (table.slots(b, a) == -1).all()
    empty = conversation_trie.PerfectHash(a[:0], b[:0])
    assert (empty.slots(a, b) == -1).all()
    with pytest.raises(ValueError):
        conversation_trie.PerfectHash(np.array([1, 1]), np.array([2, 2]))


def test_ids_of_a_large_end_are_hashed_in_order(spark):
    ids = list(range(0, 40_000, 7))
    df = spark.createDataFrame([(1, 2, i) for i in ids] + [(1, 3, 5)], "a long, b long, conv_id long").repartition(5)
    got = {(r.a, r.b): r.ends_sha256 for r in conversation_trie.ends_digest(df).collect()}
    assert got == {(1, 2): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (1, 3): hashlib.sha256(b"5").hexdigest()}


# -------------------------------------------------------------------- quality

def plain_measures(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i:i + 8])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


ODD_TEXTS = [None, "", " \t\n\x0b\x0c\r ", "one", "\n\na\n a\na\n\x0b\n", "#*$%&|<>" * 3, "é ß\x85 x y 😀", "the of and " * 9, "As " * 500,
             "a b c d e f g h " * 2 + "x", " ".join(f"w{i}" for i in range(70_000)) + " " + " ".join(f"w{i}" for i in range(9, 40)),
             "A b c d e f g h a b c d e f g h", "• x\n- y\n* z\nwait...\nwell…\n" * 4]


def test_measures_of_odd_texts(spark):
    rows = [(i, t, "z", 4) for i, t in enumerate(ODD_TEXTS)] + [(None, "x y", "z", 4), (3, "one", "z", 4)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int"))
    measured = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect()]
    assert sorted(measured, key=str) == sorted(((i, *plain_measures(t)) for i, t, _, _ in rows), key=str)
    for r in got.collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (r.failed_rules == "") and not (r.kept and r.base_failed)


def test_repeats_against_plain_counting(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    got = quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_repeat_words for r in got} == {i: plain_measures(t)[4] for i, t in enumerate(texts)}


def test_rules_are_a_table_and_compare_exactly(spark):
    table = spark.createDataFrame([("b", "n_symbols", "n_words", None, 50), ("a", "n_words", None, 2, 4), (None, "n_words", None, 1, 1)],
                                  "name string, measure string, per string, at_least int, at_most int")
    rules = quality.rules_from(table)
    assert [r.name for r in rules] == ["a", "b"]
    docs = spark.createDataFrame([(1, "x # y z"), (2, "## ##"), (3, "x"), (4, "| x"), (5, "a b c d e")], "doc_id long, text string")
    got = {r.doc_id: r.failed_rules for r in quality.judge(docs, rules, ()).collect()}
    assert got == {1: "", 2: "b", 3: "a", 4: "", 5: "a"}
    with pytest.raises(ValueError):
        quality.judge(docs, [quality.Rule("x", "n_pages", at_least=1)])


def test_kept_rows_keep_their_columns_and_no_python_runs(spark):
    text = "the cat and the dog went to a house in the wood , it was " + " ".join(f"place{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text, 5, "k"), (2, "too short", 6, "k"), (None, text, 7, "k")], "doc_id long, text string, row int, `kept.x` string")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.row for r in kept.collect()) == [5, 7]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan
    assert quality.judge(docs.limit(0)).count() == 0
