"""Encoders against the library's own encoding; token store and packing against plain versions."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from vigilspark.llm import attribution, packing, queries, token_store, tokens

SF = "/root/testdata/sf0.001"
ODD = ["a <|endoftext|> b<|startoftext|>c", "x y z　q\x1cq w", "é ́x", "don't 's 12345 ½Ⅷ",
       "Σας ΣΑΣ.", "", "\x85a b", "a̸ ≠", "  lead  two\n\n\nthree \n x", "\xa0 a \xa0b",
       "日本語 テ.\U0001f600 \U0001f600!", "\xdcn\xefcode \xc0\xc9, \xdf\xd7\xf1\xf7.", " ", " \n", "It's THE end...,! of&it"]


def texts():
    return pq.read_table(f"{SF}/documents.parquet", columns=["text"]).column(0).to_pylist()


@pytest.mark.parametrize("cls,path", [(tokens.WordEncoder, tokens.word_bpe_path()), (tokens.ByteEncoder, tokens.byte_bpe_path())])
def test_ids_are_the_librarys(cls, path, monkeypatch):
    plain = tokens.load_tokenizer(path)
    want = [e.ids for e in plain.encode_batch(texts() + ODD, add_special_tokens=False)]
    encoder = cls(path)
    assert [x.tolist() for x in encoder.encode(texts() + ODD)] == want
    monkeypatch.setattr(tokens, "MEMORY_WORDS", 50)  # words are forgotten and learned again
    monkeypatch.setattr(tokens, "CHUNK_CHARS", 1000)
    assert [x.tolist() for x in encoder.encode(texts() + ODD)] == want
    assert [len(x) for x in encoder.encode([None, ""])] == [0, 0]


def test_spans_are_the_librarys_offsets():
    path = tokens.byte_bpe_path()
    encoder, plain = tokens.ByteEncoder(path), tokens.load_tokenizer(path)
    for text in [t for t in texts()[:40] + ODD if t]:
        spans = attribution.token_spans(text, encoder.encode([text])[0], encoder.width)
        assert [tuple(s) for s in spans.tolist()] == plain.encode(text, add_special_tokens=False).offsets


def test_fetch_by_id_equals_encoding(spark, tmpdir_path):
    """Every document whose id is divisible by 10, over many small shards, with null, repeated and unknown ids."""
    rows = [(i, f"short text {i} " * (i % 7)) for i in range(600)] + [(50, "another of 50"), (None, "no id"), (700, None)]
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmpdir_path}/f", shard_bytes=500)
    asked = spark.createDataFrame([(i,) for i in range(0, 1000, 10)] + [(50,), (None,), (-1,)], "k long")
    got = Counter((r.doc_id, tuple(r.ids)) for r in token_store.fetch(spark, f"{tmpdir_path}/f", asked, "k").collect())
    tok = tokens.load_tokenizer(tokens.word_bpe_path())
    want = Counter((i, (*tok.encode(t or "", add_special_tokens=False).ids, token_store.END_ID)) for i, t in rows if i is not None and i % 10 == 0)
    assert got == want


# ---------------------------------------------------------------- token store

def plain_store(rows, end=2):
    tok = tokens.load_tokenizer(tokens.word_bpe_path())
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_store_round_trip(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = sorted(tuple(r) for r in queries.op2_token_store(spark, SF).collect())
    assert got == plain_store([(d["doc_id"], d["text"]) for d in docs])


def test_store_of_odd_rows(spark, tmpdir_path):
    rows = [(3, None), (1, ""), (None, "no id"), (7, "word " * 30_000), (9, "same"), (9, "same"), (2, "a\n b")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, part int, tokens string")
    token_store.write_store(df, f"{tmpdir_path}/s", shard_bytes=64)
    got = sorted((tuple(r) for r in token_store.read_store(spark, f"{tmpdir_path}/s").collect()), key=lambda r: r[1])
    assert got == plain_store(rows)
    found = token_store.fetch(spark, f"{tmpdir_path}/s", spark.createDataFrame([(2,), (3,), (4,)], "doc_id long")).collect()
    plain = tokens.load_tokenizer(tokens.word_bpe_path())
    assert {r.doc_id: r.ids for r in found} == {2: plain.encode("a\n b").ids + [2], 3: [2]}
    empty = df.where("false")
    token_store.write_store(empty, f"{tmpdir_path}/e")
    assert token_store.read_store(spark, f"{tmpdir_path}/e").count() == 0


def test_store_refuses_another_dictionary(spark, tmpdir_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string")
    token_store.write_store(df, f"{tmpdir_path}/s")
    spark.createDataFrame([("0" * 64, bytearray(b"x"))], "hash string, bytes binary").write.mode("overwrite").parquet(f"{tmpdir_path}/s/dictionary")
    with pytest.raises(ValueError):
        token_store.read_store(spark, f"{tmpdir_path}/s")


# -------------------------------------------------------------------- packing

def fewest(items, capacity):
    best, items = [len(items)], sorted(items, reverse=True)

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in sorted(set(rooms)):
            if k >= items[i]:
                less = list(rooms)
                less.remove(k)
                go(i + 1, less + [k - items[i]])
        go(i + 1, rooms + [capacity - items[i]])

    go(0, [])
    return best[0]


def layout(made):
    bins, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, sequence, offset in made.slots:
        ranks[length] += range(rank, rank + n)
        for i in range(n):
            bins[sequence + i].append((offset, length))
    return bins, ranks


def test_plans_hold_everything_once_and_reach_the_optimum():
    rng = random.Random(4)
    for _ in range(150):
        items = [rng.randint(1, 20) for _ in range(rng.randint(0, 8))]
        made = packing.plan(Counter(items), 20)
        bins, ranks = layout(made)
        assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(c)) for x, c in Counter(items).items()}
        for slots in bins.values():
            at = 0
            for offset, length in sorted(slots):
                assert offset == at
                at += length
            assert at <= 20
        best = fewest(items, 20)
        assert made.lower_bound <= best <= made.sequences == len(bins)
        assert made.sequences - best <= 1


def test_reduction_fixes_what_dominates():
    assert packing.plan({10: 3, 7: 2, 3: 5, 20: 1}, 20).fixed == 2  # the full piece, and the pair of tens
    made = packing.plan({4096: 10**9, 4000: 10**8, 96: 10**8, 5: 10**10}, 4096)
    assert made.sequences == 10**9 + 10**8 + -(-10**10 // 819)
    assert len(made.slots) < 2000


def test_reduction_never_costs_a_sequence():
    """What is fixed, and the best packing of the rest, take as few sequences as the best packing of all; triples are among it."""
    rng, triples = random.Random(9), 0
    for _ in range(400):
        low = rng.choice([1, 4, 6])
        items = [rng.randint(low, 20) for _ in range(rng.randint(3, 9))]
        planner = packing._Planner(Counter(items), 24)
        planner.reduce()
        rest = [x for x, c in planner.left.items() for _ in range(c)]
        assert planner.plan.sequences == planner.plan.fixed
        assert planner.plan.fixed + fewest(rest, 24) == fewest(items, 24), items
        triples += sum(len(slots) == 3 for slots in layout(planner.plan)[0].values())
    assert triples > 20


def check_pack(rows, got, end=1, capacity=4096):
    tok = tokens.load_tokenizer(tokens.word_bpe_path())
    want = Counter()
    for doc_id, text in rows:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")
        for piece, a in enumerate(range(0, len(ids), capacity)):
            own = ids[a:a + capacity]
            want[(doc_id, piece, a, len(own), zlib.crc32(own.tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for slots in bins.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pack_query(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = queries.op8_best_fit_packing(spark, SF).collect()
    bins = check_pack([(d["doc_id"], d["text"]) for d in docs], got)
    assert bins <= -(-sum(r.length for r in got) // 4096) + 1


def test_pack_of_odd_rows(spark):
    rows = [(3, None), (1, ""), (None, "no id"), (7, "word " * 30_000), (9, "same"), (9, "same")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, length string")
    check_pack(rows, packing.pack(df).collect())
    assert packing.pack(df.where("false")).count() == 0


# ---------------------------------------------------------------- attribution

def plain_sections(text, rule):
    if not text:
        return {0: 0}, 0
    enc = tokens.load_tokenizer(tokens.byte_bpe_path()).encode(text, add_special_tokens=False)
    owner, k = [], 0
    for i, c in enumerate(text):
        owner.append(k)
        k += c == "\n" or (c == " " and i > 0 and text[i - 1] in ".!?")
    n = Counter(dict.fromkeys(owner, 0))
    for a, b in enc.offsets:
        held = Counter(owner[a:b])
        n[owner[a] if rule == "first" else max(held, key=lambda s: (held[s], -s))] += 1
    return dict(n), len(enc.ids)


def test_sections_against_characters(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()[:60]
    rows = [(d["doc_id"], d["text"]) for d in docs] + [(10_000 + i, t) for i, t in enumerate(ODD + [None])]
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, section int")
    for rule in attribution.RULES:
        got = defaultdict(dict)
        total = {}
        for r in attribution.count_sections(df, rule=rule).collect():
            got[r.doc_id][r.section] = r.n_tokens
            total[r.doc_id] = r.doc_tokens
        for doc_id, text in rows:
            want, n = plain_sections(text, rule)
            assert got[doc_id] == want and total[doc_id] == n == sum(got[doc_id].values())


def test_query_counts_every_token(spark):
    got = queries.op7_token_attribution(spark, SF).groupBy("doc_id").agg({"n_tokens": "sum", "doc_tokens": "max"}).collect()
    plain = tokens.load_tokenizer(tokens.byte_bpe_path())
    docs = {d["doc_id"]: d["text"] for d in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    assert {r.doc_id: r["sum(n_tokens)"] for r in got} == {d: len(plain.encode(t or "", add_special_tokens=False).ids) for d, t in docs.items()}


def test_spans_with_gaps_and_long_tokens():
    sections = np.array([[0, 3], [5, 6], [6, 9]])
    section, crosses = attribution.join_spans(np.array([[0, 2], [2, 5], [5, 9], [9, 11]]), sections)
    assert section.tolist() == [0, -1, 2, -1] and crosses.tolist() == [False, True, True, False]
    section, _ = attribution.join_spans(np.array([[0, 2], [2, 5], [5, 9], [9, 11]]), sections, "first")
    assert section.tolist() == [0, 0, 1, -1]


def test_fields(spark):
    df = spark.createDataFrame([(1, "One two.", None, "three"), (2, None, None, None)], "k long, a string, b string, c string")
    got = {(r.doc_id, r.section): r.n_tokens for r in attribution.count_fields(df, ["a", "b", "c"], "k").collect()}
    plain = tokens.load_tokenizer(tokens.byte_bpe_path())
    assert sum(n for (d, _), n in got.items() if d == 1) == len(plain.encode("One two.\n\nthree").ids)
    assert got[(1, 0)] == 3 and got[(1, 2)] >= 1 and (1, 1) not in got


def test_fields_of_odd_rows(spark):
    long = "word " * 50_000
    df = spark.createDataFrame([(1, "a\x00b", "\x00"), (None, None, None), (2, long, "x"), (2, long, "x"), (3, "", "y")], "k long, a string, doc_id string")
    got = attribution.count_fields(df, ["a", "doc_id"], "k").collect()
    plain = tokens.load_tokenizer(tokens.byte_bpe_path())
    want = Counter()
    for r in df.collect():
        want[r.k] += len(plain.encode(f"{r.a or ''}\n{r.doc_id or ''}", add_special_tokens=False).ids)
    total = Counter()
    for r in got:
        total[r.doc_id] += r.n_tokens
    assert total == want and {r.section for r in got if r.doc_id == 3} <= {-1, 1}
    assert attribution.count_fields(df.where("false"), ["a"], "k").count() == 0


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert attribution.count_sections(df).count() == 0
