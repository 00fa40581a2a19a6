"""SimHash groups against brute force over all pairs."""

import random
import re

import pyarrow.parquet as pq
import xxhash

from vigilspark.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, bits=3):
    """rows: (doc_id, text) -> {(doc_id, fingerprint, component)}"""
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", ids.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_query_matches_brute_force(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = sorted((tuple(r)[:3] for r in queries.op4_simhash(spark, SF).collect()), key=str)
    assert got == plain_groups([(d["doc_id"], d["text"]) for d in docs])


def test_nulls_ties_long_texts_and_extra_columns(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(300)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "x"), (6, "x"), (None, "one two"),
            (7, " ".join(words * 200)), (8, "a\x85b c\x1cd é É")]
    for i in range(40):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(300)] = rng.choice(words)
        rows.append((100 + i, " ".join(copy)))
    df = spark.createDataFrame([(d, t, 0, "z") for d, t in rows], "doc_id long, text string, fp long, component_id string")
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == plain_groups(rows)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    want = {c for d, _, c in plain_groups([r for r in rows if r[0] is not None])}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.drop_near_duplicates(df).count() == 0


def test_every_word_has_a_codeword_within_three():
    check, error, ring = simhash.golay()
    assert (error >= 0).all() and max(int(e).bit_count() for e in error) == 3
    assert ((ring[:, 1:] != 0).sum(axis=1) == [5 if int(e).bit_count() == 3 else 0 for e in error]).all()


def test_keys_meet_at_three_bits_or_fewer():
    import numpy as np
    rng = random.Random(9)

    def keys(x, side):
        fp = np.array([x], dtype=np.uint64).view(np.int64)
        return {int(k) for s, _, block in simhash.fuzzy_keys(fp) if s == side for k in block}

    for _ in range(300):
        a = b = rng.getrandbits(64)
        for _ in range(rng.randint(0, 3)):
            b ^= 1 << rng.randrange(64)
        assert keys(a, True) & keys(b, False) and keys(b, True) & keys(a, False)
