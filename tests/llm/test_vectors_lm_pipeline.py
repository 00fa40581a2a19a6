"""Vector join, class language model and the pipeline against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tests.llm.test_filters import plain_contamination
from tests.llm.test_simhash import plain_groups
from tests.llm.test_tokens_store_packing import check_pack
from vigilspark.llm import classlm, decontamination, embedding_join, langid, queries, simhash, toxicity
from vigilspark.llm.components import components

SF = "/root/testdata/sf0.001"
SF_LARGER = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- vector join

def plain_vectors(rows, least=0.98):
    """rows: (vec_id, vector, label) -> sorted (vec_id, n_links, component, kept)"""
    unit = []
    for vec_id, v, label in rows:
        ok = vec_id is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) if ok else None)
    links = [[j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2]
              and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= least] for i in range(len(rows))]
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((vec_id, len(links[i]), low, vec_id is not None and vec_id == low))
    return sorted(out, key=str)


def test_vector_query_against_plain(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    assert sorted((tuple(r) for r in queries.op5_embedding_join(spark, SF).collect()), key=str) == plain_vectors(rows)


def test_vectors_in_many_blocks(spark):
    rng = np.random.default_rng(6)
    rows = []
    for c in range(12):
        centre = rng.normal(size=8)
        for k in range(25):
            rows.append((len(rows), (centre + rng.normal(size=8) * rng.choice([0.02, 0.1, 0.3])).astype(np.float32).tolist(), c % 3))
    rows += [(len(rows) + k, rows[k % 2][1], rows[k % 2][2]) for k in range(30)]
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 8, 1), (503, [float("nan")] + [1.0] * 7, 1), (504, [float("inf")] + [1.0] * 7, 1),
             (505, [None] + [1.0] * 7, 1), (506, rows[0][1], None), (None, rows[0][1], 0), (507, rows[0][1][:4], 0), (508, rows[0][1][:4], 0),
             (509, [x * 3 for x in rows[0][1]], 0), (509, [x * 3 for x in rows[0][1]], 0)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, uid int, unit string")
    for size in (7, 1024):
        got = sorted((tuple(r) for r in embedding_join.near_duplicates(df, block_rows=size).collect()), key=str)
        assert got == plain_vectors(rows)
    assert embedding_join.near_duplicates(df.where("false")).count() == 0


def test_sequence_join_skips_nothing():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    x = x[np.lexsort(np.floor(x / 0.2).T[::-1])]
    eps = math.sqrt(2 - 2 * 0.98) + embedding_join.SLACK
    i, j = embedding_join.sequence_join(x, x[:, :3], x, x[:, :3], eps, 0.98)
    assert {*zip(i.tolist(), j.tolist())} == {*zip(*(a.tolist() for a in np.nonzero(x @ x.T >= 0.98)))}


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100), (None, 3), (200, 201), (201, 200), (60, 40)]
    got = components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert {r.node: r.root for r in got} == {**dict.fromkeys([*range(41), 60], 0), 200: 200, 201: 200}
    assert len(got) == 44


# -------------------------------------------------------------- language model

def test_counts_and_base_score_against_plain(spark):
    rows = {d["doc_id"]: (d["text"] or "").encode().lower().split() + [None] for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in rows}
    c = Counter(w for d, ws in rows.items() if not out[d] for w in ws)
    n, v = sum(c.values()), len(c)
    got = queries.op3_class_lm(spark, SF).collect()
    assert {r.doc_id for r in got} == set(rows) and len(got) == len(rows)
    for r in got:
        ws = rows[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_numbered_and_joined_words_score_alike(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    monkeypatch.setattr(classlm, "FIRST_WORDS", 40)
    numbered = {r.doc_id: r for r in classlm.score(df, classes=8, sweeps=2).collect()}
    monkeypatch.setattr(classlm, "LOOKUP_WORDS", 300)
    monkeypatch.setattr(classlm, "HOT_TOKENS", 50)
    for r in classlm.score(df, classes=8, sweeps=2).collect():
        other = numbered[r.doc_id]
        assert r.n_known == other.n_known
        assert r.base_score == pytest.approx(other.base_score) and r.score == pytest.approx(other.score)


@pytest.mark.parametrize("numbered", [1 << 22, 2])
def test_the_model_is_a_distribution(spark, monkeypatch, numbered):
    monkeypatch.setattr(classlm, "FIRST_WORDS", 2)
    monkeypatch.setattr(classlm, "LOOKUP_WORDS", numbered)
    texts = spark.createDataFrame([("a b a b a c",), ("a b d",), ("b a b e ffffffff",)], "text string")
    model, rare = classlm.fit(texts, classes=3, sweeps=3)
    assert np.allclose((10.0 ** model.transition).sum(axis=1), 1)
    assert (rare is None) == (numbered > 2)
    count, cls = model.lookup.count, model.cls
    emitted = 10.0 ** model.emission
    if rare is not None:
        more = rare.toPandas()
        assert len(more) + len(count) == 7  # a b c d e ffffffff and END
        cls = np.append(cls, more["c"])
        emitted = np.append(emitted, 10.0 ** model.emitted(more["n"].to_numpy(), more["c"].to_numpy()))
    for c in set(cls.tolist()):
        assert emitted[cls == c].sum() + model.share[:, c].sum() == pytest.approx(1)


@pytest.mark.parametrize("numbered", [1 << 22, 9])
def test_scores_are_those_of_a_plain_class_bigram(spark, monkeypatch, numbered):
    """Scores worked out from the fitted classes and plain counts."""
    monkeypatch.setattr(classlm, "FIRST_WORDS", 5)
    monkeypatch.setattr(classlm, "LOOKUP_WORDS", numbered)
    rng = np.random.default_rng(12)
    texts = {i: " ".join(f"w{min(int(x), 30)}" for x in rng.geometric(0.15, rng.integers(0, 12))) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    train = [t.split() for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    model, rare = classlm.fit(df.where("crc32(cast(doc_id as string)) % 7 <> 2"), classes=4, sweeps=3)
    keys = classlm._Keys()
    more = {} if rare is None else {r.code: r.c for r in rare.collect()}
    of = lambda key: int(model.cls[c]) if (c := int(model.lookup.codes(np.array([key], dtype=np.int64))[0])) >= 0 else more.get(c)
    cls = {w: of(keys[w.encode()]) for t in train for w in t}
    cls[None] = of(classlm.END)
    seqs = [[None, *t, None] for t in train]
    n = Counter(w for s in seqs for w in s[1:])
    pair = Counter((cls[a], cls[b]) for s in seqs for a, b in zip(s, s[1:]))
    k, members = 4, Counter(cls[w] for w in n)
    shape = {w: classlm.shape_of(w.encode()) for w in n if w is not None}
    types = Counter(shape.values())
    unseen_in = model.share.sum(axis=0) > 0
    total = sum(pair.values()) + sum(members[c] + unseen_in[c] for c in range(k))

    def step(a, b):
        kinds = max(1, sum(pair[a, c] > 0 for c in range(k)))
        prior = (sum(pair[c, b] for c in range(k)) + members[b] + unseen_in[b]) / total
        return (pair[a, b] + kinds * prior) / (sum(pair[a, c] for c in range(k)) + kinds)

    tokens = Counter()
    for w, m in n.items():
        tokens[cls[w]] += m
    off = [classlm.DISCOUNT if unseen_in[c] else 0 for c in range(k)]
    for r in classlm.score(df, classes=4, sweeps=3).collect():
        words, want, before = [*texts[r.doc_id].split(), None], 0.0, [float(c == cls[None]) for c in range(k)]
        for w in words:
            if w in n:
                want += math.log10(sum(before[c] * step(c, cls[w]) for c in range(k)) * (n[w] - off[cls[w]]) / tokens[cls[w]])
                before = [float(c == cls[w]) for c in range(k)]
            else:
                s = classlm.shape_of(w.encode())
                want += math.log10(sum(before[a] * step(a, c) * model.share[s, c] for a in range(k) for c in range(k)) / (types[s] + 1))
                once = [sum(shape[x] == s and cls[x] == c and n[x] == 1 for x in shape) for c in range(k)]
                held = once if any(once) else [sum(shape[x] == s and cls[x] == c for x in shape) for c in range(k)]
                if not any(held):
                    break  # a shape that training never saw has the class of its start
                before = [x / sum(held) for x in held]
        else:
            assert r.score == pytest.approx(want, abs=0.02 * len(words))


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(5)
    groups, items = 3, 24
    member = np.arange(items) % groups
    chance = np.array([[.1, .8, .1], [.1, .1, .8], [.8, .1, .1]])
    pair = np.zeros((items, items))
    state = 0
    for _ in range(20000):
        to = rng.choice(items, p=np.where(member == (g := rng.choice(groups, p=chance[member[state]])), 1, 0) / (member == g).sum())
        pair[state, to] += 1
        state = to

    def likelihood(cls):
        one = np.eye(groups)[cls]
        table = one.T @ pair @ one
        return classlm._xlogx(table).sum() - classlm._xlogx(table.sum(0)).sum() - classlm._xlogx(table.sum(1)).sum()

    cls = rng.integers(0, groups, items)
    values = [likelihood(cls)]
    for _ in range(8):
        one = np.eye(groups)[cls]
        classlm._exchange(pair.T @ one, pair @ one, np.diag(pair).copy(), cls, np.argsort(-pair.sum(axis=1)))
        values.append(likelihood(cls))
    assert values[-1] > values[0] and values[-1] >= 0.95 * likelihood(member) if likelihood(member) > 0 else values[-1] >= likelihood(member) * 1.05


def test_every_word_has_a_class_of_its_own(spark, monkeypatch):
    """Rare words of one shape that stand at different places end in different classes."""
    monkeypatch.setattr(classlm, "FIRST_WORDS", 2)
    rng = np.random.default_rng(4)
    rows = [(" ".join(w for _ in range(8) for w in ("the", f"n{rng.integers(100, 300)}x", "will", f"v{rng.integers(100, 300)}x")),) for _ in range(150)]
    model, rare = classlm.fit(spark.createDataFrame(rows, "text string"), classes=5)
    assert rare is None and len(model.lookup) == len({w for t, in rows for w in t.split()}) + 1
    number = dict(zip(model.lookup.keys.tolist(), model.lookup.number.tolist()))
    got = {key: int(model.cls[i]) for key, i in number.items()}
    keys = classlm._Keys()
    of = {kind: Counter(got[keys[f"{kind}{i}x".encode()]] for i in range(100, 300) if keys[f"{kind}{i}x".encode()] in got) for kind in "nv"}
    tops = {kind: c.most_common(1)[0] for kind, c in of.items()}
    assert tops["n"][0] != tops["v"][0] and all(tops[k][1] >= 0.9 * sum(of[k].values()) for k in "nv")


@pytest.mark.parametrize("numbered", [1 << 22, 6])
def test_neighbours_are_a_packed_row_for_a_bucket(spark, monkeypatch, numbered):
    """Few rows however many pairs, and all pairs in them, those of hot and of unnumbered words too."""
    monkeypatch.setattr(classlm, "LOOKUP_WORDS", numbered)
    monkeypatch.setattr(classlm, "HOT_TOKENS", 100)
    rng = np.random.default_rng(3)
    texts = [[f"w{int(x)}" for x in rng.geometric(0.03, 40)] for _ in range(60)]
    df = spark.createDataFrame([(" ".join(t),) for t in texts], "text string")
    lookup = classlm._lookup(classlm.word_counts(df))
    near = classlm.neighbours(df, spark.sparkContext.broadcast(lookup), 60 * 41)
    rows = near.collect()
    assert len(rows) <= classlm.LEAST_BUCKETS
    keys = classlm._Keys()
    code = lambda w: int(lookup.codes(np.array([classlm.END if w is None else keys[w.encode()]], dtype=np.int64))[0])
    want = Counter()
    for t in texts:
        for a, b in zip([None, *t], [*t, None]):
            want[code(a), code(b), True] += 1
            want[code(b), code(a), False] += 1
    got = Counter()
    for r in rows:
        x = {n: classlm._unpacked(r[n], kind) for n, kind in classlm.KINDS.items()}
        for side in ("before", "after"):
            for w, o, n in zip(np.repeat(x["words"], x[f"n_{side}"]).tolist(), x[f"o_{side}"].tolist(), x[f"t_{side}"].tolist()):
                got[w, o, side == "after"] += n
        for at, o, after, n in zip(x["far_at"], x["far_o"].tolist(), x["far_after"].tolist(), x["far_t"].tolist()):
            got[int(x["words"][at]), o, after] += n
    assert got == want and (numbered == 6) == any(o < 0 for _, o, _ in got)


def test_best_class_is_that_of_the_full_likelihood():
    rng = np.random.default_rng(6)
    pair, cls = rng.poisson(0.7, (14, 14)).astype(float), rng.integers(0, 4, 14)
    one = np.eye(4)[cls]
    got = classlm._best(pair.T @ one, pair @ one, np.diag(pair).copy(), cls, one.T @ pair @ one)
    for scale in (1, 5):
        sides = (scale * pair.T @ one, scale * pair @ one, scale * np.diag(pair), cls, scale * one.T @ pair @ one)
        assert (classlm._best_of_many(*sides) == classlm._best(*sides)).all()
    for w in range(14):
        values = [classlm._likelihood(np.eye(4)[x].T @ pair @ np.eye(4)[x]) for x in (np.where(np.arange(14) == w, k, cls) for k in range(4))]
        assert values[got[w]] == pytest.approx(max(values))


def test_scores_of_odd_rows(spark):
    rows = [(0, "a b c"), (1, None), (2, ""), (3, " \n"), (None, "a b"), (4, "A B é"), (4, "A B é"), (5, "long " * 60_000), (23, "zzz a")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n long, score string")
    got = classlm.score(df, classes=4, sweeps=1).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 1 and by[None].held_out is False
    assert classlm.score(df.where("false")).count() == 0
    only = classlm.score(df.where("doc_id is null"), classes=4).collect()
    assert only[0].train_tokens == 0 and only[0].n_known == 0 and math.isfinite(only[0].score)


# -------------------------------------------------------------------- pipeline

def test_pipeline_against_plain_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "simhash", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {d["doc_id"]: d["text"] for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    names, scores = langid.Predictor(langid.learn(docs))(list(rows.values()))
    left = {d: t for (d, t), n, s in zip(rows.items(), names, scores) if n != "und" and s >= 0.3}
    kept = docs.where(docs.doc_id.isin(list(left)))
    model = toxicity.fit(kept, spark.read.parquet(f"{SF}/labels.parquet"))
    left = {d: t for d, t in left.items() if not model.is_toxic([t])[0]}
    heads = {c for _, _, c in plain_groups(list(left.items()))}
    left = {d: t for d, t in left.items() if d in heads}
    bench = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    bad = plain_contamination(list(left.items()), bench)
    left = {d: t for d, t in left.items() if not bad[d][0]}
    check_pack(list(left.items()), corpus_pipeline.run(spark, SF).collect())


def test_stages_keep_columns_and_stand_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnsRenamed({"n_chars": "__gone", "source": "__bad"})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), SF).columns == docs.columns
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    rows = {d["doc_id"]: d["text"] for d in pq.read_table(f"{SF_LARGER}/documents.parquet").to_pylist()}
    docs = spark.read.parquet(f"{SF_LARGER}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.recognised_language(spark, docs, SF_LARGER).select("doc_id").collect()}
    assert kept == set(rows)
    kept = {r.doc_id for r in corpus_pipeline.not_toxic(spark, docs, SF_LARGER).select("doc_id").collect()}
    marks = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF_LARGER}/labels.parquet").to_pylist()}
    clean = {d for d, toxic in marks.items() if not toxic}
    assert len(clean & kept) >= 0.97 * len(clean)
    insults = re.compile(r"\b(trash|pathetic|idiot|disgusting|worthless|stupid|clown|loser|scum|moron)\b", re.I)
    found = {d for d, t in rows.items() if insults.search(t)}
    assert len(found - kept) >= 0.9 * len(found)


def test_toxicity_stage_finds_labelled_rows_in_every_language(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    marks = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    kept = {r.doc_id for r in corpus_pipeline.not_toxic(spark, docs, sf).select("doc_id").collect()}
    clean = {d for d, t in marks.items() if not t}
    assert len(clean & kept) >= 0.95 * len(clean)
    for name in ("en", "de", "fr", "es"):
        toxic = {d for d, t in marks.items() if t and lang[d] == name}
        assert len(toxic - kept) >= 0.85 * len(toxic), name


def test_an_id_with_several_texts_loses_none(spark):
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a, 1), (5, a, 2), (5, b, 3), (5, b, 4), (7, b, 5), (9, c, 6), (9, c, 7), (5, c, 8), (None, a, 9)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row int, fp string")
    got = sorted((r.doc_id or 0, r.text) for r in simhash.drop_near_duplicates(df).collect())
    assert got == sorted([(1, a), (5, b), (5, c), (0, a)])
    assert simhash.drop_near_duplicates(df).columns == df.columns


def test_an_item_id_with_several_texts_is_found_by_each(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    one, two = text(40), text(60)
    bench = spark.createDataFrame([(3, one), (3, two), (4, two), (4, two), (None, text(20)), (5, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{text(30)} {one} {text(9)}"), (2, f"{two} {text(30)}"), (3, text(80)), (4, one), (4, one), (5, None)],
                                 "doc_id long, text string")
    got = sorted(decontamination.contamination(docs, bench).collect())
    assert [(r.doc_id, r.contaminated, r.n_items, r.item_id) for r in got] == [
        (1, True, 1, 3), (2, True, 2, 3), (3, False, 0, None), (4, True, 1, 3), (4, True, 1, 3), (5, False, 0, None)]
    kept = decontamination.drop_contaminated(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5]
