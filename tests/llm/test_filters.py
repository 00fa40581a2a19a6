"""Language ID, toxicity, decontamination and URL filter."""

import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vigilspark.llm import decontamination, langid, queries, toxicity, urlfilter

SF = "/root/testdata/sf0.001"
SF_LARGER = "/root/testdata/sf0.01"


def docs(sf=SF):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


# ---------------------------------------------------------------- language ID

def test_grams_of_words():
    who, order, value = langid.grams(["ab", "b"])
    pieces = {(w, g) for w, s in ((0, " ab "), (1, " b ")) for n in langid.ORDERS for i in range(len(s) - n + 1)
              if (g := s[i:i + n]) != " "}
    assert len(value) == len(pieces) == len({(int(w), int(v)) for w, v in zip(who, value)})
    assert sorted(zip(who.tolist(), order.tolist())) == sorted((w, len(g)) for w, g in pieces)
    alone = dict(zip([(1, g) for g in ("b", " b", "b ", " b ")], [0] * 4))
    assert (who == 1).sum() == len(alone)


def test_held_out_accuracy(spark):
    want = {d["doc_id"]: d for d in docs(SF_LARGER)}
    got = queries.op10_language_id(spark, SF_LARGER).collect()
    assert len(got) == len(want)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    right = [r.lang_pred == want[r.doc_id]["lang"] for r in got if r.held_out]
    assert sum(right) / len(right) >= 0.99


def test_filters_hold_every_common_gram(spark):
    df = spark.createDataFrame([("xa", "aba abb " * 50), ("xb", "zzy yyz " * 50), (None, "qqq"), ("xc", None)], "lang string, text string")
    filters = langid.learn(df)
    assert filters.langs == ["xa", "xb"]
    predict = langid.Predictor(filters)
    names, scores = predict(["abb", "yyz", "", None, "123 !", "ABA\nabb"])
    assert names == ["xa", "xb", "und", "und", "und", "xa"]
    assert scores[0] == pytest.approx(1) and scores[2] == 0


def test_more_languages_than_a_machine_word_has_bits(spark):
    df = spark.createDataFrame([(f"l{i:02d}", f"{chr(0x4e00 + i)}{chr(0x5e00 + i)} " * 5) for i in range(70)], "lang string, text string")
    predict = langid.Predictor(langid.learn(df))
    assert predict([chr(0x4e00 + 69) + chr(0x5e00 + 69)])[0] == ["l69"]


def test_language_of_odd_rows(spark):
    rows = [(i, "the cat sat on the mat " * 3, "en") for i in range(30)] + [(i, "der hund und die katze " * 3, "de") for i in range(30, 60)]
    rows += [(None, "the mat", "en"), (61, None, "en"), (62, "", None), (63, "12 !", "de"), (64, "the " * 50_000, None), (65, "der hund", None), (65, "der hund", None)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[None].held_out is False and by[None].lang_pred == "en"
    assert by[61].lang_pred == by[62].lang_pred == by[63].lang_pred == "und" and by[62].score == 0
    assert by[64].lang_pred == "en" and by[65].lang_pred == "de"
    assert langid.identify(df.where("false")).count() == 0
    untaught = langid.identify(df.withColumn("lang", df.lang.substr(9, 0)).where("false").unionByName(df.where("lang is null")))
    assert {r.lang_pred for r in untaught.collect()} == {"und"}
    kept = langid.keep_recognised(df, langid.learn(df))
    assert kept.columns == df.columns and kept.count() == len(rows) - 3


def test_numeric_signs_are_no_letters(spark):
    df = spark.createDataFrame([(1, "½ ² Ⅷ", None), (2, "½ der ²", None), (3, "der und die " * 9, "de"), (5, "the of and " * 9, "en")],
                               "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df, folds=3, held_out=9).collect()}
    assert got[1].lang_pred == "und" and got[1].score == 0 and got[2].lang_pred == "de"


def test_verdict_against_plain_gram_sets(spark):
    """Bloom filters and their correction against exact sets of n-grams."""
    rng = random.Random(8)
    texts = {"xa": ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 7))) for _ in range(400)],
             "xb": ["".join(rng.choice("efghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]}
    held_sets = {lang: {w[i:i + n] for word in words for w in [f" {word} "] for n in langid.ORDERS for i in range(len(w) - n + 1)}
                   for lang, words in texts.items()}
    filters = langid.learn(spark.createDataFrame([(lang, " ".join(words)) for lang, words in texts.items()], "lang string, text string"))
    asked = [" ".join(rng.choice(texts[lang]) for _ in range(6)) for lang in ("xa", "xb") for _ in range(40)]
    names, scores = langid.Predictor(filters)(asked)
    for text, name, score in zip(asked, names, scores):
        share = {lang: sum(w[i:i + n] in held for word in text.split() for w in [f" {word} "] for n in langid.ORDERS for i in range(len(w) - n + 1))
                 for lang, held in held_sets.items()}
        assert name == max(share, key=share.get) and 0 < score <= 1


# ------------------------------------------------------------------- toxicity

@pytest.mark.parametrize("seed", [1, 2])
def test_held_out_toxic_labels_are_found_by_language(spark, seed):
    """Stems that only toxic rows have, under endings never seen in training."""
    rng = random.Random(seed)
    plain = {lang: ["".join(rng.choice(part) for _ in range(rng.randint(2, 5))) for _ in range(300)]
             for lang, part in (("en", ["ha", "th", "on", "er"]), ("de", ["ei", "sch", "un", "ge"]), ("fr", ["eau", "oi", "qu", "le"]))}
    stems = {"en": ["zorg", "blick"], "de": ["lowei", "kropf"], "fr": ["vejux", "nazul"]}
    rows = []
    for i in range(1500):
        lang = ("en", "de", "fr")[i % 3]
        words, toxic = rng.choices(plain[lang], k=rng.randint(20, 80)), i % 10 == 0
        if toxic:
            for _ in range(rng.randint(1, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(stems[lang]) + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 3))))
        rows.append((i, " ".join(words), lang, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(df, df.where("doc_id < 900").select("doc_id", "toxic"))
    got = toxicity.severity(df.drop("toxic"), model).join(df.select("doc_id", "lang", F.col("toxic").alias("label")), "doc_id").where("doc_id >= 900").collect()
    for lang in stems:
        found = [r.toxic for r in got if r.lang == lang and r.label]
        assert sum(found) >= 0.9 * len(found), lang
    clean = [r.toxic for r in got if not r.label]
    assert sum(clean) <= 0.05 * len(clean)


def test_the_cut_lies_in_the_best_gap():
    p = np.array([0.01, 0.01, 0.02, 0.02, 0.3, 0.4, 0.01])
    toxic = np.array([False, False, False, False, True, True, True])
    assert 0.02 < toxicity._toxic_from(p, toxic) < 0.3
    assert toxicity._toxic_from(p, toxic | True) == toxicity._toxic_from(p[:1], toxic[:1]) == toxicity.TOXIC_FROM
    assert toxicity._toxic_from(np.array([0.7, 0.9]), np.array([False, True])) == toxicity.TOXIC_FROM


def test_toxic_labels_are_found(spark):
    got = {r.doc_id: r for r in queries.op1_toxicity(spark, SF_LARGER).collect()}
    words = {"trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron"}
    marked = {d["doc_id"]: len(words & set(re.findall(r"\w+", (d["text"] or "").lower()))) for d in docs(SF_LARGER)}
    assert len(got) == len(marked)
    assert all(got[d].toxic for d, n in marked.items() if n >= 2)
    assert sum(got[d].toxic for d, n in marked.items() if not n) <= 0.01 * len(marked)
    assert all((r.grade > 0) == r.toxic and 0 <= r.p_toxic <= 1 and r.p_toxic <= r.expected_severity <= toxicity.LEVELS * r.p_toxic + 1e-9
               for r in got.values())


def test_ordinal_fit_recovers_cuts_and_order():
    rng = np.random.default_rng(3)
    n = 4000
    x = rng.integers(0, 2, (n, 3)).astype(float)
    grade = (x @ [2.0, 1.0, 0.0] + rng.logistic(size=n) > np.array([[1.0], [2.0], [3.5]])).sum(axis=0)
    rows, cols = np.nonzero(x)
    weight, cuts = toxicity._descend(rows, cols, x[rows, cols], grade, 3)
    assert np.allclose(weight, [2, 1, 0], atol=0.25) and np.allclose(cuts, [1, 2, 3.5], atol=0.3) and (np.diff(cuts) > 0).all()


def test_toxicity_of_odd_rows(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=30)) + (" badword worse" * (1 + i % 4) if i % 5 == 0 else "")) for i in range(400)]
    rows += [(1000, None), (1001, ""), (None, "badword worse badword"), (1002, "Badword, WORSE!"), (1002, "Badword, WORSE!"), (1003, "w1 " * 100_000)]
    df = spark.createDataFrame([(d, t, "x", False) for d, t in rows], "doc_id long, text string, words string, toxic boolean")
    marks = [(i, int(i % 5 == 0)) for i in range(400)] + [(5, None), (None, 1), (3, 0), (3, 0), (9999, 1)]
    labels = spark.createDataFrame([(d, t, 1) for d, t in marks], "doc_id long, toxic int, quality int")
    model = toxicity.fit(df, labels)
    got = {r.doc_id: r for r in toxicity.severity(df, model).collect()}
    assert got[1002].toxic and got[None].toxic and not got[1000].toxic and not got[1001].toxic and not got[1003].toxic
    assert all(got[i].toxic == (i % 5 == 0) for i in range(400))
    assert got[15].expected_severity > got[0].expected_severity
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if not r.toxic}
    assert toxicity.severity(df.where("false"), model).count() == 0
    for few in (labels.where("false"), labels.where("toxic = 0")):
        blank = toxicity.fit(df, few)
        assert not any(r.toxic for r in toxicity.severity(df, blank).collect())


def test_sample_is_bounded_and_free_of_copies(spark):
    df = spark.createDataFrame([(i, f"text number {i} of many texts") for i in range(2000)] + [(5000 + i, "one copied text here now") for i in range(500)],
                               "doc_id long, text string")
    labels = df.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    assert 350 < toxicity.training_table(df, labels, sample_rows=500).count() < 550


def test_only_checked_copies_of_one_label_merge(spark):
    """A passage that many rows share makes none of them a copy; near copies go, rows of another label stay."""
    rng = random.Random(11)
    noise = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    passage, base = [f"p{i}" for i in range(60)], noise(200)
    texts = {i: " ".join(noise(30) + passage + noise(30)) for i in range(200)}
    texts |= {1000: " ".join(base), 1001: " ".join(base + ["more"]), 1002: " ".join(["odd", *base]), 1003: " ".join(base), 1004: " ".join(base).upper()}
    texts |= {2000 + i: None for i in range(4)}
    toxic = {i: int(i % 4 == 0) for i in texts} | {1001: 0, 1002: 1, 1003: 1, 1004: 0, 1000: 0}
    df = spark.createDataFrame(list(texts.items()) + [(1, " ".join(base))], "doc_id long, text string")
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    got = [(r.doc_id, r.toxic) for r in toxicity.training_table(df, labels).collect()]
    # the second text of id 1 is a copy of 1000, with the smaller id
    assert sorted(got) == sorted([(i, toxic[i]) for i in range(200)] + [(1, 0), (1002, 1), (2000, 1), (2001, 0)])


# ------------------------------------------------------------ decontamination

def plain_tiles(text, item, least):
    free_t, free_i = [True] * len(text), [True] * len(item)
    while True:
        best, size = [], least - 1
        for a in range(len(item)):
            for b in range(len(text)):
                k = 0
                while a + k < len(item) and b + k < len(text) and free_i[a + k] and free_t[b + k] and item[a + k] == text[b + k]:
                    k += 1
                if k > size:
                    size, best = k, [(a, b)]
                elif k == size and k >= least:
                    best.append((a, b))
        if size < least:
            return free_i.count(False)
        for a, b in best:
            if all(free_i[a:a + size]) and all(free_t[b:b + size]):
                free_i[a:a + size] = free_t[b:b + size] = [False] * size


def plain_words(text):
    return re.findall(r"\w+", (text or "").lower())


def test_tiles_against_plain_greedy():
    rng = random.Random(8)
    memory = decontamination._WordHash()
    for _ in range(60):
        words = [f"v{i}" for i in range(rng.choice([2, 4, 30]))]
        item = rng.choices(words, k=rng.randint(5, 30))
        text = []
        for _ in range(4):
            at = rng.randrange(len(item))
            text += item[at:at + rng.randint(1, 15)] if rng.random() < 0.7 else rng.choices(words, k=6)
        h = [decontamination.word_hashes(" ".join(x), memory) for x in (text, item)]
        assert decontamination.tile(*h) == plain_tiles(text, item, 5)


def test_equal_hashes_of_other_words_end():
    same = np.array([1, 1, 1, 1, 1, 1], dtype=np.uint64)
    base = int(decontamination._BASE)
    other = np.array([1, 1, 1, 1, 0, 1 + base], dtype=np.uint64)  # collides with [1, 1, 1, 1, 1, 1]
    assert decontamination.tile(same, other, 5) in (0, 5)


def plain_contamination(rows, items):
    out = {}
    for key, text in rows:
        t, best = plain_words(text), []
        joined = " " + " ".join(t) + " "
        for item, body in items:
            i = plain_words(body)
            if len(i) >= 5 and any(f" {' '.join(i[k:k + 5])} " in joined for k in range(len(i) - 4)):
                share = plain_tiles(t, i, 5) / len(i)
                if share >= 0.5:
                    best.append((-share, item))
        out[key] = (len(best), min(best)[1], -min(best)[0]) if best else (0, None, 0.0)
    return out


def test_decontamination_query_against_plain(spark):
    bench = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    got = {r.doc_id: r for r in queries.op9_decontamination(spark, SF).collect()}
    rows = docs()
    want = plain_contamination([(d["doc_id"], d["text"]) for d in rows], bench)
    assert {k: (r.n_items, r.item_id, r.coverage) for k, r in got.items()} == want
    assert all(r.contaminated == (r.n_items > 0) for r in got.values()) and any(r.contaminated for r in got.values())


def test_reordered_and_odd_rows(spark):
    rng = random.Random(2)
    item = [f"q{i}" for i in range(40)]
    noise = lambda: rng.choices([f"n{i}" for i in range(500)], k=50)
    rows = [(1, " ".join(noise() + item[20:] + noise() + item[:20])), (2, " ".join(noise() + item[:18] + noise())),
            (3, " ".join(w for p in range(0, 40, 4) for w in item[p:p + 4] + ["x"])), (4, None), (5, ""), (6, "q1"),
            (None, " ".join(item).upper()), (7, ", ".join(item)), (7, ", ".join(item)), (8, " ".join(noise() * 400)), (9, "same five words again here")]
    items = [(1, " ".join(item)), (2, None), (3, ""), (4, "q1 q2"), (5, " ".join(item)), (None, " ".join(noise())), (6, "Same five words, again here!")]
    df = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, words string, item_id int")
    bench = spark.createDataFrame([(d, t, "x") for d, t in items], "item_id long, text string, doc_id string")
    got = decontamination.contamination(df, bench).collect()
    assert len(got) == len(rows)
    assert sorted(((r.doc_id, r.contaminated, r.n_items, r.item_id) for r in got if r.contaminated), key=str) == \
        sorted([(1, True, 2, 1), (7, True, 2, 1), (7, True, 2, 1), (None, True, 2, 1), (9, True, 1, 6)], key=str)
    kept = decontamination.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 6, 8]
    assert decontamination.drop_contaminated(df, bench.where("false")).count() == len(rows)
    assert decontamination.contamination(df.where("false"), bench).count() == 0


# ----------------------------------------------------------------- URL filter

def plain_host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):])[0]


def plain_judge(rows, rules=urlfilter.RULES, d=0.85, rounds=10):
    """rows: (page_id, url, html)"""
    pages, links, seeds = [], {}, {"allow": {}, "block": {}}
    for page, url, html in rows:
        host, path = plain_host_path(url)
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.name)) if fit else None
        pages.append((page, host, path, best))
        if best:
            seeds[best.verdict][host] = seeds[best.verdict].get(host, 0) + 1
        for target in re.findall(r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^"'\s<>/?#]+)""", html or ""):
            target = target.lower()
            if host and target != host:
                links[host, target] = links.get((host, target), 0) + 1

    def run(kind, edges):
        total = sum(seeds[kind].values())
        start = {h: (1 - d) * n / total for h, n in seeds[kind].items()}
        out = {}
        for (a, _), n in edges.items():
            out[a] = out.get(a, 0) + n
        now = dict(start)
        for _ in range(rounds):
            after = dict(start)
            for (a, b), n in edges.items():
                if a in now:
                    after[b] = after.get(b, 0) + d * now[a] * n / out[a]
            now = after
        return now

    trust, bad = run("allow", links), run("block", {(b, a): n for (a, b), n in links.items()})
    return sorted((page, host, path, best.name if best else None,
                   best.verdict if best else "block" if bad.get(host, 0) > trust.get(host, 0) else "allow") for page, host, path, best in pages)


def test_url_query_against_plain(spark):
    rows = [(p["page_id"], p["url"], p["html"]) for p in pq.read_table(f"{SF_LARGER}/pages.parquet").to_pylist()]
    assert sorted(tuple(r) for r in queries.op6_url_filter(spark, SF_LARGER).collect()) == plain_judge(rows)


def test_links_carry_trust_and_distrust(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">y</a>' for h in hosts)
    rows = [(1, "https://good.com/", link("friend.org", "Mixed.org")), (2, "http://bad.net/es/1", link("mixed.org", "victim.org")),
            (3, "https://farm.org/a", link("bad.net", "bad.net")), (4, "https://feeder.org/", "<A HREF='//farm.org'>"),
            (5, "https://friend.org", ""), (6, "https://mixed.org/?q#f", link("bad.net")), (7, "https://victim.org/z", None),
            (8, None, link("bad.net")), (9, "no scheme", None), (10, "HTTPS://WWW.Example.COM/en/?x", None), (11, "http://a.example.com/en/q", None),
            (12, "http://example.com", None), (13, "ftp://x.com?y", None), (13, "ftp://x.com?y", None), (14, "http://notexample.com/en/", None),
            (15, "http://", link("bad.net")), (16, "http://bad.net/fr/", "h" * 200_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = sorted(tuple(r) for r in urlfilter.judge(df).collect())
    assert got == plain_judge(rows)
    verdict = {r[0]: r[4] for r in got}
    assert verdict[3] == verdict[4] == "block" and verdict[5] == verdict[7] == verdict[8] == "allow"
    assert urlfilter.judge(df.where("false")).count() == 0


def test_mass_goes_any_number_of_links(spark):
    """A chain of 25 hosts that feeds a blocked one, and a cycle against its exact solution."""
    link = lambda h: f'<a href="https://{h}/">y</a>'
    rows = [(i, f"https://farm{i}.org/", link(f"farm{i + 1}.org" if i < 24 else "bad.net")) for i in range(25)]
    rows += [(100, "https://bad.net/es/1", ""), (101, "https://other.org/", ""), (102, "https://good.com/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    verdict = {r.page_id: r.verdict for r in urlfilter.judge(df).collect()}
    assert all(verdict[i] == "block" for i in range(25))
    assert all(verdict[i] == "allow" for i in (101, 102))
    links = spark.createDataFrame([(f"ring{i}", f"ring{(i + 1) % 3}", 1) for i in range(3)] + [("a", "ring0", 2)], "src string, dst string, links long")
    seeds = spark.createDataFrame([("a", 1.0)], "host string, weight double")
    got = {r.host: r.mass for r in urlfilter.spread(seeds, links, "src", "dst", tolerance=1e-2).collect()}
    names = ["a", "ring0", "ring1", "ring2"]
    move = np.zeros((4, 4))
    move[1, 0] = move[2, 1] = move[3, 2] = move[1, 3] = 0.85
    exact = np.linalg.solve(np.eye(4) - move, [0.15, 0, 0, 0])
    assert np.allclose([got[n] for n in names], exact, atol=1e-2 / 0.15)


def test_no_python_in_the_url_plan(spark):
    plan = queries.op6_url_filter(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
