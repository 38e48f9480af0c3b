import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import mixing as mx
from tessera.llm import topics


def brute(cells, targets, budget):
    """Weights and probabilities of cells {(source, lang, topic): tokens} in plain Python, one marginal after the other, s by halving."""
    total = sum(cells.values())
    w = {c: t / total for c, t in cells.items()}
    for _ in range(3000):
        for d in range(3):
            have = defaultdict(float)
            for c, x in w.items():
                have[c[d]] += x
            wanted = {v: targets[d].get(v, 0.0) for v in have}
            wanted = {v: t / sum(wanted.values()) for v, t in wanted.items()}
            w = {c: x * wanted[c[d]] / have[c[d]] if have[c[d]] else 0.0 for c, x in w.items()}
    low, high = 0.0, 1e15
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(cells[c], mid * w[c]) for c in w) < budget * total else (low, mid)
    return w, {c: min(1.0, high * w[c] / cells[c]) for c in w}


def test_features_against_plain_words():
    rnd = random.Random(3)
    words = ["Stone", "stone", "river", "é", "Été", "x1y", "--", "\u2603a"]
    for n in (0, 1, 7, 500):
        text = "".join(rnd.choice(words) + rnd.choice([" ", "\n", "\t ", ", "]) for _ in range(n))
        counts, tokens = topics.features(text)
        assert tokens == len(text.encode().split()) and counts.sum() == len([w for w in "".join(c if c.isalpha() or ord(c) >= 128 else " " for c in text).split(" ") if w])
    a, b = topics.features("one Two two"), topics.features("two two ONE")
    assert (a[0] == b[0]).all() and topics.features(None)[1] == 0
    long_ = "stone river " * 200_000
    counts, tokens = topics.features(long_)
    assert tokens == 400_000 and sorted(counts[counts > 0]) == [200_000, 200_000]
    assert topics.features("a" * 3_000_000)[1] == 1


def test_features_of_many_texts_are_those_of_each():
    rnd = random.Random(8)
    texts = [None, "", " ", "a", "\u00e9\ud800", "12 !"] + ["".join(rnd.choice("ab\u00c9X1- \n\t") for _ in range(rnd.choice([3, 50, 3000, 40_000]))) for _ in range(60)] + ["", None]
    counts, tokens = topics.features_of(texts)
    for t, c, n in zip(texts, counts, tokens):
        assert (topics.features(t)[0] == c).all() and topics.features(t)[1] == n
    assert len(topics.features_of([])[0]) == 0


def test_topics_part_texts_of_different_words(spark):
    rnd = random.Random(5)
    kinds = [[f"{k}{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)] for k in ("ab", "xy", "mn")]
    rows = [(i, " ".join(rnd.choice(kinds[i % 3]) for _ in range(80))) for i in range(240)] + [(900, None), (901, "12 !")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = topics.fit(docs, topics=3)
    got = {r.doc_id: r.t.topic for r in docs.select("doc_id", mx.described(F.col("text"), model).alias("t")).collect()}
    assert got[900] == got[901] == "none" and len({got[i] for i in range(240)}) == 3
    assert all(got[i] == got[i % 3] for i in range(240))
    again = topics.fit(docs.repartition(7), topics=3)
    assert (again.centroids == model.centroids).all()
    assert len(topics.fit(docs.limit(0)).centroids) == 0


def test_all_texts_make_the_model(spark, monkeypatch):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(["abc", "abd", "abe"] if i % 2 else ["xyc", "xyd", "xye"]) for _ in range(40)) + f" end {i}" + " rare" * (i == 77) for i in range(200)]
    docs = spark.createDataFrame([(t,) for t in texts] + [(texts[0],)] * 50, "text string")
    monkeypatch.setattr(topics, "SAMPLE", 8)
    model = topics.fit(docs, topics=2)
    counts = np.array([topics.features(t)[0] for t in texts])
    assert np.allclose(model.idf, np.log(201 / (1 + (counts > 0).sum(0))) + 0.1)
    own, x = model(counts), topics._unit(np.log1p(counts) * model.idf)
    assert len(set(own[::2])) == len(set(own[1::2])) == 1
    assert np.allclose(model.centroids, topics._unit(np.array([x[own == k].mean(0) for k in (0, 1)])), atol=1e-5)


def test_rounds_hold_few_texts_at_once_and_sum_exactly(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["abc", "abd", "xyc", "xyd", f"q{chr(97 + i % 26)}"]) for _ in range(1 + i % 30)) for i in range(2500)]
    counts = np.array([topics.features(t)[0] for t in texts])
    rows = topics._held(spark.createDataFrame(list(enumerate(texts)), "h long, text string")).repartition(1)
    assert (topics._texts_of_bins(rows) == (counts > 0).sum(0)).all()
    idf = np.linspace(0.5, 2, topics.BINS, dtype=np.float32)
    vectors = topics._vectors(rows, idf)
    part = vectors.toPandas().sort_values("h")
    found = [x for x, *_ in topics._matrices(part, "x", np.float32)]
    assert [len(x) for x in found] == [1000, 1000, 500]
    x = topics._unit(np.log1p(counts) * idf)
    assert (np.concatenate(found) == x).all()
    centroids = x[[3, 4, 29]]
    own = (x @ centroids.T).argmax(1)
    sums = np.array([np.rint(x[own == k].astype(np.float64) * topics.UNIT).sum(0) for k in range(3)])
    assert np.allclose(topics._means(vectors, centroids), topics._unit(sums), atol=1e-6)
    assert len(topics._starts(vectors)) == topics.SAMPLE and (topics._starts(vectors) == x[: topics.SAMPLE]).all()


def rows(n=3000):
    rnd = random.Random(1)
    for i in range(n):
        source = rnd.choice(["a", "a", "a", "b", "c", None])
        lang = rnd.choice(["en", "en", "fr", None])
        text = rnd.choice(["", "word " * rnd.randint(1, 80), "x | y | " * 9, "SHOUT " * 20, "a### b " * 40, None])
        yield i, text, lang, source, "old"


def test_against_plain_fitting(spark):
    docs = spark.createDataFrame([*rows(), (None, "lone words", "en", "a", "old"), (5000, "w " * 100_000, "fr", "b", "old")], "doc_id long, text string, lang string, source string, kept string")
    for budget in (0.5, 0.95):
        found = mx.mixed(docs, budget=budget).persist()
        got = found.collect()
        assert len(got) == 3002
        cells, of = defaultdict(int), {}
        for r in got:
            if r.n_tokens:
                c = (r.source or "unknown", r.lang or "unknown", r.topic)
                cells[c] += r.n_tokens
                of[c] = r.weight, r.probability
        total = sum(cells.values())
        shares = lambda sums: {v: t**0.7 / sum(x**0.7 for x in sums.values()) for v, t in sums.items()}
        by_lang = defaultdict(float)
        for c, t in cells.items():
            by_lang[c[1]] += t
        by_lang = shares(by_lang)
        targets = [defaultdict(float), by_lang, defaultdict(float)]
        for d in (0, 2):
            for lang, want in by_lang.items():
                own = defaultdict(float)
                for c, t in cells.items():
                    if c[1] == lang:
                        own[c[d]] += t
                for v, x in shares(own).items():
                    targets[d][v] += want * x
        w, p = brute(cells, targets, budget)
        for c, (weight, probability) in of.items():
            assert abs(weight - w[c]) < 1e-6 and abs(probability - p[c]) < 1e-4
        assert abs(sum(cells[c] * x for c, (_, x) in of.items()) - budget * total) < 1e-6 * total
        assert all(r.kept and r.probability == 1 and r.weight is None for r in got if not r.n_tokens)
        kept = sum(r.n_tokens for r in got if r.kept and r.doc_id != 5000)
        assert 0.9 < kept / sum(r.n_tokens * r.probability for r in got if r.doc_id != 5000) < 1.1
        found.unpersist()


def test_targets_that_contradict_each_other_end(spark):
    cells = spark.createDataFrame([("s", "en", "t00", 60), ("s", "fr", "t01", 40)], "source string, lang string, topic string, tokens long")
    one = lambda **k: spark.createDataFrame(list(k.items()), "value string, target double")
    got = mx.raked(cells, {"source": one(s=1.0), "lang": one(en=0.9, fr=0.1), "topic": one(t00=0.1, t01=0.9)}).collect()
    assert abs(sum(r.weight for r in got) - 1) < 1e-9


def test_ties_and_repeated_rows_share_their_fate(spark):
    docs = spark.createDataFrame([(i // 2, "same words", "en", "s") for i in range(200)], "doc_id long, text string, lang string, source string")
    got = mx.mixed(docs).collect()
    kept = defaultdict(set)
    for r in got:
        kept[r.doc_id].add(r.kept)
    assert {r.probability for r in got} == {0.5} and all(len(x) == 1 for x in kept.values()) and {True} in kept.values() and {False} in kept.values()


def test_given_targets_and_empty(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "en" if i % 2 else "fr", "s") for i in range(40)], "doc_id long, text string, lang string, source string")
    one = lambda **k: spark.createDataFrame(list(k.items()), "value string, target double")
    got = mx.mixed(docs, {"source": one(s=1.0, gone=1.0), "lang": one(en=1.0), "topic": one(t00=1.0)}, budget=0.25)
    assert {(r.lang, round(r.weight, 9), round(r.probability, 9)) for r in got.collect()} == {("en", 1.0, 0.5), ("fr", 0.0, 0.0)}
    assert mx.mixed(docs.limit(0)).count() == 0
