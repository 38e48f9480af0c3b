import random

import pytest

from tessera.llm import decontam as dc


def brute(docs, items, n, threshold):
    out = []
    for i, t in items:
        w = dc.words_of(t)
        size = min(n, len(w))
        own = set(dc.shingles(w, size)) if w else set()
        for d, x in docs:
            if own:
                share = len(own & set(dc.shingles(dc.words_of(x), size))) / len(own)
                if share >= threshold:
                    out.append((i, d, share))
    return sorted(out, key=str)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_sketch_cannot_all_be_missing(threshold):
    for n in range(1, 200):
        k = dc.sketch_size(n, threshold)
        assert 1 <= k <= n and (n - k) / n < threshold <= (n - k + 1) / n + 1e-9 or k == n


def test_against_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice("abcdefgh") * rnd.randint(1, 3)
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 2, 3, 4, 5, 6, 9, 20, 40])))) for i in range(40)] + [(50, None), (51, "..."), (52, "Ünï 漢字"), (3, "a b"), (None, "aa bb cc dd ee ff")]
    docs = []
    for d in range(120):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 60)))]
        for _ in range(rnd.randint(0, 3)):
            w = (rnd.choice(items)[1] or "").split()
            if w and rnd.random() < 0.5:
                w[rnd.randrange(len(w))] = "changed"
            parts.append(" ".join(w).upper())
        docs.append((d, ", ".join(parts)))
    docs += [(500, None), (501, ""), (502, "ÜNÏ 漢字"), (503, "x " * 30_000 + items[9][1]), (7, docs[7][1]), (None, items[8][1])]
    a = spark.createDataFrame([(*r, "z") for r in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, doc_id string")
    want = brute(docs, items, 5, 0.8)
    for block in (10**6, 60):
        got = dc.contaminated(a, b, block_words=block)
        assert sorted(((r.item_id, r.doc_id, r.containment) for r in got.collect()), key=str) == want
    assert dc.contaminated(a, b.limit(0)).count() == 0 and dc.contaminated(a.limit(0), b).count() == 0
