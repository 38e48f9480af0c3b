import numpy as np
import xxhash

from tessera.llm import simhash as sh


def brute(rows, k=4, radius=4):
    """(doc_id, fingerprint, component_id) of every row: all pairs of rows are compared, ids decide nothing."""
    prints = [(i, sh_ref(t, k)) for i, t in rows]
    of = list(range(len(prints)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= radius:
                of[max(find(a), find(b))] = min(find(a), find(b))
    ids = {}
    for n, (i, _) in enumerate(prints):
        ids.setdefault(find(n), []).append(i)
    least = {r: min((i for i in found if i is not None), default=None) for r, found in ids.items()}
    return ordered((i, x, least[find(n)]) for n, (i, x) in enumerate(prints))


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, x or 0) for x in r])


def sh_ref(t, k):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(300)] + ["Été", "ÀB", "x y"]
    rows, base = [], [rng.choice(vocab, 60).tolist() for _ in range(12)]
    for i in range(160):
        words = list(base[rng.integers(12)])
        for _ in range(rng.integers(3)):
            words[rng.integers(60)] = vocab[rng.integers(300)]
        rows.append((int(i * 7), "  ".join(words)))
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, "one Two"), (5, "one two"), (5, "one two"), (6, "A" * 50_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int")
    for tile, blocks in ((sh.TILE, None), (5, None), (sh.TILE, 7)):
        got = ordered((r.doc_id, r.fp % 2**64, r.component_id) for r in sh.near_duplicates(docs, tile=tile, blocks=blocks).collect())
        assert got == brute(rows)


def test_blocks_grow_with_the_corpus():
    assert [sh.blocks_for(n) for n in (1, 10**6, 10**8, 10**10, 10**12)] == [6, 6, 6, 7, 8]


def test_lanes_and_spanning():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**63, 300, dtype=np.int64).view(np.uint64)
    fps[100:200] = fps[0] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    i, j = np.triu_indices(300, 1)
    near = np.bitwise_count(fps[i] ^ fps[j]) <= 4
    assert (sh.pairs_within(fps, i, j, 4) == near).all()
    a, b = sh.spanning(fps, 4)
    assert len(set(a) | set(b)) == 101 and len(a) == 100


def test_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (1, "other words in here now")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in sh.near_duplicates(docs).collect()}
    assert got == {None: None, 1: 1}
    assert sh.near_duplicates(docs.limit(0)).count() == 0


def chain():
    """Three texts whose fingerprints are close in a row: the first and the last are linked by the middle one only."""
    rng = np.random.default_rng(7)
    while True:
        w = [f"w{i}" for i in range(400)]
        near = lambda of: [*of[: (p := int(rng.integers(380)))], "edited", *of[p + 1 :]]
        b = near(w)
        c = near(b)
        x, y, z = (sh_ref(" ".join(t), 4) for t in (w, b, c))
        if bin(x ^ y).count("1") <= 4 and bin(y ^ z).count("1") <= 4 < bin(x ^ z).count("1"):
            return [" ".join(t) for t in (w, b, c)]


def test_links_go_through_rows_without_an_id(spark):
    a, b, c = chain()
    for middle in (3, None):
        rows = [(1, a), (middle, b), (2, c), (None, "quite another text"), (9, "and one more")]
        got = sh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert ordered((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == brute(rows)
        assert {r.component_id for r in got if r.doc_id in (1, 2, middle) and r.component_id} == {1}


def test_one_id_on_two_texts_joins_nothing(spark):
    rows = [(1, "the first text of all"), (1, "something else is here"), (2, "the first text of all"), (3, "something else is here")]
    got = sh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert ordered((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == brute(rows)
    assert len({r.fp for r in got}) == 2


def test_wide_lanes():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**63, (150, 4), dtype=np.int64).view(np.uint64)
    for i in range(50, 100):
        fps[i] = fps[0]
        for b in rng.choice(256, rng.integers(1, 40), replace=False):
            fps[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    i, j = np.triu_indices(150, 1)
    near = np.bitwise_count(fps[i] ^ fps[j]).sum(1) <= 46
    assert (sh.pairs_within(fps, i, j, 46) == near).all()
    of = list(range(150))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in zip(i[near], j[near]):
        of[max(find(a), find(b))] = min(find(a), find(b))
    a, b = sh.spanning(fps, 46)
    assert len(a) == 150 - len({find(x) for x in range(150)}) and all(find(x) == find(y) for x, y in zip(a, b))


def test_similar_texts(spark):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(5000)]
    jaccard = lambda a, b: len(a & b) / len(a | b)
    grams = lambda w: {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, pairs = [], []
    for i in range(0, 600, 3):
        w = rng.choice(vocab, 200).tolist()
        near, far = list(w), list(w)
        for p in rng.choice(200, 3, replace=False):
            near[p] = "edited"
        for p in rng.choice(200, 40, replace=False):
            far[p] = "edited"
        rows += [(i, " ".join(w)), (i + 1, " ".join(near)), (i + 2, " ".join(far))]
        pairs.append((i, jaccard(grams(w), grams(near)), jaccard(grams(w), grams(far))))
    rows += [(1000, None), (1001, " "), (1002, "Two words"), (1003, "two words"), (1003, "two words")]
    docs = spark.createDataFrame([(*r, 9) for r in rows] + [(None, "no id", 9)], "doc_id long, text string, component_id int")
    got = {r.doc_id: r.component_id for r in sh.similar_texts(docs).collect()}
    assert all(n > 0.8 and f < 0.5 for _, n, f in pairs)
    assert sum(got[i] == got[i + 1] == i for i, _, _ in pairs) >= 0.97 * len(pairs)
    assert all(got[i + 2] == i + 2 for i, _, _ in pairs)
    assert got[1000] == got[1001] == 1000 and got[1002] == got[1003] == 1002 and got[None] is None
    small = {r.doc_id: r.component_id for r in sh.similar_texts(docs, tile=3).collect()}
    assert small == got
    assert sh.similar_texts(docs.limit(0)).count() == 0


def test_similar_texts_are_exact_around_the_threshold(spark):
    rng = np.random.default_rng(5)
    jaccard = lambda a, b: len(a & b) / len(a | b)
    grams = lambda w: {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}
    docs = {}
    for i in range(0, 800, 2):  # 1 to 14 edits, each of which costs up to five of 196 shingles: similarities from 0.5 to 0.95
        w = [f"w{i}x{j}" for j in range(200)]
        near = list(w)
        for p in rng.choice(200, 1 + i // 2 % 14, replace=False):
            near[p] = "edited"
        docs[i], docs[i + 1] = w, near
    for i in range(1000, 1080, 2):  # exactly 0.8: 36 shingles of which 32 are common
        w = [f"e{i}x{j}" for j in range(40)]
        docs[i], docs[i + 1] = w, w[:-4] + [f"f{j}" for j in range(4)]
    passage = [f"p{j}" for j in range(100)]
    for i in range(2000, 2040):  # one passage that all hold, alike to less than 0.8
        docs[i] = passage + [f"q{i}x{j}" for j in range(16)]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    near = {i: jaccard(grams(docs[i]), grams(docs[i + 1])) >= 0.8 for i in [*range(0, 800, 2), *range(1000, 1080, 2)]}
    assert all(near[i] for i in range(1000, 1080, 2)) and 0 < sum(near.values()) - 40 < 400
    for tile in (sh.TILE, 5):
        got = {r.doc_id: r.component_id for r in sh.similar_texts(frame, tile=tile).collect()}
        assert {i: got[i + 1] == i for i in near} == near
        assert all(got[i] == i for i in range(2000, 2040))


def test_links_that_leaders_miss(spark):
    # a chain: each text is alike to its neighbours only
    w = [f"w{j}" for j in range(300)]
    rows = [(i, " ".join(w[5 * i : 5 * i + 60])) for i in range(45)]
    got = {r.doc_id: r.component_id for r in sh.similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), tile=3).collect()}
    assert set(got.values()) == {0}


def test_one_id_with_two_texts_joins_no_classes(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    got = sh.similar_texts(spark.createDataFrame([(7, a), (7, b), (8, a), (9, b)], "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(7, 7), (7, 7), (8, 7), (9, 7)]
    assert sh.text_classes(spark.createDataFrame([(7, a), (7, b)], "doc_id long, text string")).select("class").distinct().count() == 2


def test_tallies_never_say_too_little():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60_000, rng.integers(1, n)).astype(np.uint64)) for n in (5, 50, 3000, 50_000) for _ in range(12)]
    tallies = np.array([np.frombuffer(sh.tally(x), np.uint8) for x in sets])
    i, j = np.triu_indices(len(sets), 1)
    common = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)])
    assert sh.can_meet(tallies, i, j, common).all() and not sh.can_meet(tallies, i, j, common * 2 + 400).all()


def test_leaders_are_ends_and_middle(spark):
    rng = np.random.default_rng(9)
    base = int(rng.integers(0, 2**62))
    rows = [(i, base ^ (1 << int(rng.integers(62))) ^ (1 << int(rng.integers(62))), 0, 5) for i in range(40)] + [(100, base, 0, 5), (200, base, 1, 5)]
    got = {(r.a, r.b) for r in sh.leads(spark.createDataFrame(rows, "node long, fp long, w int, key long")).collect()}
    assert {b for _, b in got} == {0, 100} or {b for _, b in got} > {0, 100}
    assert all((i, 100) in got for i in range(40)) and not any(200 in p for p in got)
