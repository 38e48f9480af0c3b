import random
import zlib

import numpy as np
import zstandard as zstd

from tessera.llm import quality
from tessera.llm.common import table

GOOD = "the river house stands near an old bridge where people walk and talk about weather".split()


def texts(n, seed):
    rnd = random.Random(seed)
    for i in range(n):
        words = [rnd.choice(GOOD) + rnd.choice(["", "", "s", "ing"]) for _ in range(rnd.randint(20, 300))]
        kind = rnd.random()
        if kind < 0.6:
            yield i, " ".join(words), 1
        elif kind < 0.8:
            yield i, " ".join(w + "$$%" for w in words), 0
        else:
            yield i, " ".join(x for w in words[:20] for x in [w] * 30), 0


def test_held_out_accuracy_and_odd_rows(spark):
    train = spark.createDataFrame([*texts(400, 1), (900, None, 1), (901, "x", None), (902, "y", 7), (903, "two texts", 1), (903, "of one id", 1), (None, "z", 1)], "doc_id long, text string, quality int")
    model = quality.fit(train.drop("quality"), train.drop("text"))
    rows = list(texts(200, 2))
    odd = [(1000, None, None), (1001, "", None), (1003, "old bridge houses " * 9_000, 1), (1003, "old bridge houses " * 9_000, 1), (None, "$$%", 0)]
    docs = spark.createDataFrame([(*r, "old") for r in rows + odd], "doc_id long, text string, quality int, score string")
    got = quality.scored(docs, model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= quality.THRESHOLD) for r in got)
    assert sum(r.predicted == r.quality for r in got if r.doc_id is not None and r.doc_id < 1000) >= 194
    assert len({r.score for r in got if r.doc_id in (1000, 1001)}) == 1 and len({r.score for r in got if r.doc_id == 1003}) == 1
    assert quality.scored(docs.limit(0), model).count() == 0


def test_sizes_are_those_of_plain_zstandard():
    model = quality.Model(b"bad $$% words$$% " * 40, b"good words of a house " * 40)
    scorer = quality.Scorer(model)
    for text in ("", "x", "good words of a house", "bad $$% " * 300, "é漢" * 900, "q" * 511 + "z" * 700):
        data = text.encode()
        pieces = quality.pieces_of(data)
        assert b"".join(pieces) == data and all(len(p) <= 1.5 * quality.PIECE for p in pieces) and len(pieces) >= 1
        sizes = []
        for content in (model.bad, model.good):
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=quality.LEVEL)
            c = zstd.ZstdCompressor(level=quality.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append([len(c.compress(p)) for p in pieces])
        bad, good = map(sum, sizes)
        found = dict(zip(quality.FEATURES, scorer.features(text)))
        assert found["difference"] == (bad - good) / (bad + good)
        assert found["worst"] == min((b - g) / (b + g) for b, g in zip(*sizes))


def test_the_curve_is_the_best_one():
    rnd = np.random.default_rng(3)
    x, y, w = rnd.normal(size=(300, 3)), rnd.integers(0, 2, 300), rnd.uniform(0.5, 2, 300)
    x[:, 0] += y
    centre, scale, best = map(np.array, quality.calibrated(x, y, w))
    z = np.column_stack([np.ones(300), (x - centre) / scale])

    def loss(v):
        return w @ np.logaddexp(0, np.where(y == 1, -1, 1) * (z @ v)) + 0.5 * (1e-6 * v[0] ** 2 + quality.RIDGE * (v[1:] ** 2).sum())

    assert all(loss(best) <= loss(best + d) for d in rnd.normal(scale=0.02, size=(200, 4)))
    apart = quality.calibrated(np.array([[-1.0], [-2.0], [1.0], [2.0]]), np.array([0, 0, 1, 1]), np.ones(4))
    assert np.isfinite(apart[2]).all()


def test_nothing_to_compare(spark):
    schema = "doc_id long, text string, quality int"
    empty, same = spark.createDataFrame([], schema), spark.createDataFrame([(i, "some words", 1) for i in range(30)], schema)
    none, one = quality.fit(empty, empty), quality.fit(same, same)
    assert (none.share, one.share) == (0.5, 1.0)
    got = quality.scored(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"), none).collect()
    assert [r.score for r in got] == [0.5, 0.5] and [r.predicted for r in got] == [1, 1]


def test_labels_that_disagree_and_held_out_rows(spark):
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, 0), (2, 1), (3, None), (None, 1), (4, 5)], "doc_id long, quality int")
    assert [tuple(r) for r in quality.agreed(labels).collect()] == [(1, 0)]
    ids = [*range(200), None, -5, 2**62]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").withColumn("out", quality.held_out()).collect()
    assert all(r.out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_the_query_on_the_given_table(spark):
    where = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.query(spark, where).collect()}
    assert len(got) == table(spark, where, "documents").count()
    held = [(r.quality, got[r.doc_id]) for r in table(spark, where, "labels").collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert np.mean([q == r.predicted for q, r in held]) >= 0.95
