import random

from tessera.llm import langid

WORDS = {"aa": "the of and tion ing ere house water stone river", "bb": "der und ein schaft keit haus wasser stein fluss", "cc": "le les eau oux maison pierre fleuve aire"}


def texts(n, seed):
    rnd = random.Random(seed)
    for i in range(n):
        lang = rnd.choice(list(WORDS))
        words = [rnd.choice(WORDS[lang].split()) + rnd.choice(["", "", rnd.choice(WORDS[lang].split())]) for _ in range(rnd.randint(15, 300))]
        yield i, " ".join(words), lang


def test_held_out_accuracy_and_odd_rows(spark):
    train = spark.createDataFrame([*texts(300, 1), (900, None, "aa"), (901, "???", "bb"), (902, "words", None)], "doc_id long, text string, lang string")
    content = langid.fit(train)
    assert set(content) == set(WORDS)
    rows = list(texts(200, 2))
    odd = [(1000, None, None), (1001, "", None), (1002, "123 !?", None), (1003, "water tion stone river of the and house " * 9_000, "aa"), (1003, "water tion stone river of the and house " * 9_000, "aa")]
    docs = spark.createDataFrame([(*r, "old") for r in rows + odd], "doc_id long, text string, lang string, score string")
    got = langid.predict(docs, content).collect()
    assert len(got) == len(rows) + len(odd) and got[0].asDict().keys() == {"doc_id", "text", "lang", "score", "lang_pred", "rejected"}
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in got if r.doc_id < 1000) >= 198
    assert all(r.lang_pred == "und" and r.rejected and r.score == 0 for r in got if 1000 <= r.doc_id <= 1002)
    assert [r.lang_pred for r in got if r.doc_id == 1003] == ["aa", "aa"]


def test_labels_are_no_input(spark):
    content = langid.fit(spark.createDataFrame(list(texts(120, 3)), "doc_id long, text string, lang string"))
    rows = list(texts(40, 4))
    a = langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), content)
    b = langid.predict(spark.createDataFrame([(i + 7, t, "zz") for i, t, _ in rows], "doc_id long, text string, lang string"), content)
    assert [r.lang_pred for r in a.collect()] == [r.lang_pred for r in b.collect()]


def test_nothing_learned_and_empty(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    content = langid.fit(none)
    assert content == {} and langid.predict(docs, content).first().lang_pred == "und"
    assert langid.predict(docs.limit(0), {"aa": b" a b "}).count() == 0


def test_sizes_are_those_of_the_whole_text_at_one_level(spark):
    import zstandard as zstd

    content = langid.fit(spark.createDataFrame(list(texts(120, 5)), "doc_id long, text string, lang string"))
    model = langid.Classifier(content)
    for text in ("stone", "water Stone, 12 rivers!", " ".join(t for _, t, _ in texts(60, 6)), "x" * 20_000, "é" * 9_000):
        data = langid.letters_of(text)
        pieces = list(langid.chunks_of(data))
        assert b"".join(pieces) == data and all(0 < len(p) <= langid.CHUNK for p in pieces)
        for lang, size in zip(content, model.sizes(text)):
            d = zstd.ZstdCompressionDict(content[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=langid.LEVEL)
            c = zstd.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            assert size == sum(len(c.compress(p)) for p in pieces)
        lang, _, margin = model(text)
        best, second = sorted(model.sizes(text))[:2]
        assert margin == (second - best) / second and model.sizes(text)[model.langs.index(lang)] == best


def test_more_languages_than_a_few_hundred(spark):
    rows = [(i, f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x " * 12, f"l{i:03d}") for i in range(150)]
    content = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(content) == 150
