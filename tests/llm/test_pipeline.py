import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm.token_files import byte_bpe_path

VOCAB = {"en": "the of and house water stone river tion ing ere", "de": "der und ein schaft keit haus wasser stein fluss ung"}


def text(rnd, lang, n):
    w = VOCAB[lang].split()
    return " ".join(rnd.choice(w) + rnd.choice(w) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(0)
    at = tmp_path_factory.mktemp("docs")
    item = text(rnd, "en", 30)
    rows = [(i, text(rnd, lang := rnd.choice(["en", "en", "de"]), rnd.randint(60, 200)), lang, f"s{i % 3}", 0) for i in range(120)]
    near = rows[5][1].split()
    near[30] = "edited"
    rows += [(200, rows[3][1], rows[3][2], "s0", 0), (201, " ".join(near), rows[5][2], "s1", 0)]  # an exact and a near copy
    rows += [(202, rows[9][1] + " " + item + " " + text(rnd, "en", 80), "en", "s2", 0)]  # a leaked item
    rows += [(203, "12345 !!!", "en", "s0", 0), (204, None, None, None, None), (205, "", "en", "s0", 0), (3, rows[3][1], rows[3][2], "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return f"file://{at}", {r[0]: r[1] for r in rows}


def test_stages_and_their_decisions(spark, folder):
    sf_dir, texts = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == names
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    language, near, clean, mix = kept
    assert {203, 204, 205} & set(language) == set() and len(language) >= 122
    assert {200, 201} & set(near) == set() and near.count(3) == 1 and {3, 5, 202} <= set(near)
    assert set(near) - set(clean) == {202}
    assert set(mix) <= set(clean) and 0.5 * len(clean) <= len(mix) < len(clean)


def test_columns_of_clashing_names_are_kept(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").selectExpr("*", "doc_id AS score", "'x' AS topic", "1 AS kept", "2 AS fp", "3 AS item_id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder[0])
        assert out.columns == docs.columns
        assert all(r.score == r.doc_id and r.topic == "x" and (r.kept, r.fp, r.item_id) == (1, 2, 3) for r in out.collect())


def test_run_writes_the_ids_of_what_is_left(spark, folder):
    sf_dir, texts = folder
    tok, at = Tokenizer.from_file(byte_bpe_path()), 0
    rows = corpus_pipeline.run(spark, sf_dir).orderBy("doc_id").collect()
    assert len(rows) > 60
    for r in rows:
        ids = [*tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder[0]).count() == 0


def test_rows_decide_and_not_their_ids(spark, tmp_path):
    rnd = random.Random(7)
    a, b, c, d, item = (text(rnd, "en", 80) for _ in range(5))
    near = a.split()
    near[10] = "edited"
    rows = [(1, a), (2, " ".join(near)), (2, b), (None, a), (None, c), (None, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (None, c)], key=str)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, d), (1, item + " " + d), (None, item), (None, c)], "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.benchmark_free(spark, docs, f"file://{tmp_path}").collect()]
    assert sorted(got, key=str) == sorted([(1, d), (None, c)], key=str)


def test_written_tables_send_python_small_batches(spark):
    from tessera.llm.common import written

    def sizes(parts):
        for part in parts:
            yield part.assign(n=len(part), bytes=part["text"].str.len().sum())[["n", "bytes"]]

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    texts = spark.range(2000).coalesce(1).selectExpr("repeat('long text ', 2000) AS text")
    got = written(texts.mapInPandas(sizes, "n long, bytes long"), "batches").distinct().collect()
    assert max(r.bytes for r in got) < 6 << 20 and spark.conf.get(key) == before
