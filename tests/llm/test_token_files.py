import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import token_files as tf

TEXTS = ["", "Hello  world's\n\n end ", "été naïve ²½ x×y", "<|endoftext|> a", "漢字 and œuf", "a\tb\r\nc   ", "'tis 'll ''s 123abc", " "]


@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=600), st.integers(0, 33))
@settings(max_examples=150, deadline=None)
def test_block_round_trip(ids, shift):
    v = np.array(ids, np.uint64) >> np.uint64(shift)
    v = v.astype("<u4")
    assert (tf.unpack(tf.pack(v)) == v).all()


@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=255), st.sampled_from("漢œ’ '\n\t")), max_size=60))
@settings(max_examples=150, deadline=None)
def test_encoder_equals_tokenizer(text):
    want = Tokenizer.from_file(tf.byte_bpe_path()).encode(text, add_special_tokens=False).ids if text else []
    assert np.frombuffer(tf.encoder(tf.byte_bpe_path())([text])[0], "<u4").tolist() == want


def test_generations_of_known_pieces(monkeypatch):
    monkeypatch.setattr(tf, "KNOWN_PIECES", 3)
    tok = Tokenizer.from_file(tf.byte_bpe_path())
    encode = tf.Encoder(tf.byte_bpe_path())
    for text in TEXTS * 2:
        assert np.frombuffer(encode([text, "a b c"])[0], "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_a_piece_is_looked_up_once_and_encoded_once(monkeypatch):
    monkeypatch.setattr(tf, "KNOWN_PIECES", 2)
    tok = Tokenizer.from_file(tf.byte_bpe_path())
    asked = []

    class Model:
        def tokenize(self, piece):
            asked.append(piece)
            return tok.model.tokenize(piece)

    encode = tf.Encoder(tf.byte_bpe_path())
    encode.known = tf.Known(Model(), {})
    want = np.array(tok.encode("un éa un éa", add_special_tokens=False).ids, "<u4").tobytes()
    assert encode(["un éa un éa"] * 2) == [want] * 2 and len(asked) == len(encode.known) == 3
    assert encode(["un éa un éa"]) == [want] and len(asked) == 3  # from the older generation
    assert encode.known.older and not encode.known.older.older  # two generations are held, not more
    letters = tok.pre_tokenizer.pre_tokenize_str("".join(map(chr, range(161, 256))))
    assert "".join(x for x, _ in letters) == tf.charmap_decode("".join(map(chr, range(161, 256))).encode(), "strict", tf.SPELLED)[0]


def test_files_round_trip(spark):
    tok = Tokenizer.from_file(tf.byte_bpe_path())
    rows = [(i * 3, t, "x") for i, t in enumerate(TEXTS)] + [(1000, "word " * 9000, "x"), (1001, None, None), (None, "no id", None), (5, "twice", "y"), (5, "twice", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids_crc32 string")
    manifest = tf.write_token_files(docs, tf.byte_bpe_path())
    got = tf.read_token_files(manifest).orderBy("start").collect()
    want, at = [], 0
    for doc_id, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    part = manifest.orderBy("part").collect()[-1]
    reader = tf.Reader(part.path)
    whole = np.concatenate([ids for _, _, ids in reader.documents()])
    for a, n in ((0, 1), (5, 3), (max(0, len(whole) - 5000), 5000)):
        assert (reader.ids(a, n) == whole[a : a + n]).all()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tf.read_token_files(tf.write_token_files(docs, tf.byte_bpe_path())).count() == 0


def test_foreign_file_is_refused(tmp_path):
    (tmp_path / "x.pfr").write_bytes(b"\0" * 50)
    with pytest.raises(ValueError):
        tf.Reader(f"file://{tmp_path}/x.pfr")
