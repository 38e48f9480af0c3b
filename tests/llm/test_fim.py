import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import fim

ALPHABET = st.sampled_from(list("ab<>PSM é漢𝒳\n"))


def plain(doc_id, text):
    """The rule without a piece table."""
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    lo, hi = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    p, m, s = t[:lo], t[lo:hi], t[hi:]
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", None, None, t
    if h4 % 100 < 20:
        return "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(st.integers(0, 10_000), st.text(ALPHABET, max_size=30))
@settings(max_examples=300)
def test_against_brute_force(doc_id, text):
    draws = fim.draws_of(doc_id)
    form = fim.form_of(text, draws, fim.SENTINELS, fim.RATE, fim.SPM)
    made, prefix, middle = fim.arrange(text, form, draws, fim.SENTINELS)
    assert (form, prefix, middle, made.text()) == plain(doc_id, text)
    assert made.sha256() == hashlib.sha256(made.text().encode()).hexdigest()
    assert fim.restore(made.text(), form, fim.SENTINELS).text() == text


@given(st.text(ALPHABET, max_size=20), st.lists(st.integers(0, 20), max_size=6), st.randoms())
def test_cuts_and_permutations(text, places, rnd):
    made = fim.PieceTable.of(text, "xyz").arranged([0])
    for p in places:
        made = made.cut(min(p, len(text)))
    assert made.text() == text and len(made.pieces) == len(places) + 1
    order = list(range(len(made.pieces)))
    rnd.shuffle(order)
    moved = made.arranged(order)
    assert moved.arranged(fim.inverse(order)).pieces == made.pieces
    assert moved.text() == "".join(made.arranged([i]).text() for i in order)
    assert "".join(made.stream(3)) == text and made.buffers == (text, "xyz")


def test_rows(spark):
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choice("ab c<é漢𝒳\n") for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "has <S> in it"), (403, "long é " * 60_000), (403, "long é " * 60_000), (None, "no id"), (-7, "minus")]
    docs = spark.createDataFrame([(*r, "old", 5) for r in rows], "doc_id long, text string, form string, extra int")
    got = fim.restored(fim.transformed(docs)).collect()
    assert len(got) == len(rows) and all(r.extra == 5 for r in got)
    want = sorted(((i, t, *plain(i, t)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.text, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == want
    for r in got:
        assert r.restored == (r.text or "") and r.n == len(r.restored)
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256(r.restored.encode()).hexdigest()
        buffers = (r.text or "", "".join(fim.SENTINELS))
        assert "".join(buffers[p.buffer][p.start : p.start + p.length] for p in r.pieces) == r.output
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.restored(fim.transformed(docs.limit(0))).count() == 0


def test_other_sentinels_and_broken_outputs(spark):
    marks = ("[prefix]", "[suffix]", "[middle]")
    docs = spark.createDataFrame([(i, f"text {i} <P> and more words") for i in range(50)], "doc_id long, text string")
    got = fim.restored(fim.transformed(docs, sentinels=marks, rate=100, spm=50), sentinels=marks).collect()
    assert all(r.restored == r.text and r.form != "plain" for r in got) and len({r.form for r in got}) == 2
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "ba", "c"), ("abc", "b", "d"), ("aa", "b", "c")):
        with pytest.raises(ValueError, match="overlap"):
            fim.checked(bad)
    for output in ("x<P>a<S>b<M>c", "<P>a<M>c", "<S>b<P>a<M>c", ""):
        with pytest.raises(ValueError, match="psm"):
            fim.restore(output, "psm", fim.SENTINELS)
