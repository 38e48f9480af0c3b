import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import align

CUTS = st.lists(st.integers(1, 60), unique=True, max_size=25)


@given(st.lists(st.tuples(CUTS, CUTS), min_size=1, max_size=6), st.integers(1, 70))
@settings(max_examples=200)
def test_lockstep_against_sets(docs, lane):
    a_ends, b_ends, marks, base = [], [], [0], 0
    for a, b in docs:
        a_ends += [base + x for x in sorted({*a, 60})]
        b_ends += [base + x for x in sorted({*b, 60})]
        marks += [*range(base, base + 60, lane), base + 60]
        base += 60
    got = align.lockstep(np.array(a_ends), np.array(b_ends), np.unique(marks))
    want = [b_ends.index(x) if x in b_ends else -1 for x in a_ends]
    assert got.tolist() == want


@given(st.lists(st.integers(0, 2**32 - 1), max_size=20))
def test_packing(values):
    places, times = np.array(values, np.int64), np.array(values[::-1], np.int64)
    a, b = align.unpacked(align.packed(places, times))
    assert a.tolist() == values and b.tolist() == values[::-1]


def brute(rows, paths):
    """Token by token, from the libraries themselves."""
    import sentencepiece

    t = Tokenizer.from_file(paths.a)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=paths.b)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled, extra = {chr(b): b for b in visible}, 256
    for b in range(256):
        if b not in visible:
            spelled[chr(extra)] = b
            extra += 1

    def tokens(text):
        a = [(i, bytes(spelled[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in sp.encode(text):
            p = sp.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == b"".join(x for _, x in b) == whole else ([], [])

    merged, counts = [], Counter()
    for doc_id, text in rows:
        a, b = tokens(text) if text else ([], [])
        ends = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                at += len(x)
                out.append((at, i))
            ends.append(out)
        links = [(i, j) for e, i in ends[0] for f, j in ends[1] if e == f] if len(a) < 400 else [(i, dict(ends[1])[e]) for e, i in ends[0] if e in dict(ends[1])]
        cuts = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        group = lambda side, lo, hi: ",".join(str(i) for e, i in side if lo < e <= hi)
        text_ = ";".join(f"{group(ends[0], lo, hi)}|{group(ends[1], lo, hi)}" for lo, hi in zip([0, *cuts], cuts))
        merged.append((doc_id, len(a), len(b), len(cuts), links, hashlib.sha256(text_.encode()).hexdigest() if text_ else ""))
        counts.update(links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(d, n_a, n_b, n_g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), h) for d, n_a, n_b, n_g, links, h in merged]


def test_against_brute_force(spark):
    rnd = random.Random(11)
    bits = ["the", "Wasserstein", "été", "漢字", " ", "  ", "\n\n", "\t", "123456", "<|endoftext|>", "<s>", "<0x41>", "don't", "naïve", "...", "𝒳", "🙂", "x" * 30, " ", "\r\n", "-_-"]
    rows = [(i, "".join(rnd.choice(bits) + rnd.choice(["", " "]) for _ in range(rnd.randint(1, 40)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "has ▁ in it"), (203, " "), (204, "x"), (205, "ends with space "), (206, "same text"), (206, "same text"), (None, "no id at all"), (207, "nul \x00 inside"), (208, "aé漢\n" * 90)]
    docs = spark.createDataFrame([(*r, 5, "old") for r in rows], "doc_id long, text string, n_a int, block string").repartition(3)
    paths = align.public_paths()
    kept = align.TOGETHER, align.BLOCK_DOCS
    align.TOGETHER, align.BLOCK_DOCS = 500, 17
    got = align.linked_counts(docs, paths)
    found = sorted((tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)
    align.TOGETHER, align.BLOCK_DOCS = kept
    assert found == sorted(brute(rows, paths), key=repr)
    assert {r[0] for r in found if r[1] == 0} == {200, 201, 202}
    assert align.linked_counts(docs.limit(0), paths).count() == 0


def test_alignments_spell_the_text(spark):
    rows = [(1, "Ein Haus am Fluß, don't you see?"), (2, None), (3, "long words " * 4_000), (3, "x")]
    paths = align.public_paths()
    own = align.sides(paths)
    got = align.alignments(spark.createDataFrame(rows, "doc_id long, text string"), paths).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 3]
    for r in got:
        a, b = [own.a.bytes[i] for i in r.a_ids], [own.b.bytes[i] for i in r.b_ids]
        text = b"".join(a)
        assert text == b"".join(b) and (not text or text.decode()[1:] in [t for _, t in rows])
        ends = lambda side: np.cumsum([len(x) for x in side]).tolist()
        assert [ends(a)[x.a] for x in r.links] == [ends(b)[x.b] for x in r.links] == r.cuts == sorted(set(ends(a)) & set(ends(b)))
