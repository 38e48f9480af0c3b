import hashlib
import random
import re

from pyspark.sql import functions as F

from tessera.llm import merkle as mk


def pieces(text):
    out = set()
    for line in text.split("\n"):
        words = re.findall(r"[^ ]+ ?| ", re.sub(r"^ ", " ", line))
        out |= set(re.findall(mk.PIECE.replace("*+", "*").replace("}+", "}").replace(r"\z", r"\Z"), line)) if words or line else set()
    return out


def test_cuts_lose_nothing():
    rx = re.compile(mk.PIECE.replace(r"\z", r"\Z"))
    rnd = random.Random(0)
    for _ in range(500):
        line = "".join(rnd.choice(["a", "bc", " ", " ", ". ", "! ", "é", "?"]) for _ in range(rnd.randint(0, 60)))
        assert "".join(rx.findall(line)) == line


def test_report_against_brute_force(spark):
    rnd = random.Random(1)
    sentence = lambda: " ".join(rnd.choice(["the", "river", "stone", "漢字", "été", "x" * 30]) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(1, 14))).capitalize() + ". "
    rows = [(i * 11 % 997, "\n".join("".join(sentence() for _ in range(rnd.randint(0, 4))) + rnd.choice(["", "\n"]) for _ in range(rnd.randint(1, 6)))) for i in range(300)]
    rows += [(2000, None), (2001, ""), (2002, "w " * 60_000), (2003, rows[5][1]), (2004, rows[5][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows] + [(None, "no place here", 1)], "doc_id long, text string, bucket int")
    got = {r.doc_id: r for r in mk.edit_report(docs).collect()}
    assert len(got) == len(rows) + 1
    order = sorted(rows, reverse=True)
    prints = {}
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + n[:h]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0
        assert abs(r.near_edited - dice(pieces(t), pieces(edited))) < 1e-9 and abs(r.near_next - dice(pieces(t), pieces(n))) < 1e-9
        assert (r.fingerprint == r.edited_fingerprint) == (t == edited) == (r.first_edited is None)
        prints.setdefault(r.fingerprint, set()).add(t)
        prints.setdefault(r.edited_fingerprint, set()).add(edited)
    assert all(len(v) == 1 for v in prints.values()) and got[2003].fingerprint == got[2004].fingerprint
    assert got[None].near_next == 0


def test_sampled_bounds_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i * i, f"text {i}. and more") for i in range(400)], "doc_id long, text string")
    rows = lambda: sorted(map(str, mk.edit_report(docs).collect()))
    whole = rows()
    monkeypatch.setattr(mk, "SAMPLED_PER_BUCKET", 1)
    assert rows() == whole


def test_repeated_rows_one_row_and_empty(spark):
    one = spark.createDataFrame([(7, "only. one here")], "doc_id long, text string")
    r = mk.edit_report(one).first()
    assert r.near_next == 1.0
    twice = mk.edit_report(one.union(one)).collect()
    assert [x.near_next for x in twice] == [1.0, 1.0]
    assert mk.edit_report(one.limit(0)).count() == 0


def plain_tree(text):
    """The levels of nodes, by hand."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rx = re.compile(mk.PIECE.replace(r"\z", r"\Z"))
    levels = [[sha(".".join(map(sha, rx.findall(p)))) for p in text.split("\n")]]
    for _ in range(mk.LEVELS):
        out, run = [], []
        for n in levels[-1]:
            run.append(n)
            if n[0] == "0" or len(run) == mk.WIDEST and all(x[0] != "0" for x in run):
                out, run = [*out, run], []
        levels.append([sha("".join(f"{n}." for n in r)) for r in [*out, run] if r])
    return [*levels, [sha("".join(f"{n}." for n in levels[-1]))]]


def compared(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string")
    for c in "ab":
        df = df.withColumn(f"p{c}", mk.pieces_of(F.col(c))).withColumn(f"t{c}", mk.tree(F.col(f"p{c}")))
    a, b = F.col("ta"), F.col("tb")
    return df.select("a", "b", F.transform(a, lambda x: x["node"]).alias("levels"), mk.first_difference(a, b).alias("first"), mk.descended(a, b).alias("d"), (mk.root(a) == mk.root(b)).alias("same")).collect()


def test_trees_and_differences_against_brute_force(spark):
    rnd = random.Random(4)
    rows = [("a.\nb.\nc.", "a.\nX.\nc."), ("a.\nb.", "a.\nb."), ("a.", "a.\nb."), ("a.\nb.\nc.", "a.\nNEW.\nb.\nc."), ("a.\n\nb.", "a.\nb."), ("", "x"), ("", ""), ("\n" * 200, "\n" * 199)]
    for _ in range(60):
        lines = [f"line {rnd.randrange(500)} of it." for _ in range(rnd.randint(1, 300))]
        other = list(lines)
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(other) + 1)
            other[at : at + rnd.randint(0, 2)] = [f"new {rnd.randrange(99)}"] * rnd.randint(0, 2)
        rows.append(("\n".join(lines), "\n".join(other)))
    for r in compared(spark, rows):
        assert r.levels == plain_tree(r.a) and r.same == (r.a == r.b)
        x, y = plain_tree(r.a)[0], plain_tree(r.b)[0]
        first = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert r["first"] == (None if r.a == r.b else first)
        # all that is only on one side is found, and nothing that both sides keep in the same number
        assert set(x) - set(y) <= set(r.d.gone) <= {n for n in x if x.count(n) != y.count(n) or n not in y or r.a != r.b} and set(y) - set(x) <= set(r.d.came)
        assert (r.d.visited == 2) == (r.a == r.b)


def test_an_edit_in_a_long_text_visits_few_nodes(spark):
    lines = [f"paragraph {i} says this. And that." for i in range(10_000)]
    other = [*lines[:7_003], "an edit", *lines[7_004:]]
    moved = [*lines[:20], "put in", *lines[20:]]
    sha = lambda t: plain_tree(t)[0][0]
    got = compared(spark, [("\n".join(lines), "\n".join(other)), ("\n".join(lines), "\n".join(moved))])
    assert [(r["first"], r.d.gone, r.d.came) for r in got] == [(7_003, [sha(lines[7_003])], [sha("an edit")]), (20, [], [sha("put in")])]
    assert all(r.d.visited <= 2 * (mk.LEVELS + 2) * mk.WIDEST for r in got)
