import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import secrets as se
from tessera.llm.automaton import Dfa, Parser

BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}
PIECES = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "AKIAKIA", "A1B2C3D4E5F6G7H8", "deadbeef", "0123456789abcdef", "é", "漢", "\n", "-", "x", "ghp_", "-----BEGIN ", "-----END ", "RSA ", "PRIVATE KEY-----", "\nMIIEowIBAAKCAQEA1234", "\r\nabc=", "glpat-" + "q" * 20]


def brute(text):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in p.finditer(text):
            if {"assign": lambda: len(m[2]) >= 6, "access": lambda: len(m[0]) >= 20, "hex": lambda: len(m[0]) >= 24}[kind]():
                out.append((m.start(), k, m.end()))
    return sorted(out)


@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
@settings(max_examples=400, deadline=None)
def test_base_spans_equal_regexes(text):
    scan = se.scanner()
    got = scan(text)
    assert [x for x in got if scan.rules[x[1]].base] == brute(text)
    for k, rule in enumerate(scan.rules):
        if not rule.base:
            want = [(m.start(), m.end()) for m in re.finditer(rule.pattern, text) if re.fullmatch(rule.check, m[0])]
            assert [(a, b) for a, r, b in got if r == k] == want


@given(st.sampled_from(["a(b|cd)*e", "[a-c]{2,4}x?", "(ab|a)(c|bc)", "x*y+"]), st.text(alphabet="abcdexy", max_size=8))
@settings(max_examples=300, deadline=None)
def test_automaton_accepts_what_the_regex_does(pattern, text):
    dfa = Dfa([Parser(pattern, False).parse()], anchored=True)
    s = 0
    for b in text.encode():
        s = dfa.table[s, b]
    assert bool(dfa.accepts[s]) == bool(re.fullmatch(pattern, text))


def test_minimal():
    dfa = Dfa([Parser("(a|b)*abb", False).parse()], anchored=True)
    assert len(dfa.table) == 5  # the four of the textbook and the dead state


def test_table(spark):
    rows = [(1, "token = 'abcdef123'"), (2, None), (3, ""), (4, "é" * 9 + "AKIA" + "B" * 16), (4, "é" * 9 + "AKIA" + "B" * 16), (None, "x" * 200_000 + " " + "a1" * 20), (6, "password: short")]
    docs = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, found string")
    docs.createOrReplaceTempView("d")
    got = {r.doc_id: [(f.kind, f.start, f.end) for f in r.found] for r in se.secrets(docs).collect()}
    assert got == {1: [("assign", 0, 19 - 1)], 2: [], 3: [], 4: [("access", 9, 29)], None: [("hex", 200_001, 200_041)], 6: []} | {1: [("assign", 0, len("token = 'abcdef123"))]}
    assert se.secrets(docs.limit(0)).count() == 0


def test_private_keys_with_their_bodies():
    body = "\n".join(["M" * 64, "n" * 64, "short=="])
    whole = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    text = f"é {whole} then\n-----BEGIN PRIVATE KEY-----\n{'Q' * 40}\nordinary words follow"
    kinds = [(se.scanner().rules[k].kind, text[a:b]) for a, k, b in se.scanner()(text)]
    assert kinds == [("private_key", whole), ("private_key", "-----BEGIN PRIVATE KEY-----\n" + "Q" * 40)]


def test_many_secrets_in_a_long_text():
    text = "é token=abcdefgh1 " * 20_000
    got = se.scanner()(text)
    assert len(got) == 20_000 and got[-1] == (len(text) - 16, 0, len(text) - 1)


def test_query_digest(spark, tmp_path):
    spark.createDataFrame([(1, "token=abcdefgh " + "0f" * 12), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in se.query(spark, f"file://{tmp_path}").collect()}
    assert got[1].spans == "assign:0:14,hex:15:39" and (got[1].n_assign, got[1].n_access, got[1].n_hex) == (1, 0, 1)
    assert got[1].base_sha256 == hashlib.sha256(b"assign:0:14,hex:15:39").hexdigest() and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
