import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import warc


@given(st.lists(st.lists(st.integers(0, 50)), max_size=9))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("https://WWW.a.example.com:80/X?b=1#f") == "com,example,a)/x?b=1"
    assert warc.url_key(None) == ")/" and warc.url_key("http://[bad") == "http://[bad"


def test_round_trip(spark):
    rnd = random.Random(3)
    same = "<p>é" + "x" * 120
    html = {i: rnd.choice([same, "short", None, f"<p>{i}" + "y" * 200, "", "z" * 99, "z" * 100]) for i in range(200)}
    html[7] = "w" * 300_000
    rows = [(i, f"https://h{i % 5}.example.org/a b{i % 11}", h, "d") for i, h in html.items()] + [(3, "https://h.example.org/", html[3], "d"), (None, None, same, "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    warc.RUN, run = 17, warc.RUN
    warc.HELD, held = 40, warc.HELD
    runs = warc.write_archives(pages)
    history = warc.capture_histories(runs)
    got = warc.read_archives(history).collect()
    warc.RUN, warc.HELD = run, held
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, u, h, _ in rows:
        b = (h or "").encode()
        r = first[h or ""] if len(b) >= 100 and first[h or ""] != i else None
        want.append((i, u or "", len(b), hashlib.sha256(b).hexdigest(), "response" if r is None else "revisit", r, None if r is not None else b))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    found = [(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(found, key=key) == sorted(want, key=key)
    assert [r.payload_digest for r in sorted(got, key=lambda r: (r.urlkey, r.captured or "", -1 if r.page_id is None else r.page_id))] == [
        hashlib.sha256((h or "").encode()).hexdigest() for _, h in sorted(((warc.url_key(u), f"{warc.EPOCH + (i or 0)}", -1 if i is None else i), h) for i, u, h, _ in rows)
    ]
    order = [(r.urlkey, r.captured, int(r.page_id or -1)) for r in history.collect()]
    assert order == sorted(order) and len(order) == len(rows)


def test_merge_goes_through_files_and_keeps_numeric_order(spark, tmp_path):
    rnd = random.Random(4)
    entries = [("com,a)/", "20200101000000", str(i), "http://a.com/", "p", i, 1) for i in range(300)]
    rnd.shuffle(entries)
    runs = [sorted(entries[i : i + 50], key=warc.place) for i in range(0, 300, 50)]
    assert list(warc.merged([iter(r) for r in runs])) == sorted(entries, key=warc.place)
    uri = f"file://{tmp_path}/a.run"
    warc._spilled(uri, warc.merged([iter(r) for r in runs]))
    assert list(warc._streamed(uri)) == sorted(entries, key=warc.place)
    assert [e[2] for e in warc._streamed(uri)] == [str(i) for i in range(300)]


def test_revisits_must_have_their_response(spark):
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    good = [(1, 3, "d", "response", None), (2, 3, "d", "revisit", 1), (None, 3, "d", "revisit", 1)]
    assert warc.resolved(spark.createDataFrame(good, schema)).count() == 3
    for bad in ((4, 3, "e", "revisit", 1), (4, 3, "d", "revisit", 9), (4, 2, "d", "revisit", 1)):
        with pytest.raises(ValueError, match="no response of its payload"):
            warc.resolved(spark.createDataFrame([*good, bad], schema)).collect()


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.capture_histories(warc.write_archives(pages))).count() == 0


def test_any_page_number_and_any_time(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    ids = [2**63 - 1, -(2**63), 9_000_000_000_000_000_000, 300_000_000_000, -1, 0, 7, None]
    same = "<p>" + "k" * 200
    pages = spark.createDataFrame([(i, "http://a.org/", same) for i in ids], "page_id long, url string, html string")
    history = warc.capture_histories(warc.write_archives(pages)).collect()
    assert len(history) == len(ids) and all(len(r.captured) == 14 and r.captured < "2056" for r in history)
    assert [(r.captured, int(r.page_id or -(2**63))) for r in history] == sorted((r.captured, int(r.page_id or -(2**63))) for r in history)
    got = warc.resolved(warc.read_archives(spark.createDataFrame(history, warc.INDEX))).collect()
    assert {r.page_id for r in got if r.record_type == "response"} == {-(2**63)} and all(r.refers_to == -(2**63) for r in got if r.record_type == "revisit")

    seconds = [None, 0, -62_135_596_800 - 10**9, 253_402_300_800 + 10**10, 1_700_000_000, None]
    timed = spark.createDataFrame([(i, "http://a.org/", f"{same}{i % 2}", s) for i, s in enumerate(seconds)], "page_id long, url string, html string, s long")
    runs = warc.write_archives(timed, captured=F.timestamp_seconds("s"))
    history = warc.capture_histories(runs)
    assert [(r.captured, r.page_id) for r in history.collect()] == [("", "0"), ("", "5"), ("00010101000000", "2"), ("19700101000000", "1"), ("20231114221320", "4"), ("99991231235959", "3")]
    got = {r.page_id: r for r in warc.resolved(warc.read_archives(history)).collect()}
    assert got[0].captured is None and got[4].captured == "20231114221320" and got[4].refers_to == 0 and got[5].refers_to == 1
    assert dt.datetime.strptime(got[1].captured, "%Y%m%d%H%M%S").year == 1970


def test_headers_of_archives(spark):
    same = "<p>" + "k" * 200
    pages = spark.createDataFrame([(1, "http://a.org/ x", same), (2, "http://b.org/", same)], "page_id long, url string, html string").coalesce(1)
    entries = warc.write_archives(pages).collect()
    store, path = warc.opened(entries[0].path)
    with store.open_input_stream(path, compression=None) as f:
        data = f.read()
    members, rest = [], data
    while rest:
        d = warc.zlib.decompressobj(31)
        members.append(d.decompress(rest))
        rest = d.unused_data
    assert [m.split(b"\r\n")[1] for m in members] == [b"WARC-Type: warcinfo", b"WARC-Type: response", b"WARC-Type: revisit"]
    for e in entries:
        h, _ = warc.parse_record(data[e.offset : e.offset + e.length])
        if h["WARC-Type"] == "revisit":
            assert h["WARC-Refers-To-Target-URI"] == "http://a.org/%20x" and h["WARC-Refers-To-Date"] == "2023-11-14T22:13:21Z"
