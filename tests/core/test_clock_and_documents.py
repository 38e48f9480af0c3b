"""Printed times and records, documents of any depth, interval tables, vocabularies and chains of lists, by stated cases and brute force."""

import datetime as dt
import hashlib
import json
import random
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from tessera.operators import clock as ck
from tessera.operators import documents as dc
from tessera.operators import rankings as rk
from tessera.operators import records as rc
from tessera.operators import temporal as tp

SEP, UTC = dt.date(2026, 9, 19), dt.timezone.utc


def second(text):
    return int(dt.datetime.fromisoformat(text).timestamp())


STARTS = [  # date, structured, printed line, basis, start
    (SEP, "2026-09-20T00:00:00+00:00", "8pm ET / 5pm PT", "corroborated", "2026-09-20T00:00:00+00:00"),
    (SEP, "2026-09-20T01:00:00+00:00", "8pm ET/5pm PT", "visible_preferred", "2026-09-20T00:00:00+00:00"),
    (SEP, None, "8:00 PM EST", "visible", "2026-09-20T00:00:00+00:00"),
    (SEP, None, "7.30pm GMT", "visible", "2026-09-19T18:30:00+00:00"),
    (SEP, "2026-09-20T00:00:00+00:00", None, "structured", "2026-09-20T00:00:00+00:00"),
    (SEP, "2026-09-20T00:00:00+00:00", "doors open early", "structured", "2026-09-20T00:00:00+00:00"),
    (SEP, "2026-09-20T00:00:00+00:00", "8pm local", "unresolved", None),
    (SEP, None, "8pm local", "none", None),
    (SEP, None, None, "none", None),
    (SEP, None, "9pm ET / 5pm PT", "unresolved", None),
    (SEP, None, "12 a.m. central", "visible", "2026-09-19T05:00:00+00:00"),
    (SEP, None, "20:15 uk", "visible", "2026-09-19T19:15:00+00:00"),
    (dt.date(2026, 3, 8), None, "2:30 am ET", "visible", "2026-03-08T06:30:00+00:00"),  # left out by the change of the clock
    (dt.date(2026, 11, 1), None, "1:30 am ET", "visible", "2026-11-01T05:30:00+00:00"),  # comes twice
    (dt.date(2026, 1, 17), None, "8pm mountain", "visible", "2026-01-18T03:00:00+00:00"),
]


def test_announced_starts(spark):
    rows = [(i, d, None if s is None else second(s), line) for i, (d, s, line, *_) in enumerate(STARTS)]
    df = spark.createDataFrame(rows, "i int, d date, s long, line string")
    got = [r.x for r in df.select("i", ck.announced_start(F.col("d"), F.col("s"), F.col("line")).alias("x")).orderBy("i").collect()]
    assert [(x.basis, x.start) for x in got] == [(b, None if s is None else second(s)) for *_, b, s in STARTS]


def test_instants_are_those_of_the_zone_rules(spark):
    rnd = random.Random(3)
    zones = list(ck.ZONES)
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(900)), rnd.randrange(4, 24), rnd.randrange(60), rnd.choice(zones)) for i in range(400)]  # no clock changes from four on
    df = spark.createDataFrame(rows, "i int, d date, h int, m int, z string")
    got = {r.i: r.s for r in df.select("i", ck.instant(F.col("d"), F.col("h"), F.col("m"), F.col("z")).alias("s")).collect()}
    assert all(got[i] == int(dt.datetime(d.year, d.month, d.day, h, m, tzinfo=ZoneInfo(z)).timestamp()) for i, d, h, m, z in rows)


def test_printed_records(spark):
    cases = {
        "18-9": ("parsed", 18, 9, None, None, None), "13-7-1": ("parsed", 13, 7, 1, None, None), "9-1-2-1": ("parsed", 9, 1, 2, 1, None), "12-3-1 (8 KO)": ("parsed", 12, 3, 1, None, 8), "12-3-1, 8 KOs": ("parsed", 12, 3, 1, None, 8),
        " 0-0 ": ("parsed", 0, 0, None, None, None), "N/A": ("held", *[None] * 5), "2026-10-03-1-2": ("held", *[None] * 5), "1-2-3-4-5": ("held", *[None] * 5), "3-0 (4 KOs)": ("held", *[None] * 5), "  ": None, None: None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.x and tuple(r.x) for r in df.select("t", ck.printed_record(F.col("t")).alias("x")).collect()}
    assert got == cases


def test_documents(spark):
    rnd = random.Random(5)

    def made(depth):
        if depth == 0 or rnd.random() < 0.3:
            return rnd.choice([1, -2.5, "é\n\"", "", None, True, "nul\x00"])
        if rnd.random() < 0.4:
            return [made(depth - 1) for _ in range(rnd.randint(0, 3))]
        return {k: made(depth - 1) for k in rnd.sample(["id", "public_id", "user_id", "name", "ids", "source_fighter_id", "é"], rnd.randint(0, 5))}

    def shuffled(v):
        if isinstance(v, dict):
            return {k: shuffled(v[k]) for k in rnd.sample(list(v), len(v))}
        return [shuffled(x) for x in v] if isinstance(v, list) else v

    def bare(v):
        if isinstance(v, dict):
            return {k: bare(x) for k, x in v.items() if k in ("public_id", "source_fighter_id") or not (k == "id" or k.endswith("_id"))}
        return [bare(x) for x in v] if isinstance(v, list) else v

    docs = [made(5) for _ in range(80)]
    rows = [(i, json.dumps(d, indent=rnd.choice([None, 1])), json.dumps(shuffled(d), ensure_ascii=False)) for i, d in enumerate(docs)]
    rows += [(900, None, None), (901, "{no json", "[1,"), (902, '{"a": NaN}', "Infinity"), (903, "[" * 5_000 + "]" * 5_000, "[]"), (904, "", " ")]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    got = {r.i: r for r in df.select("i", dc.digest(F.col("a")).alias("a"), dc.digest(F.col("b")).alias("b"), dc.without_keys(F.col("b")).alias("bare"), dc.without_nul(F.col("a")).alias("nul"), dc.dedupe_key("k", F.col("a"), F.col("b")).alias("key")).collect()}
    spelled = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for i, d in enumerate(docs):
        assert got[i].a == got[i].b == hashlib.sha256(spelled(d).encode()).hexdigest() and got[i].bare == spelled(bare(d)) and "\\u0000" not in got[i].nul
        assert got[i].key == "k:" + hashlib.sha256(f"[{spelled(d)},{spelled(d)}]".encode()).hexdigest()[:40]
    assert all(got[i].a is None for i in (900, 901, 902, 904)) and got[900].key is None


def test_interval_tables(spark):
    rnd = random.Random(6)
    intervals = [(rnd.choice("ab"), i, rnd.choice([None, *[rnd.randrange(-500, 500)] * 6]), rnd.choice([None, *[rnd.randrange(-500, 2_000)] * 6])) for i in range(60)]
    points = [(rnd.choice("abc"), n, rnd.choice([None, *[rnd.randrange(-600, 2_100)] * 20])) for n in range(300)]
    want = sorted((k, n, v, i) for k, n, v in points for q, i, lo, hi in intervals if k == q and v is not None and (lo is None or lo <= v) and (hi is None or v < hi))
    args = spark.createDataFrame(points, "k string, n int, v int"), spark.createDataFrame(intervals, "k string, i int, lo int, hi int")
    assert sorted((r.k, r.n, r.v, r.i) for r in tp.within_intervals(*args, ["k"], "v", "lo", "hi").collect()) == want and len(want) > 500
    day = lambda x: None if x is None else dt.date(2020, 1, 1) + dt.timedelta(days=x)
    args = spark.createDataFrame([(k, n, day(v)) for k, n, v in points], "k string, n int, v date"), spark.createDataFrame([(k, i, day(lo), day(hi)) for k, i, lo, hi in intervals], "k string, i int, lo date, hi date")
    assert sorted((r.k, r.n, (r.v - dt.date(2020, 1, 1)).days, r.i) for r in tp.within_intervals(*args, ["k"], "v", "lo", "hi").collect()) == want


def test_vocabularies(spark):
    texts = spark.createDataFrame([(1, "The Red-Fox and the red fox, redfox"), (2, None), (3, ""), (4, "a b a b a"), (5, "ÉTÉ fox")], "id int, t string")
    words = spark.createDataFrame([("red fox", "x"), ("a b a", "y"), ("fox", "z"), ("été", "w"), ("---", "v"), (None, "u"), ("red fox", "again")], "phrase string, tag string")
    got = sorted(tuple(r) for r in rc.phrases_found(texts, words, "id", "t", "phrase").collect())
    assert got == [(1, "fox", "z", 2), (1, "red fox", "again", 2), (1, "red fox", "x", 2), (4, "a b a", "y", 2), (5, "fox", "z", 1), (5, "été", "w", 1)]
    assert rc.phrases_found(texts, words.limit(0), "id", "t", "phrase").count() == 0


def test_chains_are_pairs_of_lists(spark):
    rnd = random.Random(8)
    schema = "b int, y int, entity_id string, source_name string, position int, rank int, rank_label string, is_champion boolean, is_vacant boolean, designation string, mandatory boolean"
    rows = []
    for b in (1, 2):
        for y in (1, 2, 4, 5, 9):
            for n, e in enumerate(rnd.sample("abcdefgh", 6)):
                rows.append((b, y, e, None, n + 1, n or None, "C" if n == 0 else str(n), n == 0, False, rnd.choice([None, "m"]), rnd.choice([None, True])))
    lists = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, rk.chain_changes(lists, ["b"], "y").select("b", "y", "type", "key", "rank", "previous_rank").collect()), key=str)
    want = []
    for was, y in ((1, 2), (2, 4), (4, 5), (5, 9)):
        of = lambda n: lists.filter(F.col("y") == n).drop("y")
        want += [(r.b, y, r.type, r.key, r["rank"], r.previous_rank) for r in rk.ranking_changes(of(was), of(y), ["b"]).collect()]
    assert got == sorted(want, key=str) and len(got) > 30
    step = rk.chain_changes(lists.filter("y > 4"), ["b"], "y", last=lists.filter("y = 4"))
    assert sorted(map(tuple, step.select("b", "y", "type", "key", "rank", "previous_rank").collect()), key=str) == [r for r in got if r[1] > 4]


def test_intervals_that_do_not_overlap_are_met_in_order(spark):
    rnd = random.Random(7)
    cuts = {k: sorted(rnd.sample(range(-500, 500), 30)) for k in "ab"}
    intervals = [(k, i, None if i == 0 else lo, None if i == 29 else lo + rnd.choice([0, 1, hi - lo])) for k in "ab" for i, (lo, hi) in enumerate(zip(cuts[k], [*cuts[k][1:], 600]))]
    points = [(rnd.choice("abc"), n, rnd.choice([None, *[rnd.randrange(-600, 700)] * 20])) for n in range(300)]
    intervals, more = [x for x in intervals if x[1] != 0], [x for x in intervals if x[1] == 0]
    overlapping = [("d", 0, 0, 50), ("d", 1, 40, 60), ("d", 2, None, None)]
    points += [("d", 300 + v, v) for v in range(-5, 70, 5)] + [(None, 400, 3)]
    for rows, mixed in ((intervals, False), (intervals + more + overlapping + [(None, 9, 0, 9)], True)):
        want = sorted((k, n, v, i) for k, n, v in points for q, i, lo, hi in rows if k is not None and k == q and v is not None and (lo is None or lo <= v) and (hi is None or v < hi))
        got = tp.within_intervals(spark.createDataFrame(points, "k string, n int, v int"), spark.createDataFrame(rows, "k string, i int, lo int, hi int"), ["k"], "v", "lo", "hi")
        assert sorted((r.k, r.n, r.v, r.i) for r in got.collect()) == want and len(want) > 40
        assert ("Generate" in got._jdf.queryExecution().optimizedPlan().toString()) == mixed  # no point is made several rows


def test_only_runs_that_are_phrases_are_counted(spark):
    rnd = random.Random(8)
    texts = spark.createDataFrame([(i, " ".join(rnd.choice("abcdef") for _ in range(30))) for i in range(40)], "id int, t string")
    words = spark.createDataFrame([("a", 1), ("a b", 2), ("c d", 3), ("e f a", 4), ("b c", 5), ("x y", 6)], "phrase string, tag int")
    found = [rc.phrases_found(texts, words, "id", "t", "phrase", block) for block in (100, 2)]
    one, several = (sorted(tuple(r) for r in f.collect()) for f in found)
    held = {(i, p): len([k for k in range(len(t.split()) - len(p.split()) + 1) if t.split()[k : k + len(p.split())] == p.split()]) for i, t in texts.collect() for p, _ in words.collect()}
    assert one == several == sorted((i, p, tag, held[i, p]) for i in range(40) for p, tag in words.collect() if held[i, p])
    plan = found[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [id") < plan.index("LeftSemi")  # below the count
